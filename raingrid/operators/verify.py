"""Verification scores (D2-D5, D8-D13, D20, D22, D25, D26, D30, D31, K4). All are algebraic aggregates but the quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import EVENT_THRESHOLDS, REGISTRIES, bin_of, event
from ..functions.missing import ratio
from ..functions.scalar import log_amount
from ..sources.shared import BROADCAST_BYTES, written


def point_aggregates(target: str, estimate: str, time: str | None = None) -> list[Column]:
    """n, hours, MAE, RMSE and bias (estimate less truth) of rows on the support."""
    e = F.col(estimate).cast("double") - F.col(target).cast("double")
    out = [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")]
    return out + ([F.count_distinct(F.when(e.isNotNull(), F.col(time))).alias("valid_hours")] if time else [])


def event_aggregates(target: str, estimate: str, threshold: float) -> list[Column]:
    """Hits, false alarms, misses, CSI and one-cell FSS at a threshold."""
    o, f = event(target, threshold), event(estimate, threshold)
    hits, false, missed = F.count_if(o & f), F.count_if(~o & f), F.count_if(o & ~f)
    return [
        hits.alias("hits"), false.alias("false_alarms"), missed.alias("misses"),
        ratio(hits, hits + false + missed).alias("csi"),
        (1 - ratio(F.count_if(o != f), F.count_if(o) + F.count_if(f))).alias("fss"),
    ]


def point_metrics(df: DataFrame, support: Column, target: str, estimate: str, by: Sequence[str] = (), time: str | None = None) -> DataFrame:
    return df.filter(support).groupBy(*by).agg(*point_aggregates(target, estimate, time))


def event_scores(df: DataFrame, support: Column, target: str, estimates: Sequence[str], thresholds: Sequence[float] = EVENT_THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """A row for each method and threshold (D3, D4): counts of all of them side by side in one row, turned into rows after the aggregation. Values are compared in their own type (Z-3)."""
    kinds = dict(df.dtypes)
    at = lambda c, t: F.col(c) >= F.lit(float(t)).cast(kinds[c])
    keys = [(m, t) for m in estimates for t in thresholds]
    counts = [
        F.struct(F.lit(m).alias("method"), F.lit(float(t)).alias("threshold"), F.count_if(at(target, t) & at(m, t)).alias("hits"), F.count_if(~at(target, t) & at(m, t)).alias("false_alarms"), F.count_if(at(target, t) & ~at(m, t)).alias("misses"))
        for m, t in keys
    ]
    own = df.filter(support).groupBy(*by).agg(F.array(*counts).alias("k")).select(*by, F.inline("k"))
    hits, wrong = F.col("hits"), F.col("false_alarms") + F.col("misses")
    return own.withColumns({"csi": ratio(hits, hits + wrong), "fss": 1 - ratio(wrong, 2 * hits + wrong)})


def methods(df: DataFrame, target: str, estimates: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form: a row for each cell and method, in the methods' own type if it is one."""
    kinds = {dict(df.dtypes)[m] for m in estimates}
    kind = "float" if kinds == {"float"} else "double"
    return df.select(*keep, target, F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).cast(kind).alias("estimate")) for m in estimates))).alias("m")).select(*keep, target, "m.method", "m.estimate")


def strata(df: DataFrame, support: Column, registry: str, target: str, estimates: Sequence[str]) -> DataFrame:
    """Errors by bin of the truth and method; empty bins are there with n = 0 and NULL scores (D8, D9, Z-15)."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(k, label, m) for k, (label, _) in enumerate(REGISTRIES[registry]) for m in estimates], "bin int, bin_label string, method string")
    e = F.col("estimate").cast("double") - F.col(target).cast("double")
    scores = methods(df.filter(support), target, estimates).withColumn("bin_label", bin_of(registry, target)).groupBy("bin_label", "method").agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")
    )
    return F.broadcast(spine).join(scores, ["bin_label", "method"], "left").select("bin", "bin_label", "method", F.coalesce("n", F.lit(0)).alias("n"), "mae", "rmse", "bias")


#: Sub-ranges that a round of the selection makes of a range, and values of a range that are sorted rather than cut again.
DIGITS, FEW = 4_096, 65_536


def exact_quantiles(df: DataFrame, value: str, levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by, q)``: an array of exact quantiles (linear between neighbours) of each group, of any size.

    Selection by rounds, for all groups and levels at once. A round counts the values of ranges that keep their order, which tells
    the range of each rank asked for and the values before it; only those ranges are cut again, into ``DIGITS`` equal parts between
    their own least and largest value, until a range holds one value or at most ``FEW`` rows, which are then sorted. The first
    ranges are logarithmic. So the input is read twice, values of the ranges chosen are written (less in each round), and no task
    holds more than ``FEW`` values of a group or the counts of its ranges. Missing values are left out; a group whose name is NULL is one like others.
    """
    v = F.col(value).cast("double")
    keys = [f"_g{k}" for k in range(len(by))]
    rows = df.filter(v.isNotNull()).select(
        *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(k) for c, k in zip(by, keys, strict=True)), *by, v.alias("_v"), F.floor(F.signum(v) * F.log1p(F.abs(v) * 1000) * 64).cast("string").alias("_path"), F.floor(F.signum(v) * F.log1p(F.abs(v) * 1000) * 64).alias("_d")
    )

    def counted(own: DataFrame, within: list[str], *more: Column) -> DataFrame:
        """Ranges with their number of values, and those before in the same parent."""
        out = own.groupBy(*within, "_path", "_d").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *more)
        before = Window.partitionBy(*within).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
        return out.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    first = counted(rows, keys, *(F.first(c).alias(c) for c in by)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    place = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    wanted = F.array_distinct(F.array(*(f(place(q)) for q in levels for f in (F.floor, F.ceil))))
    here = F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    targets = written(first.select(*keys, *by, "_path", "_all", F.explode(here).alias("_rank"), F.col("_before").alias("_at"), "_n", "_lo", "_hi"), "ranks")
    done = targets.filter("_lo = _hi")
    names = [*keys, "_path"]

    def ranges(t: DataFrame, n: int) -> DataFrame:
        """The ranges of so many ranks at most, broadcast where these are few (their names are short)."""
        own = t.select(*names, "_lo", "_hi").distinct()
        return F.broadcast(own) if n * (16 + 32 * len(own.columns)) <= BROADCAST_BYTES else own

    values = rows.select(*names, "_v")
    left = targets.filter("_lo < _hi")
    sorted_out: list[DataFrame] = []
    while (sizes := left.agg(F.count("*").alias("n"), F.max("_n").alias("most")).first())["n"]:
        n, last = sizes["n"], sizes["most"] <= FEW
        if not last:  # else they are read once
            values = written(values.join(ranges(left, n).drop("_lo", "_hi"), names, "left_semi"), "values")
        few = left.filter(F.col("_n") <= FEW)
        equal = values.join(ranges(few, n).drop("_lo", "_hi"), names, "left_semi").groupBy(*names, "_v").agg(F.count("*").alias("_c"))
        equal = equal.withColumn("_end", F.sum("_c").over(Window.partitionBy(*names).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
        place_in = F.col("_rank") - F.col("_at")
        sorted_out.append(few.join(equal, names).filter((place_in >= F.col("_end") - F.col("_c")) & (place_in < F.col("_end"))).withColumns({"_lo": F.col("_v"), "_hi": F.col("_v")}).select(targets.columns))
        if last:
            break
        large = left.filter(F.col("_n") > FEW)
        digit = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * DIGITS), F.lit(DIGITS - 1))
        cut = values.join(ranges(large, n), names).withColumn("_parent", F.col("_path")).withColumn("_d", digit).withColumn("_path", F.concat("_path", F.lit("."), F.col("_d").cast("string"))).drop("_lo", "_hi")
        parts = counted(cut, [*keys, "_parent"]).drop("_d")
        parents = large.select(*keys, *by, F.col("_path").alias("_parent"), "_all", "_rank", "_at")
        found = parents.join(parts, [*keys, "_parent"]).filter("_rank >= _at + _before and _rank < _at + _before + _n")
        now = written(found.select(*keys, *by, "_path", "_all", "_rank", (F.col("_at") + F.col("_before")).alias("_at"), "_n", "_lo", "_hi"), "ranks")
        sorted_out.append(now.filter("_lo = _hi"))
        left, values = now.filter("_lo < _hi"), cut.select(*names, "_v")
    for more in sorted_out:
        done = done.unionByName(more)
    own = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_m"), F.max("_all").alias("_all"), *(F.first(c).alias(c) for c in by))

    def level(q: float) -> Column:
        low, high = F.try_element_at("_m", F.floor(place(q))), F.try_element_at("_m", F.ceil(place(q)))
        part = place(q) - F.floor(place(q))
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    return own.select(*by, F.array(*(level(q) for q in levels)).alias("q"))


def _with_quantiles(df: DataFrame, value: str, levels: Sequence[float], by: Sequence[str], aggregates: list[Column], small: bool, accuracy: int | None = None) -> DataFrame:
    """Aggregates and ``q``: by one aggregate for small groups or a sketch, else by ``exact_quantiles``, for which ``df`` is written once, as the three passes read it."""
    if small or accuracy is not None:
        q = F.percentile(value, F.array(*(F.lit(q) for q in levels))) if accuracy is None else F.percentile_approx(value, list(levels), accuracy)
        return df.groupBy(*by).agg(*aggregates, q.alias("q"))
    df = written(df, "amounts")
    out, q = df.groupBy(*by).agg(*aggregates), exact_quantiles(df, value, levels, by)
    if not by:
        return out.crossJoin(F.broadcast(q))
    named = q.select(*(F.col(c).alias(f"_{c}") for c in by), "q")
    return out.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*(f"_{c}" for c in by))


def distribution(df: DataFrame, support: Column, value: str, by: Sequence[str] = (), levels: Sequence[float] = (0.9, 0.95, 0.99, 0.999), accuracy: int | None = None, small: bool = False) -> DataFrame:
    """n, mean, population deviation, maximum, wet share (> 0), exceedance shares and quantiles.

    Quantiles are exact, by ``exact_quantiles``; ``small`` says that groups are bounded (an hour, a sample), where one aggregate
    does; ``accuracy`` asks for Spark's sketch instead.
    """
    v, kind = F.col(value), dict(df.dtypes)[value]  # exceedance is told in the values' own type (Z-3)
    aggregates = [
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"),
        F.avg((v > 0).cast("double")).alias("wet_fraction"),
        *(F.avg((v > F.lit(t).cast(kind)).cast("double")).alias(f"fraction_gt_{str(t).replace('.', '_').removesuffix('_0')}") for t in EVENT_THRESHOLDS),
    ]
    out = _with_quantiles(df.filter(support).select(*by, value), value, levels, by, aggregates, small, accuracy)
    names = [f"p{str(round(100 * q, 3)).removesuffix('.0').replace('.', '_')}" for q in levels]
    return out.select(*(c for c in out.columns if c != "q"), *(F.col("q")[k].alias(n) for k, n in enumerate(names)))


def value_stats(df: DataFrame, value: str, by: Sequence[str] = (), small: bool = False) -> DataFrame:
    """Finite count, missing share, negatives, minimum, median, high quantiles, maximum (D12); ``small`` as in ``distribution``."""
    v = F.col(value)
    aggregates = [
        F.count(v).alias("finite"), ratio(F.count_if(v.isNull()), F.count("*")).alias("missing_fraction"), F.count_if(v < -1e-7).alias("negatives"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    ]
    out = _with_quantiles(df.select(*by, value), value, (0.5, 0.95, 0.99), by, aggregates, small)
    return out.select(*(c for c in out.columns if c != "q"), *(F.col("q")[k].alias(n) for k, n in enumerate(("median", "p95", "p99"))))


def masked_log_l1(df: DataFrame, support: Column, target: str, estimate: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error of log amounts on the support, over 1 cell at least."""
    e = F.when(support, F.abs(log_amount(F.col(estimate)) - log_amount(F.col(target))))
    return df.groupBy(*by).agg((F.coalesce(F.sum(e), F.lit(0.0)) / F.greatest(F.count(e), F.lit(1))).alias("loss"), F.count(e).alias("n"))


def deltas(metrics: DataFrame, key: str, base: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Scores of each method less those of a base method; NULL where either is."""
    reference = metrics.filter(F.col(key) == base).select(*by, *(F.col(n).alias(f"base_{n}") for n in names))
    rest = metrics.filter(F.col(key) != base)
    joined = rest.join(F.broadcast(reference), list(by)) if by else rest.crossJoin(F.broadcast(reference))
    return joined.select(*by, key, *((F.col(n) - F.col(f"base_{n}")).alias(f"delta_{n}") for n in names))


def mae_winner(a: Column, b: Column, name_a: str, name_b: str) -> Column:
    """The method with the smaller error, or that there is none."""
    return F.when(a < b, F.lit(name_a)).when(b < a, F.lit(name_b)).otherwise(F.lit("tie_or_unavailable"))


def stat_ranges(stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """Least and largest of each statistic over the hours looked at."""
    return stats.agg(*(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)))


def overall_metrics(df: DataFrame, support: Column, target: str, estimates: Sequence[str], time: str) -> DataFrame:
    """A row of point metrics for each method from one pass; fails if a method lacks a value on the support."""
    per = []
    for m in estimates:
        lost = F.count_if(F.col(m).isNull())
        n = F.when(lost > 0, F.raise_error(F.concat(lost.cast("string"), F.lit(f" non-finite values of {m} on common support"))).cast("long"))
        aggregates = point_aggregates(target, m)
        per.append(F.struct(F.lit(m).alias("method"), F.coalesce(n, F.count("*")).alias("n"), *aggregates[1:]))
    # hours by a set of times a task, not by a second copy of every row
    own = df.filter(support).agg(F.array(*per).alias("k"), F.size(F.collect_set(time)).cast("long").alias("valid_hours"))
    return own.select(F.inline("k"), "valid_hours").select("method", "n", "mae", "rmse", "bias", "valid_hours")


def validation_stats(df: DataFrame, support: Column, registry: str, target: str, estimate: str, epoch: str, threshold: float = 1.0, levels: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """For each epoch and bin of the truth: errors, statistics and exact percentiles of predictions, and CSI."""
    e = F.col(estimate).cast("double") - F.col(target).cast("double")
    own = df.filter(support).select(epoch, target, estimate, bin_of(registry, target).alias("bin_label"))
    aggregates = [
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.avg(estimate).alias("mean"), F.stddev_pop(estimate).alias("std"), F.max(estimate).alias("max"),
        *event_aggregates(target, estimate, threshold)[:4],
    ]
    out = _with_quantiles(own, estimate, levels, [epoch, "bin_label"], aggregates, False)
    names = [f"p{100 * q:g}" for q in levels]
    return out.select(*(c for c in out.columns if c != "q"), *(F.col("q")[k].alias(n) for k, n in enumerate(names)))


def loss_agrees(batches: DataFrame, loss: str, n: str, whole: DataFrame, metric: str, relative: float = 1e-5, absolute: float = 1e-7) -> DataFrame:
    """One row: the loss put together from batches, the metric of all cells, and whether they agree."""
    own = batches.agg((F.sum(F.col(loss) * F.col(n)) / F.greatest(F.sum(n), F.lit(1))).alias("loss"))
    both = own.crossJoin(F.broadcast(whole.select(F.col(metric).alias("metric"))))
    return both.withColumn("ok", F.coalesce(F.abs(F.col("loss") - F.col("metric")) <= absolute + relative * F.abs("metric"), F.lit(False)))


def early_stopping(losses: DataFrame, order: str, loss: str, patience: int) -> DataFrame:
    """For each epoch the best loss before it, whether it improved on that (strictly; a missing loss doesn't), epochs since the last that did, and whether to stop.

    One row an epoch goes through one window.
    """
    before, until = (Window.orderBy(order).rowsBetween(Window.unboundedPreceding, k) for k in (-1, 0))
    own = losses.select(order, loss, F.row_number().over(Window.orderBy(order)).alias("epoch"), F.min(loss).over(before).alias("best_before"))
    own = own.withColumn("improved", F.coalesce(F.col(loss) < F.coalesce("best_before", F.lit(float("inf"))), F.lit(False)))
    since = F.col("epoch") - F.coalesce(F.max(F.when(F.col("improved"), F.col("epoch"))).over(until), F.lit(0))
    return own.withColumn("epochs_since", since).withColumn("stop", F.col("epochs_since") >= patience)


def bin_counts(df: DataFrame, x: str, y: str, width_x: float, width_y: float) -> DataFrame:
    """Counts of pairs in cells of a plane (M2); pairs with a missing value are in none."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.floor(F.col(x) / width_x).alias("bin_x"), F.floor(F.col(y) / width_y).alias("bin_y")).agg(F.count("*").alias("n"))
