"""SQL (DuckDB) of the registered queries, written apart from the Spark code."""

from __future__ import annotations

from ..functions.bins import REGISTRIES
from ..functions.scalar import CENTRE, RADIUS, SCALE
from .views import FIELD_SQL, SIDE, grid_sql, series_sql

G = f"WITH {grid_sql(SIDE)}"


def R(*names: str, places: int = 6) -> str:
    """Rounded columns of their own names."""
    return ", ".join(f"round({n}, {places}) + 0.0 AS {n}" for n in names)


def hours(step: int) -> str:
    n = 3600 // step
    return f"""WITH {series_sql(step)},
h AS (SELECT t - t % 3600 + 3600 AS hour_end, CASE WHEN count(v) = {n} THEN sum(v) END AS amount, count(v) AS steps FROM s GROUP BY 1)"""


DAILY = f"""{hours(1800)},
dd AS (SELECT DATE '1970-01-01' + CAST(hour_end // 86400 AS INT) AS day, avg(amount) AS daily_mean, count(amount) AS valid_hours FROM h GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM dd),
daily AS (SELECT day, daily_mean, coalesce(valid_hours, 0) AS valid_hours FROM spine LEFT JOIN dd USING (day))"""

# The conditions of each bin, as SQL over the truth.
BIN_SQL = {
    "validation": ["truth < 0.1", "truth >= 0.1 AND truth < 1", "truth >= 1"],
    "diagnostics": ["truth = 0", "truth > 0 AND truth < 0.1", "truth >= 0.1 AND truth < 1", "truth >= 1 AND truth < 5", "truth >= 5"],
    "gap": ["truth < 0.1", "truth >= 0.1 AND truth < 1", "truth >= 1 AND truth < 5", "truth >= 5 AND truth <= 10", "truth > 10"],
    "heavy": ["truth < 0.1", "truth >= 0.1 AND truth < 1", "truth >= 1 AND truth < 5", "truth >= 5 AND truth < 10", "truth >= 10 AND truth <= 20", "truth > 20"],
}


def case(registry: str, value: str = "truth") -> str:
    return "CASE " + " ".join(f"WHEN {c.replace('truth', value)} THEN {k}" for k, c in enumerate(BIN_SQL[registry])) + " END"


LONG = "l AS (SELECT t, y, x, truth, 'est' AS method, est AS e FROM c UNION ALL SELECT t, y, x, truth, 'syn', syn FROM c)"


def strata(registry: str) -> str:
    labels = ", ".join(f"({k}, '{label}')" for k, (label, _) in enumerate(REGISTRIES[registry]))
    return f"""{G}, {LONG}, b(bin, bin_label) AS (VALUES {labels}), m(method) AS (VALUES ('est'), ('syn')),
a AS (SELECT {case(registry)} AS bin, method, count(*) AS n, avg(abs(e - truth)) AS mae, sqrt(avg((e - truth) ** 2)) AS rmse, avg(e - truth) AS bias FROM l GROUP BY 1, 2)
SELECT CAST(b.bin AS BIGINT) AS bin, bin_label, m.method, coalesce(n, 0) AS n, {R('mae', 'rmse', 'bias')}
FROM b CROSS JOIN m LEFT JOIN a ON a.bin = b.bin AND a.method = m.method"""


def events(by: str = "", thresholds: str = "(0.1), (1.0), (5.0)") -> str:
    key = f"{by}, " if by else ""
    return f"""{G}, {LONG}, th(threshold) AS (VALUES {thresholds}),
k AS (SELECT {key}method, CAST(threshold AS DOUBLE) AS threshold,
        count(*) FILTER (truth >= threshold AND e >= threshold) AS hits, count(*) FILTER (truth < threshold AND e >= threshold) AS false_alarms,
        count(*) FILTER (truth >= threshold AND e < threshold) AS misses FROM l CROSS JOIN th GROUP BY ALL),
z AS (SELECT *, hits / nullif(hits + false_alarms + misses, 0) AS csi, 1 - (false_alarms + misses) / nullif(2 * hits + false_alarms + misses, 0) AS fss FROM k)"""


POINT = f"""{G}, {LONG},
p AS (SELECT method, count(*) AS n, avg(abs(e - truth)) AS mae, sqrt(avg((e - truth) ** 2)) AS rmse, avg(e - truth) AS bias, count(DISTINCT t) AS valid_hours FROM l GROUP BY method)"""


def blocks(b: int) -> str:
    y0 = (SIDE - SIDE // b * b) // 2
    need = -int(-0.5 * b * b // 1)
    last = y0 + SIDE // b * b - 1
    return f"""SELECT {b} AS block, t, (y - {y0}) // {b} AS by, (x - {y0}) // {b} AS bx, CAST(CAST(avg(truth) AS FLOAT) AS DOUBLE) AS truth, CAST(CAST(avg(est) AS FLOAT) AS DOUBLE) AS est, count(*) / {float(b * b)} AS support_fraction
FROM c WHERE y BETWEEN {y0} AND {last} AND x BETWEEN {y0} AND {last} GROUP BY ALL HAVING count(*) >= {need}"""


SIZES = "(VALUES (1), (2), (3), (5)) sizes(block)"
BLOCKS = f"{G}, bl AS ({' UNION ALL '.join(blocks(b) for b in (1, 2, 3, 5))})"


def disk(r: int) -> str:
    cells = sum(1 for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r)
    return f"""SELECT {r} AS radius_cells, {cells} AS disk_cells, a.t, a.y, a.x, count(*) AS s, sum((b.truth >= 1)::INT) AS o, sum((b.est >= 1)::INT) AS f
FROM c a JOIN c b ON a.t = b.t AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= {r * r} GROUP BY ALL HAVING count(*) >= {-int(-0.5 * cells // 1)}"""


MAP = """fine AS (SELECT id // 15 AS y, id % 15 AS x, (id // 15) / 2.0 AS lat, (id % 15) / 2.0 AS lon FROM (SELECT unnest(range(225)) AS id)),
m0 AS (SELECT *, least(greatest(CAST(floor(lat) AS INT), 0), 6) AS i0, least(greatest(CAST(floor(lon) AS INT), 0), 6) AS j0 FROM fine WHERE lat BETWEEN 0.5 AND 7 AND lon BETWEEN 0 AND 6.5),
m AS (SELECT y, x, i0 + di AS i, j0 + dj AS j, (CASE di WHEN 0 THEN 1 - (lat - i0) ELSE lat - i0 END) * (CASE dj WHEN 0 THEN 1 - (lon - j0) ELSE lon - j0 END) AS w
      FROM m0 CROSS JOIN (VALUES (0), (1)) a(di) CROSS JOIN (VALUES (0), (1)) b(dj))"""

STARTS = "(VALUES (0), (2), (4), (6), (7))"
PATCHES = f"""pt AS (SELECT t, py AS patch_y, px AS patch_x, count(*) FILTER (available AND overlap AND truth IS NOT NULL AND est IS NOT NULL) AS value
  FROM g CROSS JOIN {STARTS} a(py) CROSS JOIN {STARTS} b(px) WHERE y >= py AND y < py + 5 AND x >= px AND x < px + 5 GROUP BY ALL)"""


def choice(epoch: int) -> str:
    key = f"md5(concat_ws(':', '{7 + epoch * 100000}', t, patch_y, patch_x))"
    return f"""SELECT {epoch} AS epoch, t, patch_y, patch_x, eligible FROM (
SELECT *, row_number() OVER (PARTITION BY t ORDER BY {key}, patch_y, patch_x) AS r, count(*) OVER (PARTITION BY t) AS eligible FROM pt WHERE value >= 13) WHERE r = 1"""


CHOICE = f"{G}, {PATCHES}, ch AS ({choice(0)} UNION ALL {choice(1)})"

SPLITS = f"""WITH {series_sql(1800)},
d AS (SELECT DISTINCT t, DATE '1970-01-01' + CAST(t // 86400 AS INT) AS date_utc FROM s),
k AS (SELECT date_utc, row_number() OVER (ORDER BY date_utc) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date_utc FROM d)),
sp AS (SELECT t, date_utc, CASE WHEN k <= floor(n * 0.70) THEN 'train' WHEN k <= floor(n * 0.70) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM d JOIN k USING (date_utc))"""

LEVELS = "list_transform(range(129), lambda q: q / 128.0)"
QMAP = f"""{G}, sm AS (SELECT est, truth FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY md5(concat_ws(':', '11', t, y, x)), y, x) AS r FROM c WHERE t % 4 <> 0) WHERE r <= 32),
tr AS (SELECT quantile_cont(est, [{', '.join(repr(k / 128) for k in range(129))}]) AS a, quantile_cont(truth, [{', '.join(repr(k / 128) for k in range(129))}]) AS b FROM sm),
pr AS (SELECT unnest(a) AS src, unnest(b) AS dst FROM tr),
kn AS (SELECT src, max(avg(greatest(dst, 0))) OVER (ORDER BY src) AS dst FROM pr GROUP BY src),
br AS (SELECT src AS x0, dst AS y0, lead(src) OVER (ORDER BY src) AS x1, lead(dst) OVER (ORDER BY src) AS y1, min(src) OVER () AS lo, arg_min(dst, src) OVER () AS dlo FROM kn),
mp AS (SELECT c.t, c.y, c.x, c.truth, c.est,
  greatest(CASE WHEN est <= (SELECT min(src) FROM kn) THEN (SELECT arg_min(dst, src) FROM kn) WHEN est >= (SELECT max(src) FROM kn) THEN (SELECT arg_max(dst, src) FROM kn)
           ELSE (SELECT y0 + (c.est - x0) * (y1 - y0) / (x1 - x0) FROM br WHERE c.est >= x0 AND c.est < x1) END, 0.0) AS mapped FROM c WHERE t % 4 = 0)"""

ORDER_HOURS = "oh AS (SELECT DISTINCT CAST(floor(epoch(o_orderdate) / 3600) AS BIGINT) * 3600 AS t FROM orders), om AS (SELECT t, strftime(make_timestamp(t * 1000000), '%Y_%m') AS month, CAST(make_timestamp(t * 1000000) AS DATE) AS day FROM oh)"

HISTOGRAM = f"""{G}, l AS (SELECT 'truth' AS method, truth AS v FROM c UNION ALL SELECT 'est', est FROM c),
e AS (SELECT k, 0.001 * pow(300 / 0.001, k / 120.0) AS lo, CASE WHEN k < 120 THEN 0.001 * pow(300 / 0.001, (k + 1) / 120.0) ELSE 'infinity'::DOUBLE END AS hi FROM (SELECT unnest(range(121)) AS k)),
b AS (SELECT method, CASE WHEN v = 0 THEN -2 WHEN v > 0 AND v < 0.001 THEN -1 ELSE (SELECT k FROM e WHERE v >= lo AND v < hi) END AS bin FROM l),
sp AS (SELECT method, bin FROM (SELECT DISTINCT method FROM l) CROSS JOIN (SELECT unnest(range(-2, 121)) AS bin)),
n AS (SELECT method, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT sp.method, sp.bin, coalesce(n.n, 0) AS n FROM sp LEFT JOIN n ON n.method = sp.method AND n.bin = sp.bin"""

ORACLES: dict[str, str] = {
    "strict_hourly_sum": f"{hours(300)} SELECT hour_end, {R('amount')}, steps FROM h",
    "strict_half_hours": f"{hours(1800)} SELECT hour_end, {R('amount')}, steps FROM h",
    "daily_mean_of_hourly_means": f"{DAILY} SELECT day, {R('daily_mean')}, valid_hours FROM daily",
    "centred_rolling_mean": f"""{DAILY} SELECT day, {R('daily_mean')}, valid_hours,
CASE WHEN count(daily_mean) OVER w = 7 THEN round(avg(daily_mean) OVER w, 6) END AS centred_mean FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    "cadence_gaps": f"""WITH {series_sql(300)}, m AS (SELECT strftime(make_timestamp(t * 1000000), '%Y_%m') AS month, t FROM s),
q AS (SELECT month, t, t - lag(t) OVER (PARTITION BY month ORDER BY CASE WHEN t // 300 % 50 = 0 THEN t + 4600 ELSE t END) AS gap FROM m) SELECT month, t, gap FROM q WHERE gap <> 300""",
    "missing_steps": f"WITH {series_sql(300)} SELECT unnest(range(min(t), max(t) + 300, 300)) AS t FROM s EXCEPT SELECT t FROM s",
    "time_axis_parity": f"""WITH {series_sql(300)}, b AS (SELECT t FROM s WHERE v < 250)
SELECT (SELECT count(*) FROM (SELECT t FROM s EXCEPT SELECT t FROM b)) AS only_a, (SELECT count(*) FROM (SELECT t FROM b EXCEPT SELECT t FROM s)) AS only_b""",
    "hourly_area_means": f"{G}, a AS (SELECT t, avg(est) AS mean_a, avg(truth) AS mean_b, count(*) AS cells FROM g WHERE est IS NOT NULL AND truth IS NOT NULL GROUP BY t) SELECT t, {R('mean_a', 'mean_b', places=9)}, cells FROM a",
    "support_counts": f"""{G}, a AS (SELECT count(*) FILTER (overlap) AS overlap_cells, count(*) FILTER (overlap AND truth IS NOT NULL) AS target_cells,
(SELECT count(*) FROM c) AS support_cells, count(*) FILTER (truth IS NOT NULL AND est IS NOT NULL) AS pair_cells FROM g)
SELECT *, round(support_cells / target_cells, 6) AS support_fraction FROM a""",
    "mask_digests": f"""{G}, r AS (SELECT t, y, string_agg(x, ',' ORDER BY x) AS row FROM (SELECT DISTINCT t, y, x FROM c) GROUP BY t, y)
SELECT t, sha256(string_agg(y || ':' || row, ';' ORDER BY y)) AS mask_digest FROM r GROUP BY t""",
    "point_metrics_overall": f"{POINT} SELECT method, n, {R('mae', 'rmse', 'bias')}, valid_hours FROM p",
    "point_metrics_by_time": f"{G}, a AS (SELECT t, count(*) AS n, avg(abs(est - truth)) AS mae, sqrt(avg((est - truth) ** 2)) AS rmse, avg(est - truth) AS bias FROM c GROUP BY t) SELECT t, n, {R('mae', 'rmse', 'bias', places=9)} FROM a",
    "csi_by_threshold": f"{events()} SELECT method, {R('threshold')}, hits, false_alarms, misses, {R('csi')} FROM z",
    "fss_one_cell": f"{events()} SELECT method, {R('threshold')}, {R('fss')} FROM z",
    "event_scores_by_time": f"{events('t', '(1.0)')} SELECT t, hits, false_alarms, misses, {R('csi')} FROM z WHERE method = 'est'",
    **{f"strata_{r}": strata(r) for r in BIN_SQL},
    "distribution_summary": f"""{G}, l AS (SELECT 'truth' AS method, truth AS v FROM c UNION ALL SELECT 'est', est FROM c UNION ALL SELECT 'syn', syn FROM c)
SELECT method, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(max(v), 6) AS max, round(avg((v > 0)::INT), 6) AS wet_fraction,
round(avg((v > 0.1)::INT), 6) AS fraction_gt_0_1, round(avg((v > 1)::INT), 6) AS fraction_gt_1, round(avg((v > 5)::INT), 6) AS fraction_gt_5,
round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(quantile_cont(v, 0.999), 6) AS p99_9 FROM l GROUP BY method""",
    "value_stats": f"""WITH {FIELD_SQL} SELECT count(v) AS finite, round(count(*) FILTER (v IS NULL) / count(*), 6) AS missing_fraction, count(*) FILTER (v < -1e-7) AS negatives, round(min(v), 6) AS min,
round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS max FROM f""",
    "stat_ranges": f"""{G}, a AS (SELECT t, count(est) AS finite, count(*) FILTER (est IS NULL) / count(*) AS missing_fraction, max(est) AS max FROM g GROUP BY t)
SELECT min(finite) AS min_finite, max(finite) AS max_finite, round(min(missing_fraction), 6) AS min_missing_fraction, round(max(missing_fraction), 6) AS max_missing_fraction, round(min(max), 6) AS min_max, round(max(max), 6) AS max_max FROM a""",
    "log_histogram": HISTOGRAM,
    "bin_cells": f"""{G}, l AS (SELECT 'truth' AS method, truth AS v FROM g WHERE truth IS NOT NULL AND est IS NOT NULL UNION ALL SELECT 'est', est FROM g WHERE truth IS NOT NULL AND est IS NOT NULL),
b(bin, bin_label) AS (VALUES {", ".join(f"({k}, '{label}')" for k, (label, _) in enumerate(REGISTRIES["heavy"]))}),
tot AS (SELECT method, count(*) AS cells, count(*) FILTER (v < 0) AS negatives, max(v) AS max FROM l GROUP BY method), n AS (SELECT method, {case("heavy", "v")} AS bin, count(*) AS n FROM l GROUP BY ALL)
SELECT tot.method, CAST(b.bin AS BIGINT) AS bin, bin_label, coalesce(n.n, 0) AS n, cells, negatives, round(max, 6) AS max, round(coalesce(n.n, 0) / cells, 6) AS fraction
FROM tot CROSS JOIN b LEFT JOIN n ON n.method = tot.method AND n.bin = b.bin""",
    "hourly_maxima": f"{G} SELECT t, count(*) FILTER (truth IS NOT NULL AND est IS NOT NULL) AS cells, round(max(est) FILTER (truth IS NOT NULL AND est IS NOT NULL), 6) AS max_est, round(max(truth) FILTER (truth IS NOT NULL AND est IS NOT NULL), 6) AS max_truth FROM g GROUP BY t",
    "exceedance_hours": f"""{G}, m AS (SELECT t, max(est) AS e, max(truth) AS r FROM g WHERE truth IS NOT NULL AND est IS NOT NULL GROUP BY t), l AS (SELECT 'est' AS product, e AS m FROM m UNION ALL SELECT 'truth', r FROM m)
SELECT product, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (m > threshold) AS hours FROM l CROSS JOIN (VALUES (1.0), (5.0), (10.0), (20.0), (50.0)) th(threshold) GROUP BY ALL""",
    "masked_log_l1": f"{G} SELECT round(sum(abs(ln(1 + greatest(est, 0)) - ln(1 + greatest(truth, 0)))) / greatest(count(*), 1), 6) AS loss, count(*) AS n FROM c",
    "method_deltas": f"{POINT}, q AS (SELECT method, {R('mae', 'rmse', 'bias')} FROM p) SELECT a.method, round(a.mae - b.mae, 6) + 0.0 AS delta_mae, round(a.rmse - b.rmse, 6) + 0.0 AS delta_rmse, round(a.bias - b.bias, 6) + 0.0 AS delta_bias FROM q a JOIN q b ON b.method = 'est' AND a.method <> 'est'",
    "mae_winner": f"""{G}, a AS (SELECT t, round(avg(abs(est - truth)), 9) AS a, round(avg(abs(syn - truth)), 9) AS b FROM c GROUP BY t)
SELECT CASE WHEN a < b THEN 'est' WHEN b < a THEN 'syn' ELSE 'tie_or_unavailable' END AS winner, count(*) AS hours FROM a GROUP BY 1""",
    "block_metrics_multiscale": f"""{BLOCKS}, a AS (SELECT block, count(*) AS n, avg(abs(est - truth)) AS mae, sqrt(avg((est - truth) ** 2)) AS rmse, avg(est - truth) AS bias, count(DISTINCT t) AS valid_hours,
count(*) FILTER (truth >= 1 AND est >= 1) AS hits, count(*) FILTER (truth < 1 AND est >= 1) AS false_alarms, count(*) FILTER (truth >= 1 AND est < 1) AS misses FROM bl GROUP BY block)
SELECT coalesce(n, 0) AS n, {R('mae', 'rmse', 'bias')}, coalesce(valid_hours, 0) AS valid_hours, coalesce(hits, 0) AS hits, coalesce(false_alarms, 0) AS false_alarms, coalesce(misses, 0) AS misses, round(hits / nullif(hits + false_alarms + misses, 0), 6) AS csi,
round(1 - (false_alarms + misses) / nullif(2 * hits + false_alarms + misses, 0), 6) AS fss, CAST(block AS BIGINT) AS block FROM {SIZES} LEFT JOIN a USING (block)""",
    "block_coverage": f"""{BLOCKS}, p AS (SELECT count(DISTINCT t) AS times FROM g), a AS (SELECT block, count(*) AS valid_cells, avg(support_fraction) AS mean_support FROM bl GROUP BY block)
SELECT coalesce(valid_cells, 0) AS valid_cells, round(mean_support, 6) AS mean_support, times * (12 // block) * (12 // block) AS possible_cells, round(coalesce(valid_cells, 0) / (times * (12 // block) * (12 // block)), 6) AS valid_cells_fraction, CAST(block AS BIGINT) AS block FROM {SIZES} LEFT JOIN a USING (block) CROSS JOIN p""",
    "disk_neighbourhood_scores": f"""{G}, k AS ({' UNION ALL '.join(disk(r) for r in (1, 2, 3))}), z AS (SELECT *, o / s AS fo, f / s AS ff FROM k),
rc(radius_cells, disk_cells) AS (VALUES (1, 5), (2, 13), (3, 29)), a AS (SELECT radius_cells, count(*) AS valid_centers, count(DISTINCT t) AS valid_hours, sum(fo * ff) AS h, sum(ff * (1 - fo)) AS fa, sum((1 - ff) * fo) AS mi, sum((ff - fo) ** 2) AS num, sum(ff * ff + fo * fo) AS den FROM z GROUP BY ALL)
SELECT CAST(radius_cells AS BIGINT) AS radius_cells, CAST(disk_cells AS BIGINT) AS disk_cells, 1.0::DOUBLE AS threshold, coalesce(valid_centers, 0) AS valid_centers, coalesce(valid_hours, 0) AS valid_hours, round(h, 6) AS fractional_hits, round(fa, 6) AS fractional_false_alarms, round(mi, 6) AS fractional_misses,
round(h / nullif(h + fa + mi, 0), 6) AS neighborhood_csi_fractional, round(1 - num / nullif(den, 0), 6) AS fss FROM rc LEFT JOIN a USING (radius_cells)""",
    "regrid_bilinear": f"WITH {FIELD_SQL}, {MAP} SELECT t, y, x, round(CASE WHEN count(w * v) = 4 THEN sum(w * v) END, 6) + 0.0 AS v FROM f JOIN m USING (i, j) GROUP BY t, y, x",
    "regrid_mask": f"WITH {FIELD_SQL}, {MAP}, a AS (SELECT t, y, x, count(v) = 4 AS valid FROM f JOIN m USING (i, j) GROUP BY t, y, x) SELECT t, count(*) FILTER (valid) AS valid_cells, count(*) AS cells FROM a GROUP BY t",
    "regrid_area_average": f"""WITH {FIELD_SQL}, ax AS (SELECT a, b, least(a + 1, (b + 1) * 8 / 3.0) - greatest(a, b * 8 / 3.0) AS w FROM (SELECT unnest(range(8)) AS a) CROSS JOIN (SELECT unnest(range(3)) AS b)),
wt AS (SELECT a, b, w FROM ax WHERE w > 1e-12),
z AS (SELECT t, p.b AS i, q.b AS j, sum(p.w * q.w * v) / sum(CASE WHEN v IS NOT NULL THEN p.w * q.w END) AS mean, coalesce(sum(CASE WHEN v IS NOT NULL THEN p.w * q.w END), 0) / sum(p.w * q.w) AS s FROM f JOIN wt p ON p.a = f.i JOIN wt q ON q.a = f.j GROUP BY ALL)
SELECT t, i, j, CASE WHEN s >= 0.95 THEN round(mean, 6) + 0.0 END AS v, round(s, 6) AS source_valid_fraction FROM z""",
    "patch_eligibility": f"{G}, {PATCHES} SELECT t, CAST(patch_y AS BIGINT) AS patch_y, CAST(patch_x AS BIGINT) AS patch_x, value FROM pt WHERE value >= 13",
    "patch_prefix_sums": f"{G}, {PATCHES} SELECT t, CAST(patch_y AS BIGINT) AS patch_y, CAST(patch_x AS BIGINT) AS patch_x, value FROM pt WHERE value > 0",
    "patch_choice": f"{CHOICE} SELECT CAST(epoch AS BIGINT) AS epoch, t, CAST(patch_y AS BIGINT) AS patch_y, CAST(patch_x AS BIGINT) AS patch_x, eligible FROM ch",
    "patch_exceedance": f"""{CHOICE}, mx AS (SELECT epoch, ch.t, max(truth) AS m FROM ch LEFT JOIN c ON c.t = ch.t AND c.y >= patch_y AND c.y < patch_y + 5 AND c.x >= patch_x AND c.x < patch_x + 5 GROUP BY ALL)
SELECT coalesce(CAST(epoch AS VARCHAR), 'all') AS epoch, count(*) AS eligible_patches, count(*) FILTER (m > 1) AS max_gt_1, count(*) FILTER (m > 5) AS max_gt_5, count(*) FILTER (m > 10) AS max_gt_10 FROM mx GROUP BY ROLLUP (epoch) HAVING count(*) > 0""",
    "pixel_sample": f"""{G}, r AS (SELECT t, y, x, truth, row_number() OVER (PARTITION BY t ORDER BY md5(concat_ws(':', '3', t, y, x)), y, x) AS r, count(*) OVER (PARTITION BY t) AS n FROM c)
SELECT t, y, x, round(truth, 6) AS truth FROM r WHERE r <= least(n, 16, greatest(4, n // 5))""",
    "qc_sample": f"""WITH {ORDER_HOURS}, h AS (SELECT month, t, md5(concat_ws(':', '20260927', t)) AS h FROM om), f AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY h, t) = 1 AS picked FROM h)
SELECT month, t, CASE WHEN picked THEN 'month' ELSE 'fill' END AS reason FROM f ORDER BY NOT picked, h, t LIMIT 100""",
    "epoch_order": f"WITH {series_sql(1800)} SELECT t FROM s ORDER BY md5(concat_ws(':', '1007', t)), t",
    "epoch_order_all": f"WITH {series_sql(1800)} SELECT row_number() OVER (ORDER BY md5(concat_ws(':', '1007', t)), t) - 1 AS place, t FROM s",
    "chronological_splits": f"{SPLITS} SELECT t, date_utc, split FROM sp",
    "split_checks": f"""{SPLITS} SELECT split, count(*) AS hours, count(DISTINCT date_utc) AS days, min(t) AS first, max(t) AS last,
(SELECT count(*) FROM (SELECT date_utc FROM sp GROUP BY date_utc HAVING count(DISTINCT split) > 1)) AS shared_days FROM sp GROUP BY split""",
    "split_filter": f"{SPLITS} SELECT count(*) AS steps, round(sum(v), 6) AS total FROM s WHERE t IN (SELECT t FROM sp WHERE split = 'test')",
    "split_classify": f"""WITH {series_sql(1800)}, d AS (SELECT DISTINCT t, DATE '1970-01-01' + CAST(t // 86400 AS INT) AS date_utc FROM s WHERE t % 7200 = 0),
k AS (SELECT date_utc, row_number() OVER (ORDER BY date_utc) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date_utc FROM d)),
sp AS (SELECT t, CASE WHEN k <= floor(n * 0.70) THEN 'train' WHEN k <= floor(n * 0.70) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM d JOIN k USING (date_utc))
SELECT coalesce(split, 'unclassified') AS split, count(*) AS steps FROM s LEFT JOIN sp USING (t) GROUP BY 1""",
    "quantile_map_fit": f"{QMAP} SELECT round(src, 6) AS src, round(dst, 6) AS dst FROM kn",
    "quantile_map_apply": f"{QMAP} SELECT t, y, x, round(mapped, 6) AS mapped FROM mp",
    "quantile_map_delta": f"{QMAP} SELECT round(avg(abs(mapped - truth)) - avg(abs(est - truth)), 6) AS delta_mae, round(avg(mapped - truth), 6) AS bias_mapped FROM mp",
    "typical_hours": f"""{G}, st AS (SELECT t, count(*) AS cells, max(truth) AS m, avg((truth > 0.1)::INT) AS wet FROM c GROUP BY t), w AS (SELECT * FROM st WHERE m > 0),
q AS (SELECT quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.5) AS b, quantile_cont(m, 0.9) AS d FROM w),
p AS (SELECT 0 AS place, CASE WHEN EXISTS (SELECT 1 FROM st WHERE m <= 0) THEN 'dry' ELSE 'driest_available' END AS label, coalesce((SELECT t FROM st WHERE m <= 0 ORDER BY cells DESC, t LIMIT 1), (SELECT t FROM st ORDER BY wet, t LIMIT 1)) AS t
UNION ALL SELECT 1, 'wet_p25', (SELECT t FROM w, q ORDER BY abs(m - a), t LIMIT 1) UNION ALL SELECT 2, 'wet_p50', (SELECT t FROM w, q ORDER BY abs(m - b), t LIMIT 1)
UNION ALL SELECT 3, 'wet_p90', (SELECT t FROM w, q ORDER BY abs(m - d), t LIMIT 1) UNION ALL SELECT 4, 'peak', (SELECT t FROM w ORDER BY m DESC, t LIMIT 1))
SELECT t, string_agg(label, '+' ORDER BY place) AS labels FROM p GROUP BY t""",
    "preview_hour": f"{G}, a AS (SELECT t, round(sum(truth), 6) AS total FROM g GROUP BY t) SELECT t, total FROM a ORDER BY total DESC, t LIMIT 1",
    "first_per_month": f"WITH {ORDER_HOURS} SELECT month, min(t) AS t FROM om GROUP BY month",
    "month_counts": f"""WITH {ORDER_HOURS} SELECT month, count(DISTINCT day) AS days, count(*) AS hours, min(t) AS first, max(t) AS last, max(CAST(day(last_day(day)) AS BIGINT)) AS days_in_month,
count(DISTINCT day) = max(day(last_day(day))) AS complete FROM om GROUP BY month""",
    "projection_inverse": """WITH p AS (SELECT p_partkey, (p_partkey % 900 - 450) * 1000.0::DOUBLE AS px, -(p_partkey % 1100) * 1000.0::DOUBLE - 3600000 AS py FROM part),
q AS (SELECT p_partkey, 10 + degrees(atan2(px, -py)) AS lon, 90 - 2 * degrees(atan(sqrt(px * px + py * py) / (2 * 6370040::DOUBLE * 0.9330127019::DOUBLE))) AS lat FROM p)
SELECT p_partkey, round(lon, 6) + 0.0 AS lon, round(lat, 6) AS lat, round(((lon + 350 + 180) - 360 * floor((lon + 350 + 180) / 360)) - 180, 6) + 0.0 AS wrapped FROM q""",
    "unit_scale": """WITH p AS (SELECT (p_partkey % 900 - 450)::DOUBLE AS px, -(p_partkey % 1100)::DOUBLE - 3600 AS py FROM part),
inv AS (SELECT px, py, s, 10 + degrees(atan2(px * s, -py * s)) AS lon, 90 - 2 * degrees(atan(sqrt(px * px + py * py) * s / (2 * 6370040::DOUBLE * 0.9330127019::DOUBLE))) AS lat FROM p CROSS JOIN (VALUES (1.0::DOUBLE), (1000.0::DOUBLE)) k(s)),
e AS (SELECT a.s, sqrt(pow((((a.lon - b.lon - 0.001) + 180) - 360 * floor(((a.lon - b.lon - 0.001) + 180) / 360) - 180) * cos(radians(b.lat)), 2) + pow(a.lat - b.lat, 2)) AS err
      FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY px, py) AS r FROM inv) a JOIN (SELECT *, row_number() OVER (PARTITION BY s ORDER BY px, py) AS r FROM inv) b ON a.r = b.r AND b.s = 1000),
g AS (SELECT s, quantile_cont(err, 0.5) AS m, max(err) AS x FROM e GROUP BY s)
SELECT s AS scale, round(m, 6) AS median_error, round(x, 6) AS max_error, m <= 0.02 AND x <= 0.05 AS accepted FROM g ORDER BY m, s LIMIT 1""",
    "normalised_field": f"""WITH {FIELD_SQL}, n AS (SELECT t AS time, 7 - i AS lat_idx, j AS lon_idx, CASE WHEN j % 2 = 0 THEN v * 1000 ELSE v END AS v, i * 0.25 AS lat, j * 0.25 AS lon FROM f),
b AS (SELECT min(lat_idx) AS y0, max(lat_idx) AS y1, min(lon_idx) AS x0, max(lon_idx) AS x1 FROM n WHERE lat BETWEEN 0.25 AND 1.5 AND lon BETWEEN 0.5 AND 1.75)
SELECT time, lat_idx, lon_idx, CASE WHEN v IS NOT NULL THEN round(greatest(v, 0), 6) + 0.0 END AS v FROM n, b WHERE lat_idx BETWEEN y0 AND y1 AND lon_idx BETWEEN x0 AND x1 AND lat_idx % 2 = 0 AND lon_idx % 2 = 0""",
    "scalar_functions": """SELECT o_orderkey, round(ln(1 + greatest(o_totalprice - 1000, 0)), 6) AS logged, round(greatest(exp(o_totalprice / 100000) - 1, 0), 6) AS back,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso_z, strftime(o_orderdate, '%Y_%m') AS month, CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS member_day,
lower(trim(o_orderpriority || '-2')) AS unit, regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, 'CRS["' || o_orderstatus || '",LENGTHUNIT["metre",1]]' AS wkt FROM orders""",
    "disk_kernel": "SELECT r AS radius, count(*) AS cells FROM (SELECT DISTINCT CAST(p_size % 26 AS BIGINT) AS r FROM part), (SELECT unnest(range(-25, 26)) AS dy), (SELECT unnest(range(-25, 26)) AS dx) WHERE dy * dy + dx * dx <= r * r GROUP BY r",
    "geometric_edges": """SELECT amount, k, round(0.001 * pow(300 / 0.001, k / 120.0), 6) AS low, round(0.001 * pow(300 / 0.001, (k + 1) / 120.0), 6) AS high
FROM (SELECT amount, CAST(floor(120 * ln(amount / 0.001) / ln(300 / 0.001)) AS BIGINT) AS k FROM (SELECT DISTINCT l_quantity AS amount FROM lineitem))""",
    "packed_mask_digests": f"""{G}, b AS (
  SELECT tt.t, k // 8 AS place, sum(CASE WHEN c.t IS NOT NULL THEN CAST(pow(2, 7 - k % 8) AS INT) ELSE 0 END) AS byte
  FROM (SELECT DISTINCT t FROM c) tt CROSS JOIN (SELECT unnest(range({SIDE * SIDE})) AS k) LEFT JOIN c ON c.t = tt.t AND c.y * {SIDE} + c.x = k GROUP BY ALL)
SELECT t, sha256(unhex(list_aggregate(list_transform(range(0, 8), lambda i: printf('%02x', CAST((t >> CAST(8 * i AS BIGINT)) & 255 AS INT))), 'string_agg', '') || '{SIDE:02x}00000000000000{SIDE:02x}00000000000000' || string_agg(printf('%02x', CAST(byte AS INT)), '' ORDER BY place))) AS mask_digest FROM b GROUP BY t""",
    "fields_by_time": f"{G} SELECT t, count(*) AS cells, round(sum(truth), 6) AS truth, round(sum(est), 6) AS est, round(sum(syn), 6) AS syn FROM g GROUP BY t",
    "split_months": f"""{G}, d AS (SELECT DISTINCT t, DATE '1970-01-01' + CAST(t * 7 AS INT) AS day FROM g),
k AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM d)),
sp AS (SELECT t, day FROM d JOIN k USING (day) WHERE k > floor(n * 0.70) + floor(n * 0.15))
SELECT strftime(day, '%Y_%m') AS month, count(*) AS cells, round(sum(truth), 6) AS truth FROM g JOIN sp USING (t) GROUP BY 1""",
    "regrid_beyond": f"""WITH {FIELD_SQL}, whole AS (SELECT t, i, j, CASE WHEN i + j < 14 THEN v END AS v FROM f),
fine AS (SELECT y, x, y - 1.25 AS lat, x - 1.5 AS lon FROM (SELECT unnest(range(10)) AS y), (SELECT unnest(range(10)) AS x)),
m AS (SELECT *, least(CAST(floor(lat) AS INT), 6) AS i, least(CAST(floor(lon) AS INT), 6) AS j FROM fine WHERE lat BETWEEN 0 AND 7 AND lon BETWEEN 0 AND 7)
SELECT a.t, m.y, m.x, round((1 - (lat - m.i)) * ((1 - (lon - m.j)) * a.v + (lon - m.j) * b.v) + (lat - m.i) * ((1 - (lon - m.j)) * c.v + (lon - m.j) * e.v), 6) + 0.0 AS v
FROM m JOIN whole a ON a.i = m.i AND a.j = m.j JOIN whole b ON b.t = a.t AND b.i = m.i AND b.j = m.j + 1 JOIN whole c ON c.t = a.t AND c.i = m.i + 1 AND c.j = m.j JOIN whole e ON e.t = a.t AND e.i = m.i + 1 AND e.j = m.j + 1""",
    "contract_report": f"""{G}, {series_sql(300)}, {series_sql(1800).replace('s AS', 's2 AS')}, dy AS (SELECT DISTINCT DATE '1970-01-01' + CAST(t // 86400 AS INT) AS day FROM s2),
dk AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM dy),
sp AS (SELECT DISTINCT t, CASE WHEN k <= floor(n * 0.70) THEN 'train' WHEN k <= floor(n * 0.70) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM s2 JOIN dk ON dk.day = DATE '1970-01-01' + CAST(t // 86400 AS INT)),
a AS (SELECT 'L3 unique times' AS contract, 0 AS expected, (SELECT count(t) - count(DISTINCT t) FROM s) AS found
UNION ALL SELECT 'L3 all steps there', (SELECT (max(t) - min(t)) / 300 + 1 FROM s), (SELECT count(DISTINCT t) FROM s) UNION ALL SELECT 'L3 times lie on the step', 0, (SELECT count(*) FROM s WHERE t % 300 <> 0)
UNION ALL SELECT 'L8 no negative truth', 0, (SELECT count(*) FROM g WHERE truth < -1e-7) UNION ALL SELECT 'L4 equal grids', 0, (SELECT count(*) FROM (SELECT DISTINCT y, x FROM g) WHERE abs((y / 4.0 + 1e-9) - y / 4.0) > 1e-8) UNION ALL SELECT 'L2 required columns', 0, 1
UNION ALL SELECT 'L6 shared denominator', 0, (SELECT count(est) - count(syn) FROM c) UNION ALL SELECT 'L10 hours in all splits', (SELECT count(DISTINCT t) FROM s2), (SELECT sum(hours) FROM (SELECT split, count(*) AS hours FROM sp GROUP BY split))
UNION ALL SELECT 'L11 missing days', 0, (SELECT count(*) FROM dy WHERE day(day) = 13) UNION ALL SELECT 'L11 unexpected days', 0, 0 UNION ALL SELECT 'L11 repeated days', 0, 0)
SELECT contract, CAST(expected AS DOUBLE) AS expected, CAST(found AS DOUBLE) AS found, expected = found AS ok FROM a""",
    "coverage_filter": f"{G}, a AS (SELECT t, avg(est) AS v, round(count(est) / count(*), 9) AS fraction FROM g GROUP BY t) SELECT t, CASE WHEN fraction >= 0.9 THEN round(v, 9) END AS v FROM a",
    "tiled_inference": f"""WITH {FIELD_SQL}, z AS (SELECT a.t, a.i AS y, a.j AS x, sum(CAST(coalesce(b.v, 0) AS FLOAT)::DOUBLE) / 9 AS p FROM f a JOIN f b ON a.t = b.t AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY ALL)
SELECT t, y, x, round(greatest(p, 0), 6) AS prediction FROM z""",
    "stream_hourly_sum": f"{hours(1800)} SELECT hour_end, {R('amount')}, steps FROM h WHERE steps = 2",
    "float_thresholds": f"""{G}, v AS (SELECT CAST(est / 10 AS FLOAT) AS v FROM c)
SELECT count(*) AS n, round(avg((v > CAST(0.1 AS FLOAT))::INT), 6) AS fraction_gt_0_1, round(avg((v > CAST(1 AS FLOAT))::INT), 6) AS fraction_gt_1, round(avg((v > CAST(5 AS FLOAT))::INT), 6) AS fraction_gt_5 FROM v""",
    "axis_steps": f"""{G}, ay AS (SELECT y, 50 + y * 0.25::DOUBLE + (y % 5) * 0.01::DOUBLE AS p FROM (SELECT DISTINCT y FROM g)), ax AS (SELECT x, 2 + x * 0.4::DOUBLE AS p FROM (SELECT DISTINCT x FROM g))
SELECT 'lat' AS axis, round(median(d), 6) AS step FROM (SELECT p - lag(p) OVER (ORDER BY y) AS d FROM ay) UNION ALL SELECT 'lon', round(median(d), 6) FROM (SELECT p - lag(p) OVER (ORDER BY x) AS d FROM ax)""",
    "axis_lookup": """WITH a AS (SELECT n_nationkey AS k, n_nationkey * n_nationkey / 40.0::DOUBLE AS p FROM nation), n AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, p, lead(p) OVER (ORDER BY k) AS nxt, count(*) OVER () AS c FROM a),
v AS (SELECT p_partkey, p_partkey % 1700 / 100.0::DOUBLE - 1 AS v FROM part), w AS (SELECT p_partkey, v, greatest(0, least((SELECT count(*) FROM a) - 2, (SELECT count(*) FROM a WHERE a.p <= v.v) - 1)) AS place FROM v)
SELECT p_partkey, place, round((v - p) / (nxt - p), 6) + 0.0 AS beyond FROM w JOIN n ON n.i = place""",
    "field_reader": f"{G} SELECT t, count(*) AS cells, round(sum(truth), 6) AS truth, round(sum(est), 6) AS est, round(sum(syn), 6) AS syn FROM g GROUP BY t",
    "split_coverage": f"""WITH {series_sql(1800)}, d AS (SELECT DISTINCT t, DATE '1970-01-01' + CAST(t // 86400 AS INT) AS date_utc FROM s WHERE t % 12600 <> 0),
k AS (SELECT date_utc, row_number() OVER (ORDER BY date_utc) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date_utc FROM d)),
sp AS (SELECT t, CASE WHEN k <= floor(n * 0.70) THEN 'train' WHEN k <= floor(n * 0.70) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM d JOIN k USING (date_utc)),
f AS (SELECT DISTINCT t FROM s WHERE v IS NOT NULL)
SELECT split, count(*) AS expected, count(f.t) AS found, count(*) - count(f.t) AS missing, 0 AS unexpected FROM sp LEFT JOIN f ON f.t = sp.t GROUP BY split
UNION ALL SELECT 'unclassified', 0, count(*), 0, count(*) FROM (SELECT t FROM f EXCEPT SELECT t FROM sp) HAVING count(*) > 0""",
    "preflight": f"""{G}, w AS (SELECT strftime(make_timestamp(t * 604800 * 1000000), '%Y_%m') AS month, min(t) AS t FROM (SELECT DISTINCT t FROM g) GROUP BY 1)
SELECT month, w.t, count(est) AS cells, count(est) > 0 AS ok FROM w JOIN g ON g.t = w.t GROUP BY month, w.t""",
    "loss_agrees": f"""{G}, a AS (SELECT t, abs(ln(1 + greatest(est, 0)) - ln(1 + greatest(truth, 0))) AS e FROM c), b AS (SELECT t, avg(e) AS loss, count(*) AS n FROM a GROUP BY t), z AS (SELECT sum(loss * n) / sum(n) AS loss FROM b), m AS (SELECT avg(e) AS metric FROM a)
SELECT round(loss, 6) AS loss, round(metric, 6) AS metric, abs(loss - metric) <= 1e-7 + 1e-5 * abs(metric) AS ok FROM z, m""",
    "early_stopping": f"""{G}, a AS (SELECT t, round(coalesce(sum(abs(ln(1 + greatest(est, 0)) - ln(1 + greatest(truth, 0)))) FILTER (available AND overlap AND truth IS NOT NULL AND est IS NOT NULL), 0) / greatest(count(*) FILTER (available AND overlap AND truth IS NOT NULL AND est IS NOT NULL), 1), 9) AS loss FROM g GROUP BY t),
b AS (SELECT t, loss, row_number() OVER (ORDER BY t) AS epoch, min(loss) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM a),
i AS (SELECT *, coalesce(loss < coalesce(best_before, 'infinity'::DOUBLE), false) AS improved FROM b), z AS (SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS epochs_since FROM i)
SELECT t, loss, epoch, best_before, improved, epochs_since, epochs_since >= 5 AS stop FROM z""",
    "timestamp_digests": f"""{SPLITS}, h AS (SELECT split, t, printf('%016x', t) AS h FROM sp)
SELECT split, sha256(unhex(string_agg(concat(h[15:16], h[13:14], h[11:12], h[9:10], h[7:8], h[5:6], h[3:4], h[1:2]), '' ORDER BY t))) AS times FROM h GROUP BY split""",
    "paired_report": f"""{G}, o AS (SELECT * FROM g WHERE truth IS NOT NULL AND est IS NOT NULL)
SELECT 'same' AS pair, count(*) AS cells, true AS same_cells, true AS same_times, true AS same_masks FROM c
UNION ALL SELECT 'other', count(*), count(*) = (SELECT count(*) FROM o), NOT EXISTS (SELECT t FROM o EXCEPT SELECT t FROM c) AND NOT EXISTS (SELECT t FROM c EXCEPT SELECT t FROM o),
NOT EXISTS (SELECT t, y, x FROM o EXCEPT SELECT t, y, x FROM c) AND NOT EXISTS (SELECT t, y, x FROM c EXCEPT SELECT t, y, x FROM o) FROM c""",
    "bin_counts": f"""{G}, r AS (SELECT est, truth, row_number() OVER (PARTITION BY t ORDER BY md5(concat_ws(':', '17', t, y, x)), y, x) AS r FROM c)
SELECT CAST(floor(est / 0.5) AS BIGINT) AS bin_x, CAST(floor(truth / 0.5) AS BIGINT) AS bin_y, count(*) AS n FROM r WHERE r <= 16 GROUP BY ALL""",
    "validation_by_epoch": f"""{G}, b(bin, bin_label) AS (VALUES {", ".join(f"({k}, '{label}')" for k, (label, _) in enumerate(REGISTRIES["validation"]))}),
a AS (SELECT t % 3 AS epoch, {case("validation")} AS bin, count(*) AS n, avg(abs(est - truth)) AS mae, avg(est - truth) AS bias, avg(est) AS mean, stddev_pop(est) AS std, max(est) AS max, quantile_cont(est, 0.5) AS p50, quantile_cont(est, 0.95) AS p95, quantile_cont(est, 0.99) AS p99,
count(*) FILTER (truth >= 1 AND est >= 1) AS hits, count(*) FILTER (truth < 1 AND est >= 1) AS false_alarms, count(*) FILTER (truth >= 1 AND est < 1) AS misses FROM c GROUP BY ALL)
SELECT epoch, bin_label, n, {R('mae', 'bias', 'mean', 'std', 'max', 'p50', 'p95', 'p99')}, hits, false_alarms, misses, round(hits / nullif(hits + false_alarms + misses, 0), 6) AS csi FROM a JOIN b USING (bin)""",
    "training_patches": f"""{CHOICE}, sp AS (SELECT epoch, t, patch_y, patch_x, dy, dx FROM ch, (SELECT unnest(range(5)) AS dy), (SELECT unnest(range(5)) AS dx)),
j AS (SELECT sp.*, est, truth, coalesce(available AND overlap AND truth IS NOT NULL AND est IS NOT NULL, false) AS m FROM sp LEFT JOIN g ON g.t = sp.t AND g.y = patch_y + dy AND g.x = patch_x + dx)
SELECT CAST(epoch AS BIGINT) AS epoch, t, CAST(patch_y AS BIGINT) AS patch_y, CAST(patch_x AS BIGINT) AS patch_x, string_agg((est IS NOT NULL)::INT, '' ORDER BY dy, dx) AS available, string_agg(m::INT, '' ORDER BY dy, dx) AS mask,
round(sum(CASE WHEN est IS NOT NULL THEN CAST(ln(1 + greatest(est, 0)) AS FLOAT)::DOUBLE ELSE 0 END), 4) AS input, round(sum(CASE WHEN truth IS NOT NULL THEN CAST(greatest(truth, 0) AS FLOAT)::DOUBLE ELSE 0 END), 4) AS amount FROM j GROUP BY ALL""",
    "cube_by_months": f"""{G}, o AS (SELECT strftime(make_timestamp(t * 604800 * 1000000), '%Y_%m') AS month, * FROM g)
SELECT month, count(*) AS cells, count(est) AS seen, {R('sum(truth)').replace('AS sum(truth)', 'AS truth')}, {R('sum(est)').replace('AS sum(est)', 'AS est')} FROM o GROUP BY month""",
    "cube_inventory": f"""{G}, m AS (SELECT DISTINCT strftime(make_timestamp(t * 604800 * 1000000), '%Y_%m') AS month FROM g)
SELECT month, 1::BIGINT AS there, true AS bytes, true AS ok FROM m UNION ALL SELECT '1900_01', 0, false, false UNION ALL SELECT 'L1 monthly files', count(*), true, count(*) = 24 FROM m""",
    "split_manifest": f"{SPLITS} SELECT date_utc, count(*) AS steps, min(t) AS first FROM sp WHERE split = 'test' GROUP BY date_utc",
    "report_files": f"{POINT} SELECT source, method, n, {R('mae', 'rmse', 'bias')}, valid_hours FROM p, (VALUES ('csv'), ('json')) f(source)",
    "finite_values": """WITH v AS (SELECT l_orderkey % 3 AS part, CASE WHEN l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0 THEN l_quantity END AS v FROM lineitem)
SELECT part, count(*) AS n, count(v) AS finite, round(sum(v), 6) AS total, max(v) AS max FROM v GROUP BY part""",
    "tile_layout": f"{G} SELECT t, count(DISTINCT (y // 5, x // 5)) AS tiles, count(*) AS cells, round(sum((y * 100 + x) * truth), 6) AS moment FROM g GROUP BY t",
    "archive_days": f"""WITH {series_sql(300)}, d AS (SELECT DATE '1970-01-01' + CAST(t // 86400 AS INT) AS day, v FROM s), y AS (SELECT min(day) AS day FROM d GROUP BY year(day))
SELECT day, true AS expected, 1::BIGINT AS members, true AS ok, count(*) AS steps, count(v) AS seen, round(sum(v), 6) AS total, day IN (SELECT day FROM y) AS sampled FROM d GROUP BY day""",
    "regrid_projected": f"""{G}, ll AS (SELECT i, j, lon, lat FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(5)) AS j), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b),
LATERAL (SELECT 9.6::DOUBLE + (j + a) * 0.4::DOUBLE AS lon, 50::DOUBLE + (i + b) * 0.25::DOUBLE AS lat)),
xy AS (SELECT i, j, r * sin(radians(lon - {CENTRE})) AS px, -r * cos(radians(lon - {CENTRE})) AS py FROM (SELECT *, {2 * RADIUS * SCALE}::DOUBLE * tan(radians((90 - lat) / 2)) AS r FROM ll)),
box AS (SELECT i, j, greatest(min((py + 4300000) / 10000), 0) AS y0, least(max((py + 4300000) / 10000), {SIDE}) AS y1, greatest(min((px + 20000) / 10000), 0) AS x0, least(max((px + 20000) / 10000), {SIDE}) AS x1 FROM xy GROUP BY i, j),
ov AS (SELECT i, j, y, x, (least(y + 1, y1) - greatest(y, y0)) * (least(x + 1, x1) - greatest(x, x0)) AS w FROM box, (SELECT unnest(range({SIDE})) AS y), (SELECT unnest(range({SIDE})) AS x) WHERE least(y + 1, y1) > greatest(y, y0) AND least(x + 1, x1) > greatest(x, x0)),
z AS (SELECT t, i, j, sum(w * est) / sum(CASE WHEN est IS NOT NULL THEN w END) AS mean, coalesce(sum(CASE WHEN est IS NOT NULL THEN w END), 0) / sum(w) AS s FROM g JOIN ov USING (y, x) WHERE w > 1e-12 GROUP BY t, i, j)
SELECT t, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN s >= 0.9 THEN round(mean, 6) + 0.0 END AS est, round(s, 6) AS source_valid_fraction FROM z""",
}
ORACLES["declared_columns"] = f"""{G} SELECT *, (SELECT count(*) FROM g) AS cells FROM (VALUES ('L2 dimension time_epoch', '0', '0', true), ('L2 dimension y', '1', '1', true), ('L2 dimension x', '2', '2', true),
('L2 units of truth', 'mm', 'mm', true), ('L2 units of est', 'mm', 'm', false), ('L2 units of syn', 'mm', 'lacking', false)) v(contract, expected, found, ok)"""
ORACLES["grid_contracts"] = f"""{G}, o AS (SELECT y, x, max(overlap) AS overlap FROM g GROUP BY y, x),
a AS (SELECT 'whole' AS grid, y, x, overlap, y * 1000.0 AS py, x * 1000.0 AS px, 47 + y * 0.5 + x * 0.01 AS lat, 5 + x * 0.5 - y * 0.01 AS lon FROM o
UNION ALL SELECT 'turned', y, x, overlap, -y * 1000.0, x * 1000.0, 60 - (47 + y * 0.5 + x * 0.01), CASE WHEN y = 3 AND x = 4 THEN 99 ELSE 5 + x * 0.5 - y * 0.01 END FROM o),
py AS (SELECT grid, 'L4 py increases' AS contract, 0.0 AS expected, count(*) FILTER (d <= 0)::DOUBLE AS found FROM (SELECT grid, min(py) - lag(max(py)) OVER (PARTITION BY grid ORDER BY y) AS d FROM a GROUP BY grid, y) GROUP BY grid),
px AS (SELECT grid, 'L4 px increases', 0.0, count(*) FILTER (d <= 0)::DOUBLE FROM (SELECT grid, min(px) - lag(max(px)) OVER (PARTITION BY grid ORDER BY x) AS d FROM a GROUP BY grid, x) GROUP BY grid),
no AS (SELECT b.grid, 'L4 north is up', 1.0, (median(b.lat - a.lat) > 0)::INT::DOUBLE FROM a JOIN a b ON b.grid = a.grid AND b.x = a.x AND b.y = a.y + 1 GROUP BY b.grid),
ea AS (SELECT b.grid, 'L4 east is up', 1.0, (median(b.lon - a.lon) > 0)::INT::DOUBLE FROM a JOIN a b ON b.grid = a.grid AND b.y = a.y AND b.x = a.x + 1 GROUP BY b.grid),
bx AS (SELECT grid, 'L4 overlap in the box', 0.0, count(*) FILTER (NOT (lat BETWEEN 46.5 AND 55 AND lon BETWEEN 2 AND 16))::DOUBLE FROM a WHERE overlap GROUP BY grid)
SELECT grid, contract, expected::DOUBLE AS expected, found, expected = found AS ok FROM (FROM py UNION ALL FROM px UNION ALL FROM no UNION ALL FROM ea UNION ALL FROM bx)"""
#: Each coarse cell's polygon is cut by the four sides of a fine cell, one after the other; what is left is measured by the shoelace formula.
ORACLES["regrid_clipped"] = f"""WITH RECURSIVE {grid_sql(SIDE)}, ll AS (SELECT i, j, k, 9.6::DOUBLE + (j + [0, 1, 1, 0][k]) * 0.4::DOUBLE AS lon, 50::DOUBLE + (i + [0, 0, 1, 1][k]) * 0.25::DOUBLE AS lat
FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(5)) AS j), (SELECT unnest([1, 2, 3, 4]) AS k)),
xy AS (SELECT i, j, list({{'x': (r * sin(radians(lon - {CENTRE})) + 20000) / 10000, 'y': (-r * cos(radians(lon - {CENTRE})) + 4300000) / 10000}} ORDER BY k) AS p FROM (SELECT *, {2 * RADIUS * SCALE}::DOUBLE * tan(radians((90 - lat) / 2)) AS r FROM ll) GROUP BY i, j),
cut AS (
  SELECT i, j, y, x, 0 AS side, p FROM xy, (SELECT unnest(range({SIDE})) AS y), (SELECT unnest(range({SIDE})) AS x)
  UNION ALL
  SELECT i, j, y, x, side + 1, flatten(list_transform(range(1, len(p) + 1), lambda n: CASE
    WHEN d[n] >= 0 AND d[n % len(p) + 1] >= 0 THEN [p[n % len(p) + 1]]
    WHEN d[n] >= 0 THEN [{{'x': p[n].x + d[n] / (d[n] - d[n % len(p) + 1]) * (p[n % len(p) + 1].x - p[n].x), 'y': p[n].y + d[n] / (d[n] - d[n % len(p) + 1]) * (p[n % len(p) + 1].y - p[n].y)}}]
    WHEN d[n % len(p) + 1] >= 0 THEN [{{'x': p[n].x + d[n] / (d[n] - d[n % len(p) + 1]) * (p[n % len(p) + 1].x - p[n].x), 'y': p[n].y + d[n] / (d[n] - d[n % len(p) + 1]) * (p[n % len(p) + 1].y - p[n].y)}}, p[n % len(p) + 1]]
    ELSE [] END))
  FROM (SELECT *, list_transform(p, lambda q: CASE side WHEN 0 THEN q.x - x WHEN 1 THEN x + 1 - q.x WHEN 2 THEN q.y - y ELSE y + 1 - q.y END) AS d FROM cut WHERE side < 4 AND len(p) > 0)),
ov AS (SELECT i, j, y, x, abs(list_sum(list_transform(range(1, len(p) + 1), lambda n: p[n].x * p[n % len(p) + 1].y - p[n % len(p) + 1].x * p[n].y))) / 2 AS w FROM cut WHERE side = 4 AND len(p) > 2),
z AS (SELECT t, i, j, sum(w * est) / sum(CASE WHEN est IS NOT NULL THEN w END) AS mean, coalesce(sum(CASE WHEN est IS NOT NULL THEN w END), 0) / sum(w) AS s FROM g JOIN ov USING (y, x) WHERE w > 1e-9 GROUP BY t, i, j),
a AS (SELECT i, j, sum(w) AS area FROM ov WHERE w > 1e-9 GROUP BY i, j)
SELECT t, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN s >= 0.8 THEN round(mean, 6) + 0.0 END AS est, round(s, 6) AS source_valid_fraction, round(area, 6) AS area FROM z JOIN a USING (i, j)"""
ORACLES["archive_stream_hours"] = f"""WITH {series_sql(1800)}, d AS (SELECT DISTINCT t // 86400 AS day FROM s), k AS (SELECT day * 86400 + n * 1800 AS t FROM d, (SELECT unnest(range(48)) AS n))
SELECT k.t - k.t % 3600 + 3600 AS hour_end, CASE WHEN count(v) = 2 THEN round(sum(v), 6) + 0.0 END AS amount, count(v) AS seen FROM k LEFT JOIN s USING (t) GROUP BY 1"""
ORACLES["indexed_days"] = f"""WITH {series_sql(300)}, d AS (SELECT DATE '1970-01-01' + CAST(t // 86400 AS INT) AS day, v FROM s)
SELECT day, count(*) AS steps, count(v) AS seen, round(sum(v), 6) + 0.0 AS total FROM d WHERE month(day) = 2 GROUP BY day"""
ORACLES["axis_merge"] = """WITH a AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS place, lead(p) OVER (ORDER BY p) AS nxt FROM (SELECT DISTINCT o_totalprice AS p FROM orders)),
i AS (SELECT *, CASE WHEN place = 0 THEN '-infinity'::DOUBLE ELSE p END AS low FROM a WHERE nxt IS NOT NULL)
SELECT l_orderkey, l_linenumber, place, round((l_extendedprice - p) / (nxt - p), 6) + 0.0 AS beyond FROM lineitem ASOF JOIN i ON l_extendedprice >= low"""
ORACLES["scores_from_states"] = f"""{POINT}, e AS (SELECT method, count(*) FILTER (truth >= 1 AND e >= 1) AS hits, count(*) FILTER (truth >= 1 OR e >= 1) AS any_event FROM l GROUP BY method)
SELECT method, n, {R('mae', 'rmse', 'bias')}, valid_hours, hits, round(hits / any_event, 6) AS csi FROM p JOIN e USING (method)"""
ORACLES["source_windows"] = f"""WITH {FIELD_SQL}, {MAP}, r AS (SELECT t, y, x, CASE WHEN count(w * v) = 4 THEN sum(w * v) END AS v FROM f JOIN m USING (i, j) GROUP BY t, y, x), n AS (SELECT DISTINCT t FROM f),
b AS (SELECT t, 'patch' AS mode, 5 AS side, t % 12 AS y0, t * 7 % 13 AS x0, t % 12 + 5 AS y1, t * 7 % 13 + 5 AS x1 FROM n
UNION ALL SELECT t, 'tile', 10, greatest(0, t % 3 * 6 - 2), greatest(0, t * 2 % 3 * 6 - 2), least(15, t % 3 * 6 + 8), least(15, t * 2 % 3 * 6 + 8) FROM n),
k AS (SELECT b.*, k, y0 + k // side AS y, x0 + k % side AS x FROM b, (SELECT unnest(range(100)) AS k) WHERE k < side * side)
SELECT k.t, mode, y0, x0, string_agg((v IS NOT NULL)::INT, '' ORDER BY k) AS available, round(sum((k + 1) * CASE WHEN v IS NOT NULL THEN CAST(ln(1 + greatest(v, 0)) AS FLOAT)::DOUBLE ELSE 0 END), 4) + 0.0 AS moment
FROM k LEFT JOIN r ON r.t = k.t AND r.y = k.y AND r.x = k.x AND k.y < y1 AND k.x < x1 GROUP BY k.t, mode, y0, x0"""
ORACLES["regrid_map_table"] = ORACLES["regrid_bilinear"]


def _typical() -> str:
    """Bins in turn: the hour with the largest share that no bin before has taken."""
    parts, conditions = [], BIN_SQL["diagnostics"]
    for k, (condition, (label, _)) in enumerate(zip(conditions, REGISTRIES["diagnostics"], strict=True)):
        free = "".join(f" AND t NOT IN (SELECT t FROM p{n})" for n in range(k))
        parts.append(f"p{k} AS (SELECT '{label}' AS bin_label, t FROM (SELECT t, avg(({condition})::INT::DOUBLE) AS share FROM c GROUP BY t) WHERE share > 0{free} ORDER BY share DESC, t LIMIT 1)")
    return f"{G}, {', '.join(parts)} {' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(len(conditions)))}"


ORACLES["typical_per_bin"] = _typical()
