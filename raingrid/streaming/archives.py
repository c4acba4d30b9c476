"""Archives as a stream, and strict hours that reject late, repeated and lacking steps."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.archive import PIECE, day_of_member, walk, with_head


def archive_stream(spark: SparkSession, folder: str, pattern: str = "*.tar.gz", per_batch: int = 1) -> DataFrame:
    """A stream of ``path``, the archives that appear in a folder, ``per_batch`` of them in a batch, each once and the oldest first.

    Spark's file source keeps in the checkpoint which archives a batch has had. gzip can't be entered in the middle, so an archive is
    what a failed batch reads again. An archive should appear by a rename, once it is whole; its bytes aren't read here.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder).select("path")


def decoded_archives(paths: DataFrame, read: Callable[[str], Iterator[pd.DataFrame | pa.RecordBatch]], schema: str) -> DataFrame:
    """``(archive, place, member, day, ...)``: the rows of ``schema`` that ``read`` gives for each daily member of the archives ``paths(path)``, a stream or a table.

    As ``sources.archive.decoded``, but a member is decoded by the task that unpacks its archive, for a stream can't sort its pieces. A
    task holds one member as a file and a batch of its rows. Members whose name tells no day are left out, as the batch form's day is null.
    """
    own_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for place, member, file in walk(archive):
                    if (day := day_of_member(member.name)) is None:
                        continue
                    with tempfile.TemporaryDirectory(prefix="spark-member-") as folder:
                        path = os.path.join(folder, "member")
                        with open(path, "wb") as out:
                            shutil.copyfileobj(file, out, PIECE)
                        for own in read(path):
                            yield with_head(own, own_schema, (archive, place, member.name, day))

    return paths.select("path").mapInArrow(run, f"archive string, place int, member string, day date, {schema}")


def strict_hours(steps: DataFrame, keys: list[str], time: str = "t", value: str = "v", member: str = "member", step: int = 300) -> DataFrame:
    """``(*keys, hour_end, amount, seen)`` of each whole hour of a stream of steps (I1, I4); times are epoch seconds that begin a step.

    The steps of a key must come in order from one batch to the next (within a batch they have none): its state is the last step and the sums of the open
    hour. A step at or before the last one (late, or there twice), one off the cadence, and one that leaves an hour without all its
    steps fail the stream by key, member and time; hours and days that lack altogether between whole ones aren't steps, see ``archive_audit``.
    ``amount`` is null unless all values of the hour are there. An hour that is still open when the stream ends stays in the state.
    A task holds the steps of one key in one batch.
    """
    per_hour = 3600 // step
    kinds = dict(steps.dtypes)
    out = [*keys, "hour_end", "amount", "seen"]

    def fault(what: str, key: tuple, row) -> ValueError:
        return ValueError(f"{what}: {row.member} at {row.t} of {dict(zip(keys, key, strict=True))}")

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, seen, total = state.get if state.exists else (None, 0, 0, 0.0)
        rows = pd.concat([f[[time, value, member]] for f in frames], ignore_index=True).set_axis(["t", "v", "member"], axis=1).sort_values("t", kind="stable")
        hours = []
        for row in rows.itertuples(index=False):
            if pd.isna(row.t) or row.t % step:
                raise fault("a step off the cadence", key, row)
            if last is not None and row.t <= last:
                raise fault("a late or repeated step", key, row)
            if row.t % 3600 != n * step or n and row.t != last + step:
                raise fault("an hour without all its steps before", key, row)
            last, n = int(row.t), n + 1
            if not pd.isna(row.v):
                seen, total = seen + 1, total + float(row.v)
            if n == per_hour:
                hours.append((*key, last + step, total if seen == n else None, seen))
                n, seen, total = 0, 0, 0.0
        state.update((last, n, seen, total))
        yield pd.DataFrame(hours, columns=out).astype({"hour_end": "int64", "amount": "float64", "seen": "int64"})

    own = steps.select(*keys, time, F.col(value).cast("double").alias(value), member)
    return own.groupBy(*keys).applyInPandasWithState(
        run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "hour_end long, amount double, seen long"]), "last long, n int, seen int, total double", "append", GroupStateTimeout.NoTimeout
    )
