"""Members of tar archives as rows (A2, A3, A5, I2): a data source with one partition for each archive, which gzip can't split, and an index of members that tells which archives to open."""

from __future__ import annotations

import datetime
import os
import re
import tarfile
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalar import DAILY_MEMBER

#: Members are read in pieces of so many bytes where contents are asked for.
PIECE = 8 << 20


_COLUMNS = pa.schema([("archive", pa.string()), ("place", pa.int32()), ("member", pa.string()), ("bytes", pa.int64()), ("day", pa.date32()), ("piece", pa.int32()), ("content", pa.binary())])
_DDL = "archive string, place int, member string, bytes long, day date, piece int, content binary"


def open_file(path: str, write: bool = False) -> BinaryIO:
    """A file by its path or URI, as a stream from front to back, with its folder if it is written; other schemes than ``file`` go by Arrow's file systems."""
    if "://" not in path or path.startswith("file:"):
        own = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        if write:
            os.makedirs(os.path.dirname(own) or ".", exist_ok=True)
        return open(own, "wb" if write else "rb")  # noqa: SIM115  the caller closes it
    from pyarrow.fs import FileSystem

    system, inner = FileSystem.from_uri(path)
    return system.open_output_stream(inner) if write else system.open_input_stream(inner)


def day_of_member(name: str) -> datetime.date | None:
    """``member_date`` of one name."""
    if not (found := re.search(DAILY_MEMBER, name)):
        return None
    try:
        return datetime.date(*map(int, found.groups()))
    except ValueError:
        return None


def walk(path: str, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, tarfile.TarInfo, BinaryIO]]:
    """Members of an archive in turn, or those at ``wanted`` places only; behind the last of them nothing is unpacked."""
    places = None if wanted is None else set(wanted)
    last = max(places, default=-1) if places is not None else None
    with open_file(path) as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
        for place, member in enumerate(archive):
            if last is not None and place > last:
                return
            if member.isfile() and (places is None or place in places):
                yield place, member, archive.extractfile(member)
            if place == last:
                return


def member_rows(path: str, contents: bool, wanted: Iterable[int] | None = None, match: Callable[[dict], bool] = lambda row: True) -> Iterator[pa.RecordBatch]:
    """A batch for each member or piece of it, so that a task holds one piece at a time. Members whose header (name, size, day, place) doesn't ``match`` aren't read."""
    for place, member, file in walk(path, wanted):
        head = {"archive": path, "place": place, "member": member.name, "bytes": member.size, "day": day_of_member(member.name)}
        if not match(head):
            continue
        piece, data = 0, None
        while not piece or data:
            data = file.read(PIECE) if contents else None
            if piece and not data:
                break
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in (head | {"piece": piece, "content": data}).items()}, _COLUMNS)
            piece += 1


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.contents = options.get("contents", "false").lower() == "true"
        self.days = [datetime.date.fromisoformat(options[n]) if n in options else None for n in ("from", "to")]

    def partitions(self) -> list[_Archive]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        first, last = self.days

        def asked(day: datetime.date | None) -> bool:
            if first is None and last is None:
                return True
            return day is not None and (first is None or day >= first) and (last is None or day <= last)

        return member_rows(partition.path, self.contents, match=lambda row: asked(row["day"]))


class TarSource(DataSource):
    """``format("tar_members")`` with options ``paths`` (one a line), ``contents``, and ``from`` and ``to``, the first and last day asked for."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def members(spark: SparkSession, paths: list[str], contents: bool = False, days: tuple[datetime.date | None, datetime.date | None] = (None, None)) -> DataFrame:
    """Rows of all members, with the date in the name of daily files; contents come in pieces of at most 8 MB.

    Of ``days``, the first and last asked for (None: no bound), only daily members are read. This is an option of the scan, not a filter that
    is pushed: Spark 4.1 keeps the filters that one query pushes to a Python source for the next query on the same DataFrame.
    """
    spark.dataSource.register(TarSource)
    scan = spark.read.format("tar_members").option("paths", "\n".join(paths)).option("contents", str(contents))
    for name, day in zip(("from", "to"), days, strict=True):
        scan = scan.option(name, day.isoformat()) if day else scan
    return scan.load()


def update_index(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """The table ``(archive, place, member, bytes, day)`` of all members under ``folder``, to which those of archives that it doesn't have yet are added (A2).

    Only new archives are opened, one a task.
    """
    kept = "archive string, place int, member string, bytes long, day date"
    try:
        have = {r["archive"] for r in spark.read.schema(kept).parquet(folder).select("archive").distinct().collect()}  # one row an archive
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        have = set()
    if new := [p for p in dict.fromkeys(paths) if p not in have]:
        members(spark, new).select("archive", "place", "member", "bytes", "day").write.mode("append").parquet(folder)
    return spark.read.schema(kept).parquet(folder)


def indexed_members(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """``members`` with contents of the rows of an index, which is to be filtered first (A2, A5).

    An archive without a row isn't opened; one with rows is unpacked up to the last of them, by one of ``tasks`` tasks (as many as shuffles have, where it isn't given).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from member_rows(path, True, places)

    tasks = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.groupBy("archive").agg(F.collect_set("place").alias("places")).repartition(tasks, "archive").mapInArrow(run, _DDL)


def with_head(own: pd.DataFrame | pa.RecordBatch, schema: pa.Schema, head: tuple) -> pa.RecordBatch:
    """A reader's rows with their member's archive, place, name and day."""
    if isinstance(own, pd.DataFrame):
        own = pa.RecordBatch.from_pandas(own, schema, preserve_index=False)
    first = [pa.repeat(pa.scalar(v, t), len(own)) for v, t in zip(head, (pa.string(), pa.int32(), pa.string(), pa.date32()), strict=True)]
    return pa.RecordBatch.from_arrays([*first, *(own.column(n).cast(t) for n, t in zip(schema.names, schema.types, strict=True))], ["archive", "place", "member", "day", *schema.names])


def decoded(pieces: DataFrame, read: Callable[[str], Iterator[pd.DataFrame | pa.RecordBatch]], schema: str) -> DataFrame:
    """``(archive, place, member, day, ...)``: the rows of ``schema`` that ``read`` gives for each member's file (A3, A5).

    Pieces of a member come to one task, in order, and go to a file of that task, which is removed once it is read; ``read``
    takes its path and gives Arrow batches (or pandas frames), so a task holds a piece or a batch at a time. A member that isn't whole fails.
    Members spread over tasks by archive and place, so what one archive's task has unpacked is decoded by many.
    """
    own_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp(prefix="spark-member-")
        path, now, size, want = os.path.join(folder, "member"), None, 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            if size != want:
                raise ValueError(f"{now[2]} has {size} of {want} bytes")
            for own in read(path):
                yield with_head(own, own_schema, now)

        try:
            for batch in batches:
                for archive, place, member, day, total, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now is None or now[:2] != (archive, place):
                        yield from rows()
                        now, size, want = (archive, place, member, day), 0, total
                        open(path, "wb").close()
                    with open(path, "ab") as file:
                        file.write(data)
                    size += len(data)
            yield from rows()
        finally:
            if os.path.exists(path):
                os.remove(path)
            os.rmdir(folder)

    own = pieces.repartition("archive", "place").sortWithinPartitions("archive", "place", "piece")
    return own.select("archive", "place", "member", "day", "bytes", "content").mapInArrow(run, f"archive string, place int, member string, day date, {schema}")


def require_days(rows: DataFrame, steps: int = 288, step: int = 300, cells: int = 1, time: str = "t") -> DataFrame:
    """A row for each member of ``decoded``, which fails by the member's name unless its name tells a day, its times are that day's ``steps`` times from midnight on, ``step`` seconds apart, and each has ``cells`` cells (A5)."""
    per = rows.groupBy("archive", "place", "member", "day", time).agg(F.count("*").alias("_c"))
    per = per.groupBy("archive", "place", "member", "day").agg(
        F.count("*").alias("steps"), F.min(time).alias("first"), F.max(time).alias("last"), F.count_if(F.pmod(F.col(time) - F.unix_date("day").cast("long") * 86400, F.lit(step)) != 0).alias("_off"), F.count_if(F.col("_c") != cells).alias("_grids")
    )
    midnight = F.unix_date("day").cast("long") * 86400
    whole = (F.col("steps") == steps) & (F.col("first") == midnight) & (F.col("last") == midnight + (steps - 1) * step) & (F.col("_off") == 0) & (F.col("_grids") == 0)
    fault = F.raise_error(F.concat(F.lit("not a whole day: "), F.col("member"), F.lit(" has "), F.col("steps").cast("string"), F.lit(" steps, "), F.col("_grids").cast("string"), F.lit(" of them on another grid"))).cast("long")
    return per.select("archive", "place", "member", "day", F.when(F.coalesce(whole, F.lit(False)), F.col("steps")).otherwise(fault).alias("steps"), "first", "last")


def first_of_years(pieces: DataFrame) -> DataFrame:
    """Of daily files those of the first day of each year, a sample to be decoded (A3)."""
    firsts = pieces.filter("day is not null").groupBy(F.year("day").alias("year")).agg(F.min(F.struct("day", "archive", "place")).alias("m"))
    # one row a year
    return pieces.join(F.broadcast(firsts.select("m.archive", "m.place")), ["archive", "place"], "left_semi")


def archive_audit(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Each expected day with how often it is there, and days that were not expected."""
    seen = rows.filter("day is not null").groupBy("day").agg(F.count("*").alias("members"))
    both = days.withColumn("expected", F.lit(True)).join(seen, "day", "full")
    return both.select("day", F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("members", F.lit(0)).alias("members")).withColumn("ok", F.col("expected") & (F.col("members") == 1))
