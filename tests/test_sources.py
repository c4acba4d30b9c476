"""Scans, sinks and the stream."""

import datetime
import io
import sys
import tarfile
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raingrid.sources import archive, netcdf, reports, tables
from raingrid.streaming import archives, hourly, replay


def test_months_are_written_once_unless_replaced(spark, tmp_path):
    path = str(tmp_path / "cube")
    t = 1_546_300_800
    df = spark.createDataFrame([(t, 1.0), (t + 40 * 86400, 2.0)], "time_epoch long, v double")
    tables.write_months(df, path)
    tables.write_months(df.withColumn("v", F.lit(9.0)).unionByName(spark.createDataFrame([(t + 70 * 86400, 3.0)], df.schema)), path)
    assert {r["month"]: r["v"] for r in spark.read.parquet(path).collect()} == {"2019_01": 1.0, "2019_02": 2.0, "2019_03": 3.0}
    tables.write_months(df.filter(F.col("time_epoch") == t).withColumn("v", F.lit(9.0)), path, overwrite=True)
    assert {r["month"]: r["v"] for r in spark.read.parquet(path).collect()} == {"2019_01": 9.0, "2019_02": 2.0, "2019_03": 3.0}
    plan = tables.scan(spark, path).filter("month = '2019_02'").select("v")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "ReadSchema: struct<v:double>" in plan


def test_month_audit(spark, tmp_path):
    for name in ("coarse_2019_01.nc", "coarse_2019_03.nc", "x_2019_03.nc"):
        (tmp_path / name).write_bytes(b"123")
    months = spark.createDataFrame([("2019_01",), ("2019_02",), ("2019_03",)], "month string")
    got = {r["month"]: (r["files"], r["bytes"], r["ok"]) for r in tables.month_audit(tables.inventory(spark, str(tmp_path), "*.nc"), months).collect()}
    assert got == {"2019_01": (1, 3, True), "2019_02": (0, 0, False), "2019_03": (2, 6, False)}


def test_archive_members(spark, tmp_path):
    path = tmp_path / "y.tar.gz"
    with tarfile.open(path, "w:gz") as out:
        for name, data in (("d/YW_2017.002_20190101.nc", b"abc"), ("YW_2017.002_20190103.nc", b"x" * 10), ("YW_2017.002_20190103.nc", b"y"), ("readme.txt", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    rows = archive.members(spark, [str(path)])
    assert [(r["member"], r["bytes"]) for r in rows.orderBy("place").collect()][0] == ("d/YW_2017.002_20190101.nc", 3)
    assert bytes(archive.members(spark, [str(path)], contents=True).filter("place = 0").first()["content"]) == b"abc"
    days = spark.createDataFrame([(datetime.date(2019, 1, d),) for d in (1, 2, 3)], "day date")
    got = {r["day"].day: (r["members"], r["ok"]) for r in archive.archive_audit(rows, days).collect()}
    assert got == {1: (1, True), 2: (0, False), 3: (2, False)}


def test_members_are_put_together_and_decoded(spark, tmp_path):
    def bytes_as_times(path):
        data = np.fromfile(path, np.uint8)
        for low in range(0, len(data), 3):
            yield pd.DataFrame({"t": np.arange(low, min(low + 3, len(data))), "v": data[low : low + 3].astype(float)})

    rng, want = np.random.default_rng(1), {}
    for year in (2019, 2020):
        with tarfile.open(tmp_path / f"{year}.tar.gz", "w:gz") as out:
            for day in (3, 2, 1):
                data = rng.bytes(5 + day)
                name = f"YW_2017.002_{year}010{day}.nc"
                want[name] = [float(b) for b in data]
                info = tarfile.TarInfo(name)
                info.size = len(data)
                out.addfile(info, io.BytesIO(data))
    pieces = archive.members(spark, [str(tmp_path / "2019.tar.gz"), f"file://{tmp_path}/2020.tar.gz"], contents=True)
    # members of one piece, cut into pieces of 4 bytes
    small = pieces.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / 4)))).selectExpr("archive", "place", "member", "day", "bytes", "int(k) as piece", "substring(content, int(4 * k + 1), 4) as content")
    got: dict = {}
    for r in archive.decoded(small, bytes_as_times, "t long, v double").orderBy("member", "t").collect():
        got.setdefault(r["member"], []).append(r["v"])
    assert got == want
    assert {str(r["day"]) for r in archive.first_of_years(small).select("day").distinct().collect()} == {"2019-01-01", "2020-01-01"}
    with pytest.raises(Exception, match="of 8 bytes"):
        archive.decoded(small.filter("piece <> 1"), bytes_as_times, "t long, v double").collect()
    assert archive.decoded(small.limit(0), bytes_as_times, "t long, v double").count() == 0


def test_slabs_of_a_netcdf_file(monkeypatch):
    field = np.ma.masked_equal(np.arange(12, dtype=np.float32).reshape(3, 2, 2), 5)

    class Variable:
        def __init__(self, data, units):
            self.data, self.units, self.shape = data, units, data.shape

        def __getitem__(self, at):
            return self.data[at]

    class Dataset(dict):
        def __init__(self, path):
            super().__init__(tp=Variable(field, "m"), time=Variable(np.array([0, 1, 2]), "hours since 1970-01-01"))

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    when = lambda hours, units, **_: [datetime.datetime.fromtimestamp(int(h) * 3600, datetime.timezone.utc) for h in hours]
    monkeypatch.setitem(sys.modules, "netCDF4", SimpleNamespace(Dataset=Dataset, num2date=when))
    got = list(netcdf.slabs("tp", size=2)("x.nc"))
    assert [len(g) for g in got] == [8, 4]
    rows = pd.concat(got)
    assert list(rows["t"].unique()) == [0, 3600, 7200] and rows["v"].isna().sum() == 1 and set(rows["units"]) == {"m"}


def test_file_stats(spark):
    rows = [("a", t, y, x, None if y else 1.0, "m") for t in (0, 3600, 10800) for y in range(2) for x in range(3)] + [("b", 0, 0, 0, 1.0, "m"), ("b", 3600, 0, 0, 1.0, "mm")]
    got = {r["file"]: r.asDict() for r in tables.file_stats(spark.createDataFrame(rows, "file string, t long, y int, x int, v double, units string"), "file").collect()}
    assert got["a"] == {"file": "a", "first": 0, "last": 10800, "times": 3, "least_step": 3600, "largest_step": 7200, "height": 2, "width": 3, "units": "m", "missing": 9}
    assert got["b"]["units"] is None and got["b"]["least_step"] == 3600


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0), ("a", float("nan"))], "m string, v double")
    reports.write_csv(df, str(tmp_path / "c"), ["m"])
    assert next((tmp_path / "c").glob("*.csv")).read_text().splitlines()[0] == "m,v"
    reports.write_json(df, str(tmp_path / "j"))
    assert '{"m":"a","v":null}' in next((tmp_path / "j").glob("*.txt")).read_text()
    assert sorted(map(tuple, reports.read_json(spark, str(tmp_path / "j"), "m string, v double").collect())) == [("a", None), ("b", 1.0)]
    assert [r["m"] for r in reports.read_csv(spark, str(tmp_path / "c"), "m string, v double").collect()] == ["a", "b"]
    splits = spark.createDataFrame([(3600, datetime.date(2019, 1, 1), "train"), (7200, datetime.date(2019, 1, 1), "test")], "time_epoch long, date_utc date, split string")
    reports.write_manifest(splits, str(tmp_path / "m"))
    assert [r["time_epoch"] for r in reports.read_manifest(spark, str(tmp_path / "m"), "test").collect()] == [7200]
    assert reports.read_profile("# c\nurl: http://a:1\nkey: k") == {"url": "http://a:1", "key": "k"}
    with pytest.raises(ValueError, match="key"):
        reports.read_profile("url: x")


def test_netcdf_needs_its_library(spark):
    try:
        import netCDF4  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="netCDF4"):
            netcdf.netcdf_scan(spark, ["x.nc"], "tp")


def test_stream_emits_only_complete_hours(spark):
    steps = spark.createDataFrame([(300 * k, 1.0) for k in range(24) if k != 13], "t long, v double")
    source, folder = replay.steps_as_stream(steps)
    got = hourly.run_to_table(hourly.stream_hourly_sum(source, [], "ts", "v", 12), folder).collect()
    assert [(r["amount"], r["steps"]) for r in got] == [(12.0, 12)]


def test_grids_are_written_once_and_read(spark, tmp_path):
    lat = spark.createDataFrame([(0, 50.0), (1, 50.25)], "k int, lat double")
    tables.write_grids(f"{tmp_path}/grids", lat=lat, crs=spark.createDataFrame([("wkt",)], "text string"))
    got = tables.read_grids(spark, f"{tmp_path}/grids", "lat", "crs")
    assert sorted(map(tuple, got["lat"].collect())) == [(0, 50.0), (1, 50.25)] and got["crs"].first()["text"] == "wkt"
    with pytest.raises(Exception, match="already exists"):
        tables.write_grids(f"{tmp_path}/grids", lat=lat)
    tables.write_grids(f"{tmp_path}/grids", overwrite=True, lat=lat.limit(1))
    assert tables.read_grids(spark, f"{tmp_path}/grids", "lat")["lat"].count() == 1


def write_archive(path, days, step=3600, skip=(), first=0):
    """Members of days of 2019 with whole days of steps (as bytes), but for those to skip; a member may begin late."""
    own = path.with_suffix(".part")
    with tarfile.open(own, "w:gz") as out:
        for day in days:
            low = (datetime.date(2019, 1, day) - datetime.date(1970, 1, 1)).days * 86400
            data = np.array([t for t in range(low + first, low + 86400, step) if t - low not in skip], "<i8").tobytes()
            info = tarfile.TarInfo(f"YW_2017.002_201901{day:02d}.nc")
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    own.rename(path)


@pytest.fixture
def replayed(spark, tmp_path):
    """What a folder's archives give, from the checkpoint on."""
    (tmp_path / "in").mkdir()

    def read_times(path):
        t = np.fromfile(path, "<i8")
        yield pd.DataFrame({"t": t, "v": (t // 900 % 7).astype(float)})

    def run():
        stream = archives.archive_stream(spark, str(tmp_path / "in"), "*.tar.gz")
        steps = archives.decoded_archives(stream, read_times, "t long, v double").withColumn("series", F.lit("YW"))
        return hourly.run_to_table(archives.strict_hours(steps, ["series"], step=900), str(tmp_path / "out"))

    return tmp_path / "in", run


def test_a_stream_of_archives_goes_on_from_its_checkpoint(replayed):
    folder, run = replayed
    write_archive(folder / "a.tar.gz", [2, 1], step=900)
    assert run().count() == 48
    write_archive(folder / "b.tar.gz", [3], step=900)
    got = run().orderBy("hour_end").collect()
    first = (datetime.date(2019, 1, 1) - datetime.date(1970, 1, 1)).days * 86400
    want = [(first + 3600 * (k + 1), float(sum((first + 3600 * k + 900 * n) // 900 % 7 for n in range(4))), 4) for k in range(72)]
    assert [(r["hour_end"], r["amount"], r["seen"]) for r in got] == want
    assert run().count() == 72


@pytest.mark.parametrize(
    ("days", "options", "message"),
    [([2], {}, "late or repeated step: YW_2017.002_20190102.nc"), ([1], {}, "late or repeated"), ([3, 3], {}, "late or repeated"), ([3], {"skip": (4500,)}, "without all its steps"), ([3], {"first": 900}, "without all its steps"), ([3], {"first": 60}, "off the cadence")],
)
def test_a_stream_of_archives_fails_by_name(replayed, days, options, message):
    folder, run = replayed
    write_archive(folder / "a.tar.gz", [2], step=900)
    run()
    write_archive(folder / "b.tar.gz", days, 900, **options)
    with pytest.raises(Exception, match=message):
        run()


def test_a_value_that_lacks_leaves_its_hour_without_amount(spark, tmp_path):
    spark.createDataFrame([("a", 1800 * k, None if k == 2 else 1.0, "m") for k in range(6)], "s string, t long, v double, member string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("s string, t long, v double, member string").parquet(f"{tmp_path}/in")
    got = hourly.run_to_table(archives.strict_hours(stream, ["s"], step=1800), f"{tmp_path}/out").orderBy("hour_end").collect()
    assert [(r["hour_end"], r["amount"], r["seen"]) for r in got] == [(3600, 2.0, 2), (7200, None, 1), (10800, 2.0, 2)]


def test_only_members_asked_for_are_read(spark, tmp_path, monkeypatch):
    for name, days in (("a", [1, 2, 3]), ("b", [4, 5]), ("c", [6])):
        write_archive(tmp_path / f"{name}.tar.gz", days)
    paths = [str(tmp_path / f"{n}.tar.gz") for n in ("a", "b", "c")]
    rows = archive.members(spark, paths, days=(datetime.date(2019, 1, 3), datetime.date(2019, 1, 5)))
    assert sorted(r["day"].day for r in rows.collect()) == [3, 4, 5]
    # a filter of one query isn't that of the next on the same table
    assert (rows.filter(F.col("archive") == paths[0]).count(), rows.count(), rows.filter(F.col("archive") == paths[1]).count()) == (1, 3, 2)
    read = []
    monkeypatch.setattr(tarfile.ExFileObject, "read", lambda self, *a, _read=tarfile.ExFileObject.read: read.append(self.name) or _read(self, *a))
    got = list(archive.member_rows(paths[0], True, match=lambda row: row["day"] == datetime.date(2019, 1, 2)))
    assert len(got) == 1 and len(set(read)) == 1
    archive.update_index(spark, paths[:2], str(tmp_path / "index"))
    assert archive.update_index(spark, paths[:3], str(tmp_path / "index")).count() == 6
    (tmp_path / "c.tar.gz").write_bytes(b"changed")  # it is in the index, so it isn't opened again
    index = archive.update_index(spark, paths[:3], str(tmp_path / "index"))
    got = archive.indexed_members(index.filter("day between '2019-01-03' and '2019-01-04'")).orderBy("day").collect()
    assert [(r["archive"], r["place"], r["bytes"], len(r["content"])) for r in got] == [(paths[0], 2, 192, 192), (paths[1], 0, 192, 192)]


def test_nothing_behind_the_last_member_asked_for_is_unpacked(tmp_path):
    write_archive(tmp_path / "a.tar.gz", range(1, 32), step=1)
    whole = (tmp_path / "a.tar.gz").read_bytes()
    (tmp_path / "b.tar.gz").write_bytes(whole[: len(whole) // 3])
    assert [m.name[-5:-3] for _, m, _ in archive.walk(str(tmp_path / "b.tar.gz"), [1, 4])] == ["02", "05"]
    with pytest.raises(Exception, match="(?i)end"):
        for _, _, file in archive.walk(str(tmp_path / "b.tar.gz")):
            file.read()
