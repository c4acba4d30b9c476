"""NetCDF files as rows (A4), where a reader library is installed; without one the scan says so."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Times read at once; rows go out a time at once.
SLAB = 4
#: What a slab's rows hold.
SCHEMA = "t long, y int, x int, v float, units string"
_ARROW = pa.schema([("t", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("v", pa.float32()), ("units", pa.string())])


def _library():
    try:
        import netCDF4
    except ImportError as e:
        raise RuntimeError("reading NetCDF needs the netCDF4 package on the executors") from e
    return netCDF4


def record_batches(variable: str, time: str = "time", size: int = SLAB) -> Callable[[str], Iterator[pa.RecordBatch]]:
    """A function that gives a file's rows of ``SCHEMA``, a batch a time (some 25 MB of a grid of a million cells); fill values are NULL by a mask. It also reads what ``archive.decoded`` puts together (A5)."""

    def read(path: str) -> Iterator[pa.RecordBatch]:
        netcdf = _library()
        with netcdf.Dataset(path) as file:
            field, axis = file[variable], file[time]
            _, height, width = field.shape
            y, x = (pa.array(k.ravel()) for k in np.indices((height, width), np.int32))
            units = pa.repeat(pa.scalar(getattr(field, "units", None), pa.string()), height * width)
            for low in range(0, field.shape[0], size):
                own = np.ma.asarray(field[low : low + size])
                missing = np.ma.getmaskarray(own)
                values = np.asarray(np.ma.getdata(own), np.float32)
                when = [int(w.timestamp()) for w in netcdf.num2date(axis[low : low + size], axis.units, only_use_cftime_datetimes=False, only_use_python_datetimes=True)]
                for k, t in enumerate(when):
                    v = pa.array(values[k].ravel(), mask=missing[k].ravel() | ~np.isfinite(values[k].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(t, pa.int64()), len(v)), y, x, v, units], schema=_ARROW)

    return read


def slabs(variable: str, time: str = "time", size: int = SLAB) -> Callable[[str], Iterator[pd.DataFrame]]:
    """``record_batches`` as pandas frames of ``size`` times."""
    read = record_batches(variable, time, size)

    def frames(path: str) -> Iterator[pd.DataFrame]:
        held: list[pa.RecordBatch] = []
        for batch in read(path):
            held.append(batch)
            if len(held) == size:
                yield pa.Table.from_batches(held).to_pandas()
                held = []
        if held:
            yield pa.Table.from_batches(held).to_pandas()

    return frames


def netcdf_scan(spark: SparkSession, paths: list[str], variable: str, time: str = "time") -> DataFrame:
    """``(path, t, y, x, v, units)`` of a three-dimensional variable: a task for each file, a batch a time; fill values are NULL (A4)."""
    _library()
    read = record_batches(variable, time)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for own in read(path):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path, pa.string()), len(own)), *own.columns], ["path", *own.schema.names])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, f"path string, {SCHEMA}")
