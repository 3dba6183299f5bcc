"""Where intermediate tables go, and how texts reach Python.

On a cluster every executor reaches the folder that ``spark.checkpoint.dir`` names. Only where that is unset and
all runs on one machine (tests) a folder of this machine stands in for it; on a cluster that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.fixpoint import cut, ready

__all__ = ["cut", "get_array", "new_dir", "put_array", "shared_dir", "small", "written"]


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that the driver and all executors share."""
    ready(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut and its rows are fixed."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows``, so that what Python makes of long texts fits a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def put_array(folder: str, name: str, data: np.ndarray) -> None:
    """A file appears whole or not at all, so that a task may run twice."""
    place = urlparse(folder)
    if place.scheme in ("", "file"):
        os.makedirs(place.path, exist_ok=True)
        half = f"{place.path}/.{name}-{uuid.uuid4().hex}"
        data.tofile(half)
        os.replace(half, f"{place.path}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        half = f"{path}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(half) as out:
            out.write(data.tobytes())
        store.move(half, f"{path}/{name}")


#: Arrays that a worker holds open, the last used at the end.
_OPEN: OrderedDict[str, np.ndarray] = OrderedDict()
_MOST_OPEN = 2048


def _fetched(folder: str, name: str) -> str:
    """A copy, on this machine's disk, of a file that is in a store; one for all workers of an executor."""
    from pyarrow import fs

    at = os.path.join(tempfile.gettempdir(), f"fieldloom-{os.path.basename(folder.rstrip('/'))}", name)
    if not os.path.exists(at):
        os.makedirs(os.path.dirname(at), exist_ok=True)
        store, path = fs.FileSystem.from_uri(folder)
        half = f"{at}.{uuid.uuid4().hex}"
        with store.open_input_stream(f"{path}/{name}") as found, open(half, "wb") as out:
            while block := found.read(1 << 22):
                out.write(block)
        os.replace(half, at)
    return at


def get_array(folder: str, name: str, kind: type) -> np.ndarray:
    """A file's array, mapped into memory: in place where the shared folder is a path, else from a copy on local disk."""
    at = f"{folder}/{name}"
    if at in _OPEN:
        _OPEN.move_to_end(at)
        return _OPEN[at]
    place = urlparse(folder)
    path = f"{place.path}/{name}" if place.scheme in ("", "file") else _fetched(folder, name)
    _OPEN[at] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    if len(_OPEN) > _MOST_OPEN:
        _OPEN.popitem(last=False)
    return _OPEN[at]
