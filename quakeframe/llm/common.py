"""Helpers shared by the text operators: cutting lineage, reading tables, Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, lengthened until none is a column of `df`, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its plain name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names: tasks and driver write and read there, so it has to be shared.

    A local session, whose only machine shares everything, gets one in its warehouse where none is named.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/checkpoints")
    return sc.getCheckpointDir()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder, asked of the file system that owns it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints `df` in the cluster's shared folder, so that a lost executor never costs a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the rows' offsets into them; null rows are empty."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits a column into runs of rows of about `most` bytes: (first row, end row, bytes, offsets).

    Working arrays are a small multiple of a run, so memory is bounded by `most` or the longest single text.
    """
    raw, off = text_buffer(column)
    n, row = len(off) - 1, 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end
