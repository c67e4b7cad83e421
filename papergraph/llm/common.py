"""What the operators of this package share: reading, writing intermediate tables, and Arrow text as numpy bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papergraph.operators.storage import forget, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the folder that the cluster shares, and reads it again: lineage ends here, and sizes are known."""
    return written(df, name)


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing will read any more."""
    for df in tables:
        forget(df)


def fresh(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and len + 1 offsets into them. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int, space: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """Ranges of rows of at most limit bytes as (first, last, [start, end]); a longer text alone, with cuts before blanks."""
    for first, last in runs(offsets, limit):
        cuts = [int(offsets[first])]
        end = int(offsets[last])
        while last == first + 1 and end - cuts[-1] > limit:
            at = cuts[-1] + limit
            blank = np.flatnonzero(space[data[cuts[-1] + 1 : at]])
            while not len(blank) and at < end:  # a word longer than the limit
                at = min(end, at + limit)
                blank = at - limit - cuts[-1] - 1 + np.flatnonzero(space[data[at - limit : at]])
            if not len(blank):
                break
            cuts.append(cuts[-1] + 1 + int(blank[-1]))
        yield first, last, [*cuts, end]


def longs(column: pa.Array, null: int = -(2**63)) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
