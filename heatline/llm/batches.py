"""Texts of Arrow batches as flat byte arrays, and names that clash with nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.session import prepare

#: Bytes of text a numpy step works on at once, unless one text is longer.
STEP_BYTES = 1 << 18
#: Bytes of an Arrow batch between Spark and Python, unless one row has more.
BATCH_BYTES = 2 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches bounded by bytes, as texts can be long."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with as many underscores before as ``df`` needs."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_crc(column: str | Column) -> Column:
    """crc32 of an identifier as text; a NULL identifier counts as empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n + 1 offsets; NULL is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


class SpanHash:
    """Hashes of any spans of a byte array from running sums, modulo 2**64."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.letters = random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(random.integers(1 << 62, 1 << 63)) * 2 + 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        n = 1 << max(n, STEP_BYTES + 1).bit_length()
        self.powers, self.inverses = powers(self.base), powers(pow(self.base, -1, 1 << 64))

    def __call__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(data) + 1:
            self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=sums[1:])
        mixed = (sums[last] - sums[first]) * self.inverses[first]
        mixed ^= mixed >> np.uint64(31)
        return mixed * np.uint64(0xD6E8FEB86659FD93) + (last - first).astype(np.uint64)


def arrow_schema(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def crc_of(data: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(data).view(np.uint8).data)
