"""Language identification by naive Bayes over hashed character n-grams.

Counting is a Spark aggregation of (language, bucket) counts. The model is one
matrix of ``languages x BUCKETS`` log-probabilities, whatever the corpus' size;
it is broadcast and texts are scored by gathering its rows for their n-grams.

Defined results: a text that is NULL, empty or holds no letter is ``und`` with
score 0, and so is every text if nothing could be learned. Rows without a text or
language teach nothing. Repeated rows count as often as they occur. Languages tie
towards the name that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.llm.batches import arrow_schema, flat, fresh, steps

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: More languages than this are an error, as the model would outgrow a broadcast.
MOST_LANGUAGES = 256
UNKNOWN = "und"
_SMOOTHING = 0.1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageModel:
    """Names in sorted order, log priors, and log-probabilities by bucket."""

    names: tuple[str, ...]
    priors: np.ndarray
    logs: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower case of every letter's code point; a space's for all others."""
    codes = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            codes[code] = ord(low) if len(low) == 1 else code
    return codes


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams in text order, each n-gram's row, and rows with a letter.

    An n-gram lies within one text and starts or ends with a letter.
    """
    text = data.tobytes().decode("utf-8", "replace")
    codes = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.uint64)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    if heads[-1] != len(codes):  # not UTF-8: decode text by text
        parts = [
            data[a:b].tobytes().decode("utf-8", "replace")
            for a, b in zip(offsets[:-1], offsets[1:])
        ]
        codes = _letters()[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        codes = codes.astype(np.uint64)
        ends = np.cumsum([0, *map(len, parts)])
    else:
        ends = heads[offsets]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
    letter = codes != 32
    some = np.bincount(row, letter, len(offsets) - 1) > 0
    buckets, rows = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        last = len(codes) - n + 1
        mixed = np.full(last, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ codes[k : last + k]) * _SPREAD
            mixed ^= mixed >> np.uint64(29)
        keep = (row[:last] == row[n - 1 :]) & (letter[:last] | letter[n - 1 :])
        buckets.append((mixed[keep] >> np.uint64(7)).astype(np.int64) & (BUCKETS - 1))
        rows.append(row[:last][keep])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), some
    return np.concatenate(buckets), np.concatenate(rows), some


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, bucket, n) of a partition; bucket -1 counts its texts."""
    counted: dict[str, np.ndarray] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for name, found in counted.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at - 1), pa.array(found[at])],
                ["lang", "bucket", "n"],
            )
        counted.clear()

    for batch in batches:
        data, offsets = flat(batch.column(0))
        names = np.array(batch.column(1).to_pylist(), object)
        for first, last in steps(offsets):
            part = offsets[first : last + 1]
            bucket, row, some = _grams(data[part[0] : part[-1]], part - part[0])
            for name in sorted(set(names[first:last])):
                mine = (names[first:last] == name) & some
                found = counted.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                found[0] += mine.sum()
                found[1:] += np.bincount(bucket[mine[row]], minlength=BUCKETS)
            if len(counted) > MOST_LANGUAGES:
                yield from emit()
    yield from emit()


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count the n-grams of every row with a text and a language."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).alias("lang")).dropna()
    if rows.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = (
        rows.mapInArrow(_counts, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    # At most MOST_LANGUAGES * (BUCKETS + 1) rows come to the driver.
    found = counts.toPandas()
    names = tuple(sorted(found["lang"].unique()))
    table = np.zeros((len(names), BUCKETS + 1))
    place = {name: k for k, name in enumerate(names)}
    table[found["lang"].map(place).to_numpy(int), found["bucket"].to_numpy() + 1] = found["n"]
    texts, grams = table[:, 0], table[:, 1:] + _SMOOTHING
    priors = np.log(np.maximum(texts, 1) / max(texts.sum(), 1))
    return LanguageModel(names, priors, np.log(grams / grams.sum(1, keepdims=True)))


def predict(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    lang_pred: str = "lang_pred",
    score: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (all columns by default) with the likeliest language and its posterior."""
    keep = docs.columns if keep is None else keep
    hidden = fresh(docs, "scored_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias(hidden))
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.priors, model.logs))
    schema = arrow_schema(
        [(f.name, f.dataType) for f in rows.schema.fields[:-1]]
        + [(lang_pred, T.StringType()), (score, T.DoubleType())]
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, priors, matrix = shared.value
        for batch in batches:
            data, offsets = flat(batch.column(batch.num_columns - 1))
            best = np.full(batch.num_rows, len(names))
            sure = np.zeros(batch.num_rows)
            for first, last in steps(offsets) if names else ():
                part = offsets[first : last + 1]
                bucket, row, some = _grams(data[part[0] : part[-1]], part - part[0])
                total = np.stack(
                    [np.bincount(row, logs[bucket], last - first) for logs in matrix], 1
                ) + priors
                total -= total.max(1, keepdims=True)
                likely = np.exp(total)
                likely /= likely.sum(1, keepdims=True)
                best[first:last] = np.where(some, likely.argmax(1), len(names))
                sure[first:last] = np.where(some, likely.max(1), 0.0)
            named = pa.array(np.array([*names, UNKNOWN], object)[best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], named, pa.array(sure)], schema.names
            )

    return rows.mapInArrow(scored, schema)
