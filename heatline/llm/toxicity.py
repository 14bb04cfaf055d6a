"""Toxicity of texts after undoing leetspeak, spacing and repetition.

A noisy channel turns letters into look-alike digits and signs, parts them by blanks
or dots, or repeats them. Wherever a text shows such marks, all readings of the
marked span form a lattice, and the likeliest one under a character trigram model
of the whole corpus replaces it, if it beats random characters. Toxic words are
then learned from labelled rows: words whose rows are mostly toxic, taken one by
one, each judged on rows that no better word explains. A text's score is that of
at least one of its words being reason enough for the label.

The corpus is counted in Spark: trigrams of all texts (a table of 28**3 at most), and
the rows, toxic and not, of every word of the labelled texts. Only words that look
toxic, and how often each set of them occurs with each label, reach the driver;
``MOST_ROWS`` bounds both, as beyond it a sample of the labelled rows is learned from.
The labels of that sample are broadcast to the texts, which never move.

Defined results: NULL, empty and wordless texts get the score of a text without toxic
words; without labelled rows every score is 0. A row labelled twice counts twice.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.llm.batches import arrow_schema, flat, fresh, steps
from heatline.operators.scale import bounded_broadcast, written

#: Letters that a digit or sign can stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c",
}
#: Signs that part letters.
PARTS = " .-_*"
#: Labelled rows the classifier learns from; of more, a sample by hash.
MOST_ROWS = 200_000
#: Toxic rows a word needs at least.
LEAST_ROWS = 4
_SYMBOLS = 28
_SWAP, _DROP, _BREAK, _TWICE = 1.5, 0.3, 2.0, 0.7
#: Log-probability of a character that is no language.
_RANDOM = math.log(1 / 32)
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = "".join(LOOKS_LIKE)
#: Letters or marks parted by the same sign; a span without any letter is a row of numbers.
_SPACED = re.compile(
    rf"(?<!\w)(?:[^\W\d_]|[{re.escape(_MARKS)}])([ .\-_*])(?:[^\W\d_]|[{re.escape(_MARKS)}])(?=\1|\W|$)"
    rf"(?:\1[\w{re.escape(_MARKS)}](?=\1|\W|$))+"
)
#: Words with a mark beside a letter, or a letter three times.
_MARKED = re.compile(
    rf"(?<![\w{re.escape(_MARKS)}])(?=[\w{re.escape(_MARKS)}]*?"
    rf"(?:[^\W\d_][{re.escape(_MARKS)}]|[{re.escape(_MARKS)}][^\W\d_]|([^\W\d_])\1\1))[\w{re.escape(_MARKS)}]+"
)


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """1-26 for a letter or its accented form, 27 for other letters, 0 for all else."""
    out = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            base = unicodedata.normalize("NFD", letter.lower())[0] if code < 0x2000 else "?"
            out[code] = ord(base) - 96 if "a" <= base <= "z" else 27
    return out


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_SYMBOLS**3, np.int64)
    for batch in batches:
        data, offsets = flat(batch.column(0))
        for a, b in steps(offsets):
            ends = offsets[a + 1 : b + 1] - offsets[a]
            text = np.insert(data[offsets[a] : offsets[b]], ends, 10).tobytes().decode("utf-8", "replace")
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            line = np.concatenate(([0, 0], _symbols()[codes], [0])).astype(np.int64)
            one, two, three = line[:-2], line[1:-1], line[2:]
            # A word's letters after up to two before it, and its end.
            some = (two > 0) | (three > 0)
            first = np.where(two > 0, one, 0)
            index = (first * _SYMBOLS + two) * _SYMBOLS + three
            counts += np.bincount(index[some], minlength=len(counts))
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["trigram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probabilities of a symbol after two others, from every word of the corpus."""
    rows = docs.select(F.col(text).cast("string").alias("text")).dropna()
    counts = rows.mapInArrow(_count_trigrams, "trigram long, n long").groupBy("trigram")
    found = counts.agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((_SYMBOLS,) * 3)
    table.ravel()[found["trigram"].to_numpy()] = found["n"].to_numpy()
    pairs, single = table.sum(0), table.sum((0, 1))
    one = (single + 1) / (single.sum() + _SYMBOLS)
    two = (pairs + 5 * one) / (pairs.sum(1, keepdims=True) + 5)
    return np.log((table + 5 * two) / (table.sum(2, keepdims=True) + 5))


def _choices(mark: str, run: int) -> list[tuple[str, float]]:
    """Readings of a run of equal characters with their cost."""
    if mark.isalpha():
        letter = mark.lower()
        if run == 1:
            return [(letter, 0.0)]
        return [(letter, 0.1 * (run - 1)), (letter * 2, 0.1 * (run - 2) + _TWICE * (run > 2))]
    if mark in PARTS:
        return [("", _DROP * run), (" ", _BREAK)]
    read = [(letter, _SWAP) for letter in LOOKS_LIKE.get(mark, "")]
    if run > 1:
        read += [(letter * 2, 2 * _SWAP) for letter in LOOKS_LIKE.get(mark, "")]
    return [*read, ("", _SWAP + _DROP * run)]


def decode(span: str, model: np.ndarray) -> str:
    """The likeliest reading of a marked span, or the span if it reads like noise."""
    code = _symbols()
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    at = 0
    while at < len(span):
        run = 1
        while at + run < len(span) and span[at + run].lower() == span[at].lower():
            run += 1
        choices = _choices(span[at], run)
        at += run
        ahead: dict[tuple[int, int], tuple[float, str]] = {}
        for (one, two), (score, read) in paths.items():
            for letters, cost in choices:
                a, b, total = one, two, score - cost
                for letter in letters:
                    c = 0 if letter == " " else int(code[ord(letter)])
                    if c or b:
                        total += model[a, b, c]
                    a, b = (b, c) if c else (0, 0)
                if (a, b) not in ahead or total > ahead[a, b][0]:
                    ahead[a, b] = (total, read + letters)
        paths = ahead
    best, read = max(
        (score + (model[a, b, 0] if b else 0.0), read) for (a, b), (score, read) in paths.items()
    )
    plain = sum(1 for c in span if c not in PARTS)
    return read if read.strip() and best > _RANDOM * plain else span


def _suspects(data: np.ndarray) -> np.ndarray:
    """Bytes at which a span with marks may be."""
    data = np.pad(data, 2)
    low = data | 0x20
    letter = ((low >= 0x61) & (low <= 0x7A) & (data < 0x80)) | (data >= 0x80)
    sign = np.isin(data, np.frombuffer(_MARKS.encode(), np.uint8))
    out = np.zeros(len(data), bool)
    out[1:-1] = sign[1:-1] & (letter[:-2] | letter[2:])
    out[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    part = np.isin(data, np.frombuffer(PARTS.encode(), np.uint8))
    out[1:-3] |= part[1:-3] & (data[1:-3] == data[3:-1]) & ~part[2:-2] & ~part[:-4]
    return out[2:-2]


class Restorer:
    """Texts with their marked spans replaced; remembers the spans it has read."""

    def __init__(self, model: np.ndarray):
        self.read = lru_cache(maxsize=1 << 16)(lambda span: decode(span, model))

    def __call__(self, text: str) -> str:
        text = _SPACED.sub(lambda m: self.read(m[0]) if _WORD.search(m[0]) else m[0], text)
        return _MARKED.sub(lambda m: self.read(m[0]), text)


def _words_of(batch_text: pa.Array, restorer: Restorer) -> Iterator[set[str]]:
    """Distinct words of each restored text, in small letters."""
    data, offsets = flat(batch_text)
    for a, b in steps(offsets):
        part = data[offsets[a] : offsets[b]]
        marks = np.append(0, np.cumsum(_suspects(part)))
        for k in range(a, b):
            lo, hi = offsets[k] - offsets[a], offsets[k + 1] - offsets[a]
            text = part[lo:hi].tobytes().decode("utf-8", "replace")
            if marks[hi] > marks[lo]:
                text = restorer(text)
            yield set(_WORD.findall(text.lower()))


@dataclass(frozen=True)
class ToxicityModel:
    """Trigram model, toxic words with their weight, and the score without any."""

    characters: np.ndarray
    words: dict[str, float]
    base: float


def _lower_bound(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Wilson's lower bound of a rate at 95 %."""
    z, n = 1.96, np.maximum(n, 1)
    rate = hits / n
    spread = z * np.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))
    return (rate + z * z / (2 * n) - spread) / (1 + z * z / n)


def _cover(sets: list[tuple[list[int], int, int]], names: list[str], rows: dict[int, int]):
    """Weights of the words that explain the toxic rows best, one after the other.

    ``sets`` has (words, label, rows) of rows with any candidate word, ``rows`` all rows by label.
    """
    weight: dict[str, float] = {}
    toxic, clean = np.zeros(len(names)), np.zeros(len(names))
    holding: list[list[int]] = [[] for _ in names]
    for k, (words, label, n) in enumerate(sets):
        (toxic if label else clean)[words] += n
        for word in words:
            holding[word].append(k)
    left = np.ones(len(sets), bool)
    while True:
        bound = np.where(toxic >= LEAST_ROWS, _lower_bound(toxic, toxic + clean), 0.0)
        if not len(bound) or bound.max() < 0.5:
            break
        # Among sure words the one that explains most; names settle ties.
        best = max(np.flatnonzero(bound >= 0.5), key=lambda k: (toxic[k] * bound[k], names[k]))
        weight[names[best]] = float((toxic[best] + 0.5) / (toxic[best] + clean[best] + 1))
        for k in holding[best]:
            if left[k]:
                words, label, n = sets[k]
                (toxic if label else clean)[words] -= n
                left[k] = False
    covered = {0: 0, 1: 0}
    for k in np.flatnonzero(~left):
        covered[sets[k][1]] += sets[k][2]
    rest = {y: rows.get(y, 0) - covered[y] for y in (0, 1)}
    base = (rest[1] + 0.5) / (rest[0] + rest[1] + 1) if rows else 0.0
    return weight, base


def _share(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows``, or about ``most`` of them by a hash of ``key`` where there are more."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(6), key), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most: int = MOST_ROWS,
) -> DataFrame:
    """(text, label, copies) of the labelled texts; of more labels than ``most``, a sample.

    The labels are counted and broadcast, and the texts picked where they are read.
    """
    hidden = fresh(docs.select(doc_id, text), "labelled_id")
    marks = labels.select(F.col(doc_id).alias(hidden), F.col(label).cast("int").alias("y"))
    marks = marks.filter("y IN (0, 1)").groupBy(hidden, "y").agg(F.count(F.lit(1)).alias("copies"))
    marks = F.broadcast(_share(marks, hidden, most))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    return rows.join(marks, F.col("_id") == F.col(hidden)).select("text", F.col("y").alias(label), "copies")


def train(
    docs: DataFrame,
    labelled: DataFrame,
    text: str = "text",
    label: str = "toxic",
    copies: str | None = None,
    most: int = MOST_ROWS,
) -> ToxicityModel:
    """Characters from all of ``docs``, toxic words from ``labelled`` texts with 0 or 1.

    ``copies`` names a column of how often a labelled row counts.
    """
    characters = character_model(docs, text)
    rows = labelled.select(
        F.col(label).cast("int").alias("y"),
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"),
        F.col(text).cast("string").alias("text"),
    ).filter("y IN (0, 1) AND text IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(characters)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            words = [sorted(found) for found in _words_of(batch.column(2), restorer)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], ["y", "n", "words"]
            )

    rows = _share(rows, "text", most).mapInArrow(spelled, "y int, n long, words array<string>")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "labelled-words")
    by_label = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    counted = (
        rows.select("y", "n", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum(F.col("y") * F.col("n")).alias("toxic"), F.sum("n").alias("n"))
        .filter(F.col("toxic") >= LEAST_ROWS)
    )
    rate, z, n = F.col("toxic") / F.col("n"), 1.96, F.col("n")
    bound = (
        rate + z * z / (2 * n) - z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))
    ) / (1 + z * z / n)
    # Words of a bounded number of rows, each of them mostly toxic.
    names = sorted(r["word"] for r in counted.filter(bound >= 0.5).select("word").collect())
    if not names:
        return ToxicityModel(characters, {}, _cover([], [], by_label)[1])
    known = docs.sparkSession.createDataFrame(list(enumerate(names)), "k int, word string")
    sets = (
        rows.select("row", "y", "n", F.explode("words").alias("word"))
        .join(bounded_broadcast(known), "word")
        .groupBy("row", "y", "n")
        .agg(F.sort_array(F.collect_set("k")).alias("ks"))
        .groupBy("ks", "y")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    weight, base = _cover([(list(r["ks"]), r["y"], r["n"]) for r in sets], names, by_label)
    return ToxicityModel(characters, weight, base)


def score(
    docs: DataFrame,
    model: ToxicityModel,
    text: str = "text",
    name: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (all columns by default) and the toxicity of the restored text, 0 to 1."""
    keep = docs.columns if keep is None else keep
    hidden = fresh(docs, "scored_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias(hidden))
    schema = arrow_schema([(f.name, f.dataType) for f in rows.schema.fields[:-1]] + [(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, restorer = shared.value.words, Restorer(shared.value.characters)
        toxic = weights.keys()
        for batch in batches:
            found = []
            for words in _words_of(batch.column(batch.num_columns - 1), restorer):
                clean = 1 - shared.value.base
                for word in sorted(toxic & words):
                    clean *= 1 - weights[word]
                found.append(1 - clean)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
