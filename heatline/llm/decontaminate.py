"""Benchmark passages in training texts by a distributed positional inverted index.

``postings`` stores where each word of the benchmark stands in the training texts.
A passage is a window of consecutive item words. Its two rarest words, by their
number of postings, are looked up first: a posting less the word's place in the
item is where the item would begin, and words of one item that agree on it form an
alignment. Only alignments with both rare words of some window have their other
words intersected too, and only in texts that have such an alignment. Runs of
agreeing words as long as the window are the exact matches. ``near`` finds
texts where all words of an item stand close to its rarest one, in any order.

All of it is DataFrame work. Words outside the benchmark never leave the scan, a
frequent passage is spread over the texts it stands in, and what is broadcast is
counted before.

Defined results: NULL and empty texts have no words and no hits; items without
words match nothing. Items shorter than the window are one window. Rows that share
an id are texts of their own, and rows that are equal altogether get equal results.
An item without an id counts hits but is in no list of items.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatline.llm.batches import fresh
from heatline.operators.scale import bounded_broadcast, stored, written

#: Fixed value: what stands between words, ASCII other than digits and small letters.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts with an alignment up to which their keys are broadcast.
BROADCAST_TEXTS = 500_000
_TEXT = ["d", "h"]


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for NULL."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.coalesce(F.array_remove(F.split(low, BETWEEN_WORDS), ""), F.array().cast("array<string>"))


def _text_key(doc_id: str, text: str) -> dict[str, Column]:
    """Two hashes of a row, which repeated rows share and no others do."""
    name, body = F.col(doc_id), F.col(text).cast("string")
    return {
        "d": F.xxhash64(F.coalesce(name.cast("string"), F.lit("")), name.isNull()),
        "h": F.xxhash64(F.coalesce(body, F.lit(""))),
    }


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    key = [column.alias(name) for name, column in _text_key(doc_id, text).items()]
    return docs.select(F.col(doc_id).alias("doc_id"), *key, F.col(text).cast("string").alias("text"))


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, j, length, term, term_id): the words of all items in order."""
    rows = items.select(
        F.col(item_id).cast("string").alias("item_id"), words(F.col(text).cast("string")).alias("ws")
    ).distinct()
    rows = rows.withColumn("item", F.xxhash64("item_id", "ws")).select(
        "item", "item_id", F.size("ws").alias("length"), F.posexplode("ws").alias("j", "term")
    )
    rows = stored(rows)
    terms = stored(
        rows.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id() + 1)
    )
    return stored(rows.join(terms, "term"))


def postings(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, h, pos, term_id) of every occurrence of the terms, written to the shared folder.

    Every text also has a posting of term 0 behind its last word.
    """
    known = terms.select("term", "term_id").distinct()
    known = bounded_broadcast(known.union(known.sparkSession.sql("SELECT '' AS term, 0L AS term_id")))
    found = _keyed(docs, doc_id, text).select(
        *_TEXT, F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("pos", "term")
    )
    return written(found.join(known, "term").select(*_TEXT, "pos", "term_id"), "postings")


def _windows(terms: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """(item, w, m, j1, j2): each window's first place, length and two rarest words' places."""
    counts = index.groupBy("term_id").agg(F.count("*").alias("n"))
    m = F.least("length", F.lit(size))
    spread = (
        terms.join(counts, "term_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("m", m)
        .withColumn(
            "w",
            F.explode(
                F.sequence(
                    F.greatest(F.lit(0), F.col("j") - F.col("m") + 1),
                    F.least("j", F.col("length") - F.col("m")),
                )
            ),
        )
    )
    rank = F.row_number().over(Window.partitionBy("item", "w").orderBy("n", "j"))
    return (
        spread.withColumn("k", rank)
        .groupBy("item", "w", "m")
        .agg(
            F.max(F.when(F.col("k") == 1, F.col("j"))).alias("j1"),
            F.max(F.when(F.col("k") == F.least(F.lit(2), "m"), F.col("j"))).alias("j2"),
            F.min("n").alias("n"),
        )
        .filter("n > 0")
        .drop("n")
    )


def phrase_matches(index: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """(d, h, pos, item): every text word inside an occurrence of a window of ``size`` words."""
    windows = stored(_windows(terms, index, size))
    rare = windows.select("item", F.explode(F.array("j1", "j2")).alias("j")).distinct()
    rare = terms.select("item", "j", "term_id").join(rare, ["item", "j"])
    key = [*_TEXT, "item", "start"]
    agreeing = (
        index.join(bounded_broadcast(rare), "term_id")
        .withColumn("start", F.col("pos") - F.col("j"))
        .groupBy(*key)
        .agg(F.collect_set("j").alias("js"))
    )
    by_item = windows.groupBy("item").agg(
        F.min("m").alias("m"), F.collect_list(F.struct("w", "j1", "j2")).alias("windows")
    )
    aligned = agreeing.join(bounded_broadcast(by_item), "item").withColumn(
        "windows",
        F.filter(
            "windows", lambda x: F.array_contains("js", x["j1"]) & F.array_contains("js", x["j2"])
        ),
    )
    aligned = written(aligned.filter(F.size("windows") > 0).select(*key, "m", "windows.w"), "alignments")
    asked = (
        aligned.withColumn("w", F.explode("w"))
        .withColumn("j", F.explode(F.sequence(F.col("w"), F.col("w") + F.col("m") - 1)))
        .select(*key, "m", "j")
        .distinct()
        .join(bounded_broadcast(terms.select("item", "j", "term_id")), ["item", "j"])
        .withColumn("pos", F.col("start") + F.col("j"))
    )
    texts = bounded_broadcast(aligned.select(*_TEXT).distinct(), BROADCAST_TEXTS)
    lists = index.filter("term_id != 0").join(texts, _TEXT, "left_semi")
    matched = asked.join(lists, [*_TEXT, "pos", "term_id"], "left_semi")
    run = F.col("j") - F.row_number().over(Window.partitionBy(*key).orderBy("j"))
    matched = matched.withColumn("run", run)
    long = F.count("*").over(Window.partitionBy(*key, "run")) >= F.col("m")
    return matched.withColumn("long", long).filter("long").select(*_TEXT, "pos", "item")


def near(index: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """(d, h, item, pos, first, last): where all distinct words of an item are close together.

    ``pos`` is an occurrence of the item's rarest word and every other word stands
    at most ``slop`` words away from it; ``first`` and ``last`` are the outermost.
    """
    counts = index.groupBy("term_id").agg(F.count("*").alias("n"))
    distinct = terms.select("item", "term_id").distinct().join(counts, "term_id", "left")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "term_id"))
    many = F.count("*").over(Window.partitionBy("item"))
    ranked = bounded_broadcast(
        distinct.select("item", "term_id", rank.alias("k"), many.alias("many"))
    )
    found = index.join(ranked, "term_id").withColumn("cell", F.floor(F.col("pos") / max(slop, 1)))
    centre = found.filter("k = 1").select(
        *_TEXT,
        "item",
        "many",
        F.col("pos").alias("at"),
        F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"),
    ).distinct()
    others = found.select(*_TEXT, "item", "cell", "pos", "term_id")
    return (
        centre.join(others, [*_TEXT, "item", "cell"])
        .filter(F.abs(F.col("pos") - F.col("at")) <= slop)
        .groupBy(*_TEXT, "item", "at")
        .agg(
            F.count_distinct("term_id").alias("n"),
            F.first("many").alias("many"),
            F.min("pos").alias("first"),
            F.max("pos").alias("last"),
        )
        .filter("n = many")
        .select(*_TEXT, "item", F.col("at").alias("pos"), "first", "last")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, d, h, n_words, n_hit, items) of every row; ``items`` are sorted item ids as text."""
    terms = item_words(items, item_id, item_text)
    index = postings(docs, terms, doc_id, text)
    hits = phrase_matches(index, terms, size)
    names = bounded_broadcast(terms.select("item", "item_id").distinct())
    by_text = (
        hits.join(names, "item")
        .groupBy(*_TEXT)
        .agg(F.count_distinct("pos").alias("n_hit"), F.collect_set("item_id").alias("items"))
    )
    lengths = index.filter("term_id = 0").groupBy(*_TEXT).agg(F.max("pos").cast("long").alias("n_words"))
    return (
        _keyed(docs, doc_id, text)
        .select("doc_id", *_TEXT)
        .join(lengths, _TEXT)
        .join(by_text, _TEXT, "left")
        .select(
            "doc_id",
            *_TEXT,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.array_sort("items"), F.array().cast("array<string>")).alias("items"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` without a hit, all their columns."""
    found = contamination(docs.select(doc_id, text), items, size, doc_id, text)
    bad = found.filter("n_hit > 0").select(*_TEXT).distinct()
    names = {k: fresh(docs, k) for k in _TEXT}
    keyed = docs.withColumns({names[k]: v for k, v in _text_key(doc_id, text).items()})
    bad = bad.withColumnsRenamed(names)
    return keyed.join(bad, list(names.values()), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
