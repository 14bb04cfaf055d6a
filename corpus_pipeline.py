"""From raw documents to packed training sequences, stage by stage.

``STAGES`` are (name, function) pairs in order. Each function takes the session, the
documents that its predecessor kept and the folder of the driver tables; all but the
last return rows with the columns of documents. ``run`` writes every stage's rows
to the shared folder and reads them back for the next one, so a lost executor costs
one stage's tasks and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatline.llm import decontaminate, languages, packing, repeats, simhash
from heatline.llm.batches import fresh, prepared
from heatline.operators.scale import written

#: Posterior below which a language counts as not recognised.
LEAST_POSTERIOR = 0.5
REPEATED_BYTES = 200
PASSAGE_WORDS = 10
CAPACITY = 2048


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; without any language to learn, all."""
    prepared(spark)
    model = languages.train(docs)
    if not model.names:
        return docs
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = languages.predict(docs, model, lang_pred=lang, score=score)
    known = (F.col(lang) != languages.UNKNOWN) & (F.col(score) >= LEAST_POSTERIOR)
    return found.filter(known).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    prepared(spark)
    return simhash.representatives(docs, width=3, most_bits=2)


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated 200-byte strings; ``n_chars`` follows the text."""
    prepared(spark)
    kept = repeats.without_repeats(docs, REPEATED_BYTES)
    if "n_chars" not in kept.columns:
        return kept
    kind = kept.schema["n_chars"].dataType
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    items = prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items, PASSAGE_WORDS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place."""
    prepared(spark)
    return packing.packed(docs, "byte_bpe_50k.json", end_id=0, capacity=CAPACITY)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_bytes", remove_repeated_bytes),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]
#: SQL has no tokenizer and no fingerprints; a brute-force version tests the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
