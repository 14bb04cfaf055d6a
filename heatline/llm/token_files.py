"""Token ids in files of independent blocks under one canonical Huffman code.

A folder holds two Parquet tables. ``code`` has the code length of every id that
occurs, from counts over the whole corpus and at most ``MOST_BITS``; lengths alone
fix the canonical code. ``blocks`` has whole documents in ascending id order: their
ids as one bit string, the ids before the block in its part, and the bit offset of
every ``CHECKPOINT``-th id. A reader decodes all stretches between checkpoints
side by side with one lookup table.

Defined results: NULL and empty texts are a document of the end id alone. NULL
document ids come first. Rows that share a document id are documents of their own,
ordered by a hash of their ids; rows equal altogether are interchangeable. An
empty table gives an empty ``blocks`` table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.llm.batches import arrow_schema, flat
from heatline.llm.tokens import binaries, encoder, tokenized
from heatline.operators.scale import written

MOST_BITS = 18
CHECKPOINT = 256
#: A block ends with the document that fills it.
BLOCK_IDS = 1 << 18


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n > 1 << most:
        raise ValueError(f"{n} ids do not fit codes of {most} bits")
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(most):
        both = np.concatenate((coins, packages))
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        both = both[rank]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(levels):
        coins_taken = int(single[:take].sum())
        lengths[:coins_taken] += 1
        take = 2 * (take - coins_taken)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths and codes ordered by (length, id); the codes count upwards."""
    order = np.lexsort((ids, lengths))
    ids, lengths = ids[order], lengths[order]
    steps = np.int64(1) << (MOST_BITS - lengths)
    codes = (np.cumsum(steps) - steps) >> (MOST_BITS - lengths)
    return ids, lengths, codes


def to_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ``ids`` and the bit offset of every ``CHECKPOINT``-th one."""
    size = lengths[ids]
    ends = np.cumsum(size)
    begins = ends - size
    words = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    word, shift = begins >> 6, 64 - (begins & 63) - size
    value = codes[ids].astype(np.uint64)
    over = shift < 0
    here = np.where(
        over, value >> np.maximum(-shift, 0).astype(np.uint64), value << np.maximum(shift, 0).astype(np.uint64)
    )
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[heads]] = np.bitwise_or.reduceat(here, heads)
    words[word[over] + 1] |= value[over] << (64 + shift[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) >> 3], begins[::CHECKPOINT]


def from_bits(
    bits: bytes, places: np.ndarray, n: int, symbols: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """The ``n`` ids of a bit string; every checkpoint's stretch advances in step."""
    raw = np.frombuffer(bits + bytes(CHECKPOINT * MOST_BITS // 8 + 8), np.uint8).astype(np.uint32)
    wide = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.array(places, np.int64)
    out = np.zeros((CHECKPOINT, len(at)), np.uint32)
    for step in range(min(CHECKPOINT, n)):
        seen = (wide[at >> 3] >> (32 - MOST_BITS - (at & 7)).astype(np.uint32)) & ((1 << MOST_BITS) - 1)
        out[step] = symbols[seen]
        at += sizes[seen]
        # The last stretch may be short; what it reads beyond its end is cut off.
        np.minimum(at, len(wide) * 8 - 1, out=at)
    return out.T.ravel()[:n]


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Tokenize whole texts and write the two tables below ``path``."""
    spark = docs.sparkSession
    width = 2 if max(end_id, encoder(tokenizer).tokenizer.get_vocab_size() - 1) < 1 << 16 else 4
    ids = tokenized(docs, tokenizer, end_id, doc_id, text, width)
    ids = written(ids.withColumn("deal", F.crc32("ids")), "token-ids")

    def count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            found = np.bincount(flat(batch.column(0))[0].view(f"<u{width}"))
            counts = np.pad(counts, (0, max(0, len(found) - len(counts))))
            counts[: len(found)] += found
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(count_ids, "id long, n long").groupBy("id")
    # One row for each id of the vocabulary at most.
    counts = counts.agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    used, lengths, codes = canonical(
        counts["id"].to_numpy(np.int64),
        code_lengths(counts["n"].to_numpy(np.int64)) if len(counts) else np.zeros(0, np.int64),
    )
    spark.createDataFrame(
        pa.table({"id": pa.array(used, pa.int64()), "bits": pa.array(lengths, pa.int32())})
    ).coalesce(1).write.parquet(f"{path}/code")

    most = int(used.max(initial=0)) + 1
    by_id = np.zeros((2, most), np.int64)
    by_id[:, used] = codes, lengths
    shared = spark.sparkContext.broadcast(by_id)
    kind = ids.schema["doc_id"].dataType
    schema = arrow_schema(
        [
            ("part", T.IntegerType()),
            ("before", T.LongType()),
            ("n_ids", T.LongType()),
            ("doc_ids", T.ArrayType(kind)),
            ("n_tokens", T.ArrayType(T.LongType())),
            ("checkpoints", T.ArrayType(T.LongType())),
            ("bits", T.BinaryType()),
        ]
    )

    def block(part: int, before: int, docs: list[pa.Array], sizes: list, values: list):
        symbols = np.concatenate(values)
        bits, places = to_bits(symbols, *shared.value)
        row = [
            pa.array([part], pa.int32()),
            pa.array([before]),
            pa.array([len(symbols)]),
            *(
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                for x in (pa.concat_arrays(docs), pa.array(np.concatenate(sizes)), pa.array(places))
            ),
            pa.array([bits]),
        ]
        return pa.RecordBatch.from_arrays(row, schema.names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held = TaskContext.get().partitionId(), 0, 0
        docs, sizes, values = [], [], []
        for batch in batches:
            data, offsets = flat(batch.column(1))
            data, offsets = data.view(f"<u{width}"), offsets // width
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(offsets, offsets[first] + BLOCK_IDS - held))
                last = min(max(last, first + 1), batch.num_rows)
                docs.append(batch.column(0).slice(first, last - first))
                sizes.append(np.diff(offsets[first : last + 1]))
                values.append(np.array(data[offsets[first] : offsets[last]]))
                held += len(values[-1])
                first = last
                if held >= BLOCK_IDS:
                    yield block(part, before, docs, sizes, values)
                    before, held = before + held, 0
                    docs, sizes, values = [], [], []
        if docs:
            yield block(part, before, docs, sizes, values)

    (
        ids.repartitionByRange("doc_id", "deal")
        .sortWithinPartitions("doc_id", "deal")
        .select("doc_id", "ids")
        .mapInArrow(blocks, schema)
        .write.parquet(f"{path}/blocks")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids as little-endian 32-bit integers."""
    blocks = spark.read.parquet(f"{path}/blocks")
    code = spark.read.parquet(f"{path}/code").toPandas()
    symbols, lengths, _ = canonical(code["id"].to_numpy(np.int64), code["bits"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast((symbols, lengths))
    # One small row for each file part.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("part")
    bases = dict(zip(parts["part"].tolist(), (parts["n"].cumsum() - parts["n"]).tolist()))
    based = spark.sparkContext.broadcast(bases)
    schema = arrow_schema(
        [
            ("doc_id", blocks.schema["doc_ids"].dataType.elementType),
            ("start", T.LongType()),
            ("n_tokens", T.LongType()),
            ("ids", T.BinaryType()),
        ]
    )

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bits = shared.value
        lookup = np.zeros(1 << MOST_BITS, np.uint32)
        sizes = np.zeros(1 << MOST_BITS, np.int64)
        spans = np.int64(1) << (MOST_BITS - bits)
        lookup[: spans.sum()], sizes[: spans.sum()] = np.repeat(names, spans), np.repeat(bits, spans)
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                docs, counts = columns["doc_ids"][k].values, columns["n_tokens"][k].values.to_numpy()
                found = from_bits(
                    columns["bits"][k].as_py(),
                    columns["checkpoints"][k].values.to_numpy(),
                    columns["n_ids"][k].as_py(),
                    lookup,
                    sizes,
                )
                at = np.append(0, np.cumsum(counts))
                base = based.value[columns["part"][k].as_py()] + columns["before"][k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(base + at[:-1]), pa.array(counts), binaries(found.astype("<u4"), at)],
                    schema.names,
                )

    return blocks.mapInArrow(decoded, schema)
