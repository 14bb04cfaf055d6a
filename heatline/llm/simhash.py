"""Near duplicates by 64-bit fingerprints that differ in few bits, found with a Golay code.

A fingerprint is cut into three segments. Of up to two differing bits at least one
segment has none, and every other segment at most two. The perfect [23, 12] Golay
code turns a segment into the indices of the codewords that it or a word one bit
off decodes to: one or six of them, and two segments at most two bits apart share
one. So the bits of one segment, with a codeword index of the next, are a key that
linked fingerprints have in common.

Only distinct fingerprints are compared, so a group of copies counts once. Where a
key is shared by very many of them, an index of the third segment, which linked
fingerprints share as well, splits it further. A key's fingerprints leave as one
star for each connected set, never as pairs, and every comparison is of full bits.

Defined results: NULL, empty and blank texts have fingerprint zero and are linked
like any other. Repeated rows are documents of their own in the same component. A
component without any document id has a NULL ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.llm.batches import arrow_schema, flat, fresh
from heatline.llm.components import components
from heatline.operators.scale import stored, written

MOST_BITS = 2
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints with one key beyond which the third segment splits it.
CROWD = 4096
#: Generator polynomial of the [23, 12] code.
_GENERATOR = 0b110001110101
_SHINGLES = 1 << 15


def fingerprint(text: bytes, width: int) -> int:
    """Bitwise majority of the XXH64 (seed 42) of all ``width``-word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    first = np.append(0, ends[:-1] + 1)[: len(last)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(last), _SHINGLES):
        spans = zip(first[k : k + _SHINGLES].tolist(), last[k : k + _SHINGLES].tolist())
        found = np.array([digest(line[a:b], 42) for a, b in spans], ">u8")
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big")


def with_fingerprints(
    docs: DataFrame, width: int, text: str = "text", name: str = "fingerprint", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (all columns by default) and the fingerprint as a signed 64-bit integer."""
    keep = docs.columns if keep is None else keep
    hidden = fresh(docs, "hashed_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias(hidden))
    schema = arrow_schema([(f.name, f.dataType) for f in rows.schema.fields[:-1]] + [(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(batch.num_columns - 1))
            found = [
                fingerprint(data[a:b].tobytes(), width)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
            ]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], prints], schema.names)

    return rows.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of 23-bit words by byte (3 x 256), and the error each remainder means."""
    single = np.zeros(23, np.int64)
    for bit in range(23):
        rest = 1 << bit
        for high in range(bit, 10, -1):
            if rest >> high & 1:
                rest ^= _GENERATOR << (high - 11)
        single[bit] = rest
    remainders = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for bit in range(min(8, 23 - 8 * byte)):
            remainders[byte] ^= np.where(np.arange(256) >> bit & 1, single[8 * byte + bit], 0)
    errors = np.zeros(2048, np.int64)
    ones = [1 << b for b in range(23)]
    for a in range(23):
        errors[single[a]] = ones[a]
        for b in range(a):
            errors[single[a] ^ single[b]] = ones[a] | ones[b]
            for c in range(b):
                errors[single[a] ^ single[b] ^ single[c]] = ones[a] | ones[b] | ones[c]
    return remainders, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword at most three bits off each 23-bit word."""
    remainders, errors = _golay()
    rest = remainders[0][words & 255] ^ remainders[1][words >> 8 & 255] ^ remainders[2][words >> 16]
    return (words ^ errors[rest]) >> 11


def nearby_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and codeword index of each index that a word, or one a bit off, decodes to."""
    flips = np.append(0, 1 << np.arange(23))
    found = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def segments(prints: np.ndarray) -> list[np.ndarray]:
    bits = prints.view(np.uint64)
    return [
        (bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS
    ]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        cut = segments(prints)
        for k in range(3):
            row, index = nearby_indices(cut[(k + 1) % 3])
            key = (cut[k][row] * 3 + k) << 12 | index
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row])], ["key", "fp"])


def _split_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows for each codeword index of the segment that their key leaves out."""
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        prints = batch.column(1).to_numpy(zero_copy_only=False)
        third = np.choose(((key >> 12) % 3 + 2) % 3, segments(prints))
        row, index = nearby_indices(third)
        yield pa.RecordBatch.from_arrays(
            [pa.array((key[row] << 12 | index) + (1 << 62)), pa.array(prints[row])], ["key", "fp"]
        )


def _least_linked(prints: np.ndarray, bits: int) -> np.ndarray:
    """For each of some distinct sorted fingerprints, the least one it is linked with in them."""
    n = len(prints)
    label = np.arange(n)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            low = np.minimum(label[a], label[b])
            if np.array_equal(label[a], low) and np.array_equal(label[b], low):
                return
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while not np.array_equal(label, label[label]):
                label[:] = label[label]

    unsigned = prints.view(np.uint64)
    if n <= CROWD:
        for k in range(0, n, 256):
            a, b = np.nonzero(np.bitwise_count(unsigned[k : k + 256, None] ^ unsigned[None, :]) <= bits)
            join(a + k, b)
        return label
    # Linear in the group: look up every fingerprint that many bits off.
    ones = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = list(ones) if bits else []
    masks += [x | y for i, x in enumerate(ones) for y in ones[:i]] if bits > 1 else []
    for mask in masks:
        other = (unsigned ^ mask).view(np.int64)
        at = np.minimum(np.searchsorted(prints, other), n - 1)
        hit = np.flatnonzero(prints[at] == other)
        join(hit, at[hit])
    return label


def links(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(u, v) stars that connect distinct fingerprints (column ``fp``) as their links do."""
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"the code finds up to {MOST_BITS} differing bits")
    keyed = prints.select("fp").mapInArrow(_keys, "key long, fp long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = keyed.join(shared, "key")
    crowd = rows.filter(F.col("n") > CROWD).select("key", "fp").mapInArrow(_split_keys, "key long, fp long")
    rows = rows.filter(F.col("n") <= CROWD).select("key", "fp").union(crowd)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
            tails = np.append(heads[1:], len(key))
            pairs = heads[tails - heads == 2]
            near = np.bitwise_count((prints[pairs] ^ prints[pairs + 1]).view(np.uint64)) <= most_bits
            u, v = [prints[pairs[near] + 1]], [prints[pairs[near]]]
            for a, b in zip(heads[tails - heads > 2].tolist(), tails[tails - heads > 2].tolist()):
                own = prints[a:b]
                label = _least_linked(own, most_bits)
                joined = label != np.arange(b - a)
                u.append(own[joined])
                v.append(own[label[joined]])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"]
            )

        for batch in batches:
            held_key = np.append(held_key, batch.column(0).to_numpy(zero_copy_only=False))
            held = np.append(held, batch.column(1).to_numpy(zero_copy_only=False))
            if len(held_key):
                whole = int(np.searchsorted(held_key, held_key[-1]))
                yield found(held_key[:whole], held[:whole])
                held_key, held = held_key[whole:], held[whole:]
        yield found(held_key, held)

    return (
        rows.repartition("key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(stars, "u long, v long")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, width: int, most_bits: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; the fingerprint in hex."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = written(with_fingerprints(rows, width, keep=["doc_id"], name="fp"), "fingerprints")
    return grouped(prints, most_bits).drop("root")


def grouped(prints: DataFrame, most_bits: int) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with the hex fingerprint and component of every row."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, most_bits)).withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("fp", "component_id", "root")
    rest = [c for c in prints.columns if c not in ("doc_id", "fp")]
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *rest
    )


def representatives(
    docs: DataFrame, width: int, most_bits: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each component, the one with the least document id, all columns.

    Rows without an id come after those with one, and rows that share their id are in
    the order of a hash of all columns. Of rows that are equal altogether one stays.
    """
    hashed = [
        F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()
    ]
    names = {k: fresh(docs, k) for k in ("ra", "rb")}
    keyed = docs.withColumns(
        {names["ra"]: F.xxhash64(*hashed), names["rb"]: F.xxhash64(F.lit(11), *hashed)}
    )
    rows = keyed.select(
        F.col(doc_id).alias("doc_id"),
        F.col(names["ra"]).alias("ra"),
        F.col(names["rb"]).alias("rb"),
        F.col(text).alias("text"),
    )
    prints = written(
        with_fingerprints(rows, width, keep=["doc_id", "ra", "rb"], name="fp"), "fingerprints"
    )
    counted = grouped(prints, most_bits).groupBy("root", "doc_id", "ra", "rb").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "ra", "rb", "n")).alias("first")
    chosen = stored(
        counted.groupBy("root")
        .agg(first)
        .select(F.col("first.ra").alias(names["ra"]), F.col("first.rb").alias(names["rb"]), "first.n")
    )
    key, columns = list(names.values()), [F.col(f"`{c}`") for c in docs.columns]
    kept = keyed.join(chosen.filter("n = 1").select(*key), key, "left_semi")
    repeated = chosen.filter("n > 1").select(*key)
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates(key))
    return kept.select(*columns)
