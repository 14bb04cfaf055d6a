"""Documents packed into few sequences of bounded length, large items matched first.

A piece above a third of the capacity shares a sequence with at most one other
such piece. So those pieces are matched greedily, the longest first, each with the
longest one that still fits; then the smaller pieces, the longest first, go where
they leave the least room, and open a sequence where they fit nowhere.

Only how many pieces there are of each length decides the plan: it is made from
that histogram, of at most ``capacity`` rows, and names rank ranges of a length,
not pieces. Pieces get their rank in a length by counts over hash buckets, so a
length that holds most rows is dealt out like any other.

Defined results: NULL and empty texts are one piece of the end id alone; a text
whose ids just fill the capacity is one piece; equal pieces take ranks in the order
of their columns, and rows that are equal altogether can swap places.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.llm.batches import arrow_schema, crc_of
from heatline.llm.tokens import binaries, encoded
from heatline.operators.scale import written


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text's ids.

    Only documents longer than ``capacity`` are cut, and then only the first
    piece can be shorter than it.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = [
        ("doc_id", rows.schema["doc_id"].dataType),
        ("piece", T.IntegerType()),
        ("start", T.LongType()),
        ("length", T.LongType()),
        ("ids_crc32", T.LongType()),
    ]
    schema = arrow_schema(fields + [("ids", T.BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, ids, at in encoded(batch, tokenizer, end_id):
                size = np.diff(at)
                many = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                # The last piece ends with the document, and all but the first are full.
                last = size[row] - (many[row] - 1 - piece) * capacity
                start = np.maximum(last - capacity, 0)
                begin = at[row] + start
                raw = ids.astype("<u4")
                crc = [crc_of(raw[a : a + n]) for a, n in zip(begin, last - start)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + row)),
                        pa.array(piece, pa.int32()),
                        pa.array(start),
                        pa.array(last - start),
                        pa.array(crc, pa.int64()),
                        *([binaries(raw, np.append(begin, at[-1]))] if with_ids else []),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Entry:
    """``each`` pieces of a length go into every sequence from ``sequence`` on.

    They begin at ``offset``, and the first of them is the length's ``rank``-th.
    """

    length: int
    rank: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Entry], int]:
    """Where the pieces of each length go, and how many sequences there are."""
    left = dict(histogram)
    used: dict[int, int] = dict.fromkeys(left, 0)
    entries: list[Entry] = []
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def put(length: int, sequence: int, each: int, offset: int, pieces: int) -> None:
        entries.append(Entry(length, used[length], sequence, each, offset))
        used[length] += pieces
        left[length] -= pieces

    def open_room(gap: int, sequence: int, many: int) -> None:
        if gap and many:
            if gap not in room:
                insort(rooms, gap)
                room[gap] = []
            room[gap].append((sequence, many))

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            others = [k for k in large if k <= capacity - length and k <= length and left[k]]
            partner = others[-1] if others else 0
            if partner == length and left[length] == 1:
                partner = others[-2] if len(others) > 1 else 0
            many = left[length] // 2 if partner == length else left[length]
            many = min(many, left[partner]) if partner else many
            if partner == length:
                put(length, sequences, 2, 0, 2 * many)
            else:
                put(length, sequences, 1, 0, many)
                if partner:
                    put(partner, sequences, 1, length, many)
            open_room(capacity - length - partner, sequences, many)
            sequences += many

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                open_room(capacity, sequences, -(-left[length] // each))
                sequences += -(-left[length] // each)
                continue
            gap = rooms[at]
            sequence, many = room[gap].pop()
            if not room[gap]:
                del room[gap], rooms[at]
            each = min(gap // length, left[length])
            full = min(many, left[length] // each)
            put(length, sequence, each, capacity - gap, full * each)
            open_room(gap - each * length, sequence, full)
            open_room(gap, sequence + full, many - full)
    return entries, sequences


def pack(table: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """``table`` with ``sequence_id`` and ``offset`` of every row; read several times."""
    counts = {r[0]: r[1] for r in table.groupBy(length).agg(F.count("*")).collect()}
    if any(k is None or not 0 < k <= capacity for k in counts):
        raise ValueError(f"a length is not between 1 and {capacity}")
    entries, _ = plan(counts, capacity)
    entries.sort(key=lambda e: (e.length, e.rank))
    shared = table.sparkSession.sparkContext.broadcast(
        np.array([(e.length, e.rank, e.sequence, e.each, e.offset) for e in entries], np.int64).reshape(-1, 5)
    )

    buckets = max(1, math.isqrt(sum(counts.values()) // 100))
    dealt = table.withColumn("deal", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = (
        dealt.groupBy(length, "deal")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "before",
            F.sum("n").over(
                Window.partitionBy(length).orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(length, "deal", F.coalesce("before", F.lit(0)).alias("before"))
    )
    own = F.row_number().over(Window.partitionBy(length, "deal").orderBy(*order)) - 1
    ranked = (
        dealt.withColumn("own", own)
        .join(before, [length, "deal"])
        .select(*table.columns, (F.col("own") + F.col("before")).alias("rank"))
    )
    schema = arrow_schema(
        [(f.name, f.dataType) for f in table.schema.fields]
        + [("sequence_id", T.LongType()), ("offset", T.LongType())]
    )
    at = table.columns.index(length)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planned = shared.value
        places = planned[:, 0] << 44 | planned[:, 1]
        for batch in batches:
            size = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            _, start, sequence, each, offset = planned[
                np.searchsorted(places, size << 44 | rank, "right") - 1
            ].T
            more = rank - start
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(sequence + more // each),
                    pa.array(offset + more % each * size),
                ],
                schema.names,
            )

    return ranked.mapInArrow(placed, schema)


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    cut = written(pieces(docs, tokenizer, end_id, capacity, doc_id, text, with_ids), "pieces")
    return pack(cut, capacity, ["doc_id", "piece", "start", "ids_crc32"])
