"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

Codes are cut into segments. Two codes at distance d have a segment at distance
d / segments at most, so probing all segments up to radius r finds every code up to
distance ``segments * (r + 1) - 1``. The radius grows until each query's k-th
verified distance is within that; then no unseen code can be nearer.

A code of up to 64 bits is one long; a longer one is an array of longs, as many for every
vector of the table, and each of its longs is cut into segments.

Equal codes are one entry of the index with its least k + 1 identifiers, so copies
are neither probed nor joined one by one. A code is taken at the first segment and
radius that reach it, which leaves no duplicates to remove. Each round's best rows are
checkpointed in the shared folder.

Defined results: the k least (distance, identifier) pairs, the query's own identifier
left out, fewer if the table has fewer. Rows without an identifier or a vector are
neither indexed nor queried. NULL and NaN components count as not positive, as do those
that a vector has not but others of its table have. Rows that
repeat an identifier and a code are one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.operators.scale import stored

BITS = 64


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): bit k of the code is set where component k is positive.

    Beyond 64 components bit k is bit ``k % 64`` of the code's long ``k // 64``.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).dropna()
    size = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    longs = []
    for first in range(0, max(size, 1), BITS):
        code = F.lit(0).cast("long")
        for k in range(first, min(first + BITS, size)):
            part = F.get("vector", F.lit(k))
            set_bit = (part > 0) & ~F.isnan(part)
            bit = F.shiftleft(F.lit(1).cast("long"), k - first)
            code = code.bitwiseOR(F.when(set_bit, bit).otherwise(F.lit(0)))
        longs.append(code)
    code = longs[0] if len(longs) == 1 else F.array(*longs)
    return rows.select("id", code.alias("code")).distinct()


def _longs(codes: DataFrame) -> int:
    """How many longs a code has; 0 if it is a plain long."""
    if not isinstance(codes.schema["code"].dataType, T.ArrayType):
        return 0
    found = codes.agg(F.min(F.size("code")), F.max(F.size("code"))).first()
    if found[0] != found[1]:
        raise ValueError("codes differ in length")
    return found[0] or 1


def _parts(name: str, longs: int) -> list[Column]:
    return [F.get(name, F.lit(k)) for k in range(longs)] if longs else [F.col(name)]


def _spans(segments: int, longs: int) -> list[tuple[int, int, int]]:
    """Long, first bit and width of each segment, ``segments`` to a long."""
    ends = [BITS * k // segments for k in range(segments + 1)]
    return [(part, a, b - a) for part in range(max(longs, 1)) for a, b in zip(ends, ends[1:])]


def _piece(parts: list[Column], part: int, at: int, width: int) -> Column:
    mask = -1 if width == BITS else (1 << width) - 1
    return F.shiftrightunsigned(parts[part], at).bitwiseAND(F.lit(mask).cast("long"))


def _probes(queries: DataFrame, spans: list[tuple[int, int, int]], longs: int, radius: int) -> DataFrame:
    """(q, code, s, value): each query's segments with exactly ``radius`` bits flipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {
            width: np.array(
                [sum(1 << b for b in c) for c in combinations(range(width), radius)], np.uint64
            )
            for _, _, width in spans
        }
        for batch in batches:
            names, codes = batch.columns
            flat = codes.flatten() if longs else codes
            table = flat.to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(names), -1)
            for s, (part, at, width) in enumerate(spans):
                mask = np.uint64((1 << width) - 1)
                own = table[:, part] >> np.uint64(at) & mask
                each = len(flips[width])
                step = max(1, (1 << 20) // (max(each, 1) * max(longs, 1)))
                for k in range(0, len(names) if each else 0, step):
                    value = (own[k : k + step, None] ^ flips[width][None, :]).ravel()
                    row = pa.array(np.repeat(np.arange(k, k + len(value) // each), each))
                    yield pa.RecordBatch.from_arrays(
                        [names.take(row), codes.take(row), pa.array(np.full(len(value), s, np.int32)),
                         pa.array(value.view(np.int64))],
                        ["q", "code", "s", "value"],
                    )

    code = "array<long>" if longs else "long"
    return queries.select("q", "code").mapInArrow(run, f"q long, code {code}, s int, value long")


def top_k(codes: DataFrame, queries: DataFrame, k: int, segments: int | None = None) -> DataFrame:
    """(q, id, distance, rank) of the ``k`` nearest ``codes`` (id, code) of each query (q, code).

    ``segments`` are those of each long. Without it there are so many that a segment's
    values are about as many as the codes, which keeps probes and their hits in balance.
    """
    codes = stored(codes)
    queries = stored(queries)
    by_id = Window.partitionBy("code").orderBy("id")
    entries = stored(
        codes.withColumn("n", F.row_number().over(by_id))
        .filter(F.col("n") <= k + 1)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    total, distinct = codes.count(), entries.count()
    segments = segments or min(8, max(2, round(BITS / max(1.0, math.log2(max(distinct, 2))))))
    longs = _longs(entries)
    spans = _spans(segments, longs)
    code = _parts("code", longs)
    index = entries.select(
        F.posexplode(F.array(*[_piece(code, *span) for span in spans])).alias("s", "value"),
        F.col("code").alias("other"),
        "ids",
    )
    own = codes.select(F.col("id").alias("q"), F.col("code"), F.lit(1).alias("self"))
    queries = stored(
        queries.join(own, ["q", "code"], "left").select(
            "q", "code", F.least(F.lit(k), F.lit(total) - F.coalesce("self", F.lit(0))).alias("need")
        )
    )
    best, open_queries = None, queries
    nearest = Window.partitionBy("q", "code").orderBy("distance", "id")
    for radius in range(max(width for _, _, width in spans) + 1):
        probes = _probes(open_queries, spans, longs, radius)
        gap = [a.bitwiseXOR(b) for a, b in zip(code, _parts("other", longs))]
        distance = reduce(Column.__add__, [F.bit_count(part) for part in gap])
        # The first (radius, segment) that reaches a code is the only one to report it.
        reached = F.array(
            *[F.bit_count(_piece(gap, *span)) * len(spans) + s for s, span in enumerate(spans)]
        )
        found = (
            probes.join(index, ["s", "value"])
            .filter(F.array_min(reached) == F.lit(radius * len(spans)) + F.col("s"))
            .select("q", "code", distance.alias("distance"), F.explode("ids").alias("id"))
            .filter("id != q")
        )
        best = found if best is None else best.unionByName(found)
        best = stored(
            best.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).drop("rank")
        )
        covered = len(spans) * (radius + 1) - 1
        state = best.groupBy("q", "code").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        open_queries = stored(
            queries.join(state, ["q", "code"], "left")
            .filter(
                (F.coalesce("n", F.lit(0)) < F.col("need"))
                | ((F.col("n") >= k) & (F.col("far") > covered))
            )
            .select(*queries.columns)
        )
        if open_queries.isEmpty():
            break
    return best.withColumn("rank", F.row_number().over(nearest)).select("q", "id", "distance", "rank")
