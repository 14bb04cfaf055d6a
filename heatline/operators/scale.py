"""Series-wide windows and ranks that never put a whole series into one task.

A telemetry fleet has few series (eight modules on a site) and any one of them
may hold a third of the rows, so ``Window.partitionBy(module)`` would leave a
handful of endless tasks. ``over_ordered`` counts the rows of each series, leaves those
that fit a task alone, cuts each longer one into chunks of about ``limit`` rows, gives every chunk the few preceding rows its windows look back
on, and returns the same values the unsplit window would.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.session import scratch_path, shared_folder

ROWS_PER_CHUNK = 1_000_000
BROADCAST_ROWS = 2_000_000
_REFINE_BITS = 8
_BINS = 1024


def rows_per_chunk(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.heatline.rowsPerChunk", str(ROWS_PER_CHUNK)))


def stored(df: DataFrame) -> DataFrame:
    """A small result checkpointed in the shared folder, its lineage cut there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """A derived table of any size written to the shared folder and read back.

    For tables read in several passes: each pass then reads only the columns it
    needs instead of deriving the rows again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count shows it is small; else leave the join to AQE."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= max_rows else df


def dealt(df: DataFrame, keys: list[str], rows: int | None) -> DataFrame:
    """``df`` dealt by ``keys``, ready to be grouped by them, in parts of few rows.

    The session's shuffle partitions are a fixed number and neighbours are merged by their
    compressed size, so the table of groups that one task holds grows with the input. Where
    ``rows``, the number of rows, is given and beyond one chunk, parts get a chunk's rows at
    most, keys lying evenly.
    """
    chunk = rows_per_chunk(df.sparkSession)
    if rows is None or rows <= chunk or not keys:
        return df
    parts = max(math.ceil(rows / chunk), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def evenly(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt in turn into as few parts as hold about ``rows`` rows each.

    A file is read in parts by its bytes while its rows may stand in one block, so a few MB
    make one full part and several empty ones. Where many short jobs run over one table,
    each empty part costs as much as a small full one. Rows are counted before they are moved.
    """
    return df.repartition(max(math.ceil(df.count() / rows), 1))


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs."""
    return reduce(
        lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs], F.lit(True)
    )


def by(keys: list[str]) -> list[Column]:
    """Window partition columns; one literal where the table is a single series."""
    return [F.col(k) for k in keys] or [F.lit(0)]


def _as_long(df: DataFrame, name: str) -> Column | None:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    return None


def over_ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    position: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add the window columns of ``build`` over each key's ordered series.

    ``build`` gets a window spec and may look at most ``reach`` rows back.
    ``order`` starts with a timestamp or integer column without NULLs; further
    columns break ties. ``position`` names an optional 0-based row number.

    Rows are counted before they are moved, so ``df`` is read at least twice:
    give it a stored table, or a derived one through ``written``.
    """
    limit = max(limit or rows_per_chunk(df.sparkSession), reach, 1)
    long_ones = _long_series(df, keys, order, limit)
    if long_ones.isEmpty():
        window = Window.partitionBy(*by(keys)).orderBy(*order)
        added = build(window)
        if position:
            added[position] = (F.row_number().over(window) - 1).cast("long")
        return df.withColumns(added)

    names = df.columns
    side = bounded_broadcast(long_ones.withColumnsRenamed({k: f"_l_{k}" for k in keys}))
    routed = df.join(side, same(df, side, [(k, f"_l_{k}") for k in keys]), "left")
    routed, columns = routed.select(*names, "_origin", "_shift"), []
    for at, (level, table) in enumerate(_routes(df, long_ones, keys, order, reach, limit)):
        joined = routed.withColumns(
            {f"_b{i}": value for i, value in enumerate(level.buckets(df, order))}
        )
        pairs = [(k, f"_{at}_{k}") for k in keys]
        pairs += [(f"_b{i}", f"_{at}_b{i}") for i in range(level.depth + 1)]
        table = table.select(
            *[F.col(a).alias(b) for a, b in pairs], F.col("_routes").alias(f"_routes{at}")
        )
        columns.append(f"_routes{at}")
        routed = joined.join(
            bounded_broadcast(table), same(joined, table, pairs), "left"
        ).select(*names, "_origin", "_shift", *columns)
    # A series that fits one chunk has no routes: it is a chunk of its own.
    whole = F.struct(F.lit(0).cast("long").alias("_chunk"), F.lit(False).alias("_halo"),
                     F.lit(0).cast("long").alias("_start"))
    spread = routed.select(*names, F.explode(F.coalesce(*columns, F.array(whole))).alias("_route"))
    spread = spread.select(*names, "_route.*")
    # The chunk comes first: as a number it sorts by prefix, a name does not.
    window = Window.partitionBy("_chunk", *keys).orderBy(*order)
    added = build(window)
    if position:
        added[position] = F.col("_start") + F.row_number().over(window) - 1
    return (
        spread.withColumns(added)
        .filter(~F.col("_halo"))
        .drop("_chunk", "_halo", "_start")
    )


def _long_series(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Series of more than ``limit`` rows: keys, first value and a bucket width in bits.

    A bucket of a series would hold a quarter of ``limit`` if its rows lay evenly.
    """
    first = _as_long(df, order[0])
    if first is None:
        raise TypeError(f"{order[0]} must be a timestamp or an integer to order a series")
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(first).alias("_origin"), F.max(first).alias("_high")
    )
    span = F.col("_high").cast("double") - F.col("_origin") + 1
    width = F.greatest(F.floor(F.log2(span * (limit / 4) / F.col("_n"))), F.lit(0))
    return stored(
        counted.filter(F.col("_n") > limit).select(*keys, "_origin", width.cast("int").alias("_shift"))
    )


class _Level:
    """Buckets by column ``depth`` of the order, narrowed by ``step`` times some bits."""

    def __init__(self, depth: int, step: int):
        self.depth, self.step = depth, step

    def shift(self) -> Column:
        start = F.col("_shift") if self.depth == 0 else F.lit(64 - _REFINE_BITS)
        return F.greatest(start - _REFINE_BITS * self.step, F.lit(0))

    def buckets(self, df: DataFrame, order: list[str]) -> list[Column]:
        values = [_as_long(df, order[i]) for i in range(self.depth + 1)]
        values[0] = values[0] - F.col("_origin")
        values[-1] = F.call_function("shiftright", values[-1], self.shift())
        return values

    def finer(self, widest: int, usable: int) -> _Level | None:
        start = widest if self.depth == 0 else 64 - _REFINE_BITS
        if start > _REFINE_BITS * self.step:
            return _Level(self.depth, self.step + 1)
        if self.depth + 1 < usable:
            return _Level(self.depth + 1, 0)
        return None


def _routes(
    df: DataFrame, long_ones: DataFrame, keys: list[str], order: list[str], reach: int, limit: int
) -> list[tuple[_Level, DataFrame]]:
    """Per bucket of the long series, the chunks its rows belong to."""
    usable = 1
    while usable < len(order) and _as_long(df, order[usable]) is not None:
        usable += 1
    widest = long_ones.agg(F.max("_shift")).head()[0]
    level = _Level(0, 0)
    starts = [f"_s{i}" for i in range(usable)]
    side = bounded_broadcast(long_ones.withColumnsRenamed({k: f"_l_{k}" for k in keys}))
    source = df.join(side, same(df, side, [(k, f"_l_{k}") for k in keys]))
    columns = [*keys, *order[:usable], "_origin", "_shift"]
    source = source.select(*columns)
    leaves, levels = [], []
    while level is not None:
        names = [f"_b{i}" for i in range(level.depth + 1)]
        cut = source.withColumns(dict(zip(names, level.buckets(df, order))))
        cut = cut.withColumn("_bits", level.shift())
        counts = stored(cut.groupBy(*keys, *names, "_bits").agg(F.count(F.lit(1)).alias("_rows")))
        child = level.finer(widest, usable)
        hot = counts.filter(F.col("_rows") > limit // 2) if child else None
        if hot is None or hot.isEmpty():
            child, cold = None, counts
        else:
            cold = counts.filter(F.col("_rows") <= limit // 2)
            pairs = [(c, f"_h_{c}") for c in [*keys, *names]]
            wanted = bounded_broadcast(hot.select(*[F.col(a).alias(b) for a, b in pairs]))
            source = cut.join(wanted, same(cut, wanted, pairs), "left_semi").select(*columns)
        begin = {f"_s{i}": F.col(f"_b{i}") for i in range(level.depth)}
        begin[f"_s{level.depth}"] = F.call_function("shiftleft", F.col(f"_b{level.depth}"), F.col("_bits"))
        for name in starts[level.depth + 1 :]:
            begin[name] = F.lit(None).cast("long")
        for i in range(level.depth + 1, usable):
            begin[f"_b{i}"] = F.lit(None).cast("long")
        leaves.append(cold.withColumns(begin).drop("_bits").withColumn("_level", F.lit(len(levels))))
        levels.append(level)
        level = child

    # From here on only bucket counts move: about 4 * rows / limit of them.
    before = (
        Window.partitionBy(*by(keys))
        .orderBy(*[F.col(s).asc_nulls_first() for s in starts])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    leaf = reduce(DataFrame.unionByName, leaves)
    leaf = leaf.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    leaf = stored(leaf.withColumn("_chunk", F.expr(f"_first div {limit}")))
    buckets = [f"_b{i}" for i in range(usable)]
    place = leaf.select(
        *keys, "_level", *buckets, "_chunk", F.lit(False).alias("_halo"), "_first"
    )
    if reach:
        bases = leaf.groupBy(*keys, "_chunk").agg(F.min("_first").alias("_base"))
        bases = bases.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_chunk", "_base")
        end = F.col("_first") + F.col("_rows")
        later = leaf.withColumn("_end", end).withColumn(
            "_later", F.explode(F.expr(f"sequence(_end div {limit}, (_end + {reach - 1}) div {limit})"))
        ).drop("_chunk")
        pairs = [(k, f"_c_{k}") for k in keys] + [("_later", "_chunk")]
        near = later.join(bases, same(later, bases, pairs)).filter(
            (F.col("_base") >= F.col("_end")) & (F.col("_base") < F.col("_end") + reach)
        )
        place = place.unionByName(
            near.select(*keys, "_level", *buckets, "_chunk", F.lit(True).alias("_halo"), "_first")
        )
    begun = Window.partitionBy(*keys, "_chunk")
    place = place.withColumn("_start", F.min("_first").over(begun))
    table = stored(
        place.groupBy(*keys, "_level", *buckets).agg(
            F.collect_list(F.struct("_chunk", "_halo", "_start")).alias("_routes")
        )
    )
    return [
        (level, table.filter(F.col("_level") == i).drop("_level"))
        for i, level in enumerate(levels)
    ]


def with_position(
    df: DataFrame, keys: list[str], order: list[str], name: str = "position",
    limit: int | None = None,
) -> DataFrame:
    """0-based place of each row in its ordered series."""
    return over_ordered(df, keys, order, 0, lambda w: {}, position=name, limit=limit)


def values_at_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: Callable[[Column], dict[str, Column]],
    limit: int | None = None,
) -> DataFrame:
    """The values at given 0-based ranks of each group's ascending order.

    ``ranks`` maps a name to a rank, as a function of the group's row count.
    Narrows each rank to a value range by counting bins, a pass at a time, until
    the range holds at most ``limit`` rows; only those are then sorted.
    Returns keys, ``rank_name`` and ``rank_value``, NaN and NULL ignored.
    """
    limit = limit or rows_per_chunk(df.sparkSession)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    ).filter("_n > 0")
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("rank_name"), rank.cast("long").alias("_rank"))
                for name, rank in ranks(F.col("_n")).items()
            ]
        )
    )
    state = stored(
        groups.select("*", wanted.alias("_w")).select(*keys, "_n", "_lo", "_hi", "_w.*")
    )
    open_ranges = f"_n > {limit} AND _lo < _hi"
    span = [*keys, "_lo", "_hi"]
    inside = [F.col(c) for c in span]

    def members(ranges: DataFrame) -> DataFrame:
        """The rows inside each distinct value range."""
        pairs = [(k, f"_g_{k}") for k in keys]
        side = bounded_broadcast(ranges.select(*span).distinct().withColumnsRenamed(dict(pairs)))
        hit = same(rows, side, pairs) & (rows["_v"] >= side["_lo"]) & (rows["_v"] <= side["_hi"])
        return rows.join(side, hit).drop(*[b for _, b in pairs])

    def at_ranges(ranks: DataFrame, found: DataFrame, test: str) -> DataFrame:
        """Ranks joined to what was found in their range."""
        pairs = [(c, f"_f{c}") for c in span]
        other = found.withColumnsRenamed(dict(pairs))
        return ranks.join(other, same(ranks, other, pairs) & F.expr(test))

    while not state.filter(open_ranges).isEmpty():
        # Halves keep the width finite. An infinite end is a bin of its own, and the
        # range between is binned from the finite ends.
        inf, most = F.lit(math.inf), sys.float_info.max
        half, low, high = [
            F.greatest(F.least(F.col(c), F.lit(most)), F.lit(-most)) / 2 for c in ("_v", "_lo", "_hi")
        ]
        share = F.coalesce((half - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
        bin_of = (
            F.when(F.col("_v") == -inf, -1)
            .when(F.col("_v") == inf, _BINS)
            .when((F.col("_v") == F.col("_hi")) & (F.col("_lo") < F.col("_hi")), _BINS - 1)
            .otherwise(F.least(F.floor(share * _BINS), F.lit(_BINS - 1)))
        )
        below = Window.partitionBy(*inside).orderBy("_bin")
        bins = (
            members(state.filter(open_ranges))
            .groupBy(*span, bin_of.alias("_bin"))
            .agg(
                F.count(F.lit(1)).alias("_count"),
                F.min("_v").alias("_low"),
                F.max("_v").alias("_high"),
            )
            .withColumn(
                "_below",
                F.coalesce(
                    F.sum("_count").over(below.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
            )
        )
        narrowed = at_ranges(
            state.filter(open_ranges), bins, "_rank >= _below AND _rank < _below + _count"
        ).select(
            *keys, F.col("_count").alias("_n"), F.col("_low").alias("_lo"),
            F.col("_high").alias("_hi"), "rank_name", (F.col("_rank") - F.col("_below")).alias("_rank"),
        )
        state = stored(state.filter(f"NOT ({open_ranges})").unionByName(narrowed))

    flat = state.filter("_lo = _hi").select(*keys, "rank_name", F.col("_lo").alias("rank_value"))
    rest = state.filter("_lo < _hi")
    ascending = Window.partitionBy(*inside).orderBy("_v")
    placed = members(rest).withColumn("_at", F.row_number().over(ascending) - 1)
    picked = at_ranges(rest, placed, "_rank = _at").select(
        *keys, "rank_name", F.col("_v").alias("rank_value")
    )
    return flat.unionByName(picked)
