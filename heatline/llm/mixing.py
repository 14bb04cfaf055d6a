"""Mixing sources to target weights by Sainte-Laguë apportionment of equal word blocks.

Sources in code point order, NULL last, weigh 3, 1, 2 and so on in turn. They share
``share`` times all words by weight; no source gets more than ``repeats`` times its own,
and what is cut off goes to the others by weight until none is above.

1. Every source is cut into blocks of equally many words. The targets' words are dealt
   out a block at a time, each to the source with the highest quotient
   ``target / (2 * blocks so far + 1)``.
2. A source's rows are dealt over shards of bounded rows by a hash of the identifier, and
   the source's blocks go to its shards in the same way, by their words. This gives whole
   quotas for each shard.
3. In a shard rows stand in seeded order, and so do its blocks in a seeded systematic
   draw: each is taken ``quota div blocks`` times and ``quota mod blocks`` of them once
   more. How many words of a row fall into taken blocks, and how often, follows from the
   row's place in the shard alone, so no block is ever a row of a table.

A whole text is read once for its size; after that only (id, source, size, copies) move.
Equal rows are one row with a count until the end, and stand one after another there. A
hot source has as many shards as its rows ask for. One row a source passes one window.

``block`` defaults to the least positive target over ``PRECISION``, between 1 and
``MOST_BLOCK`` words: blocks stay small beside every source, so that each is met within
about 1 / PRECISION.

Defined results: NULL text has size 0, NULL identifiers and sources are values of their
own. Rows of size 0 are returned with nothing taken, and so is all where nothing has
words. An empty table gives no rows. Other columns of any name are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatline.operators.scale import bounded_broadcast, same, stored, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = 13
WORD = r"[^\x20\x09-\x0D]+"
PRECISION = 500
MOST_BLOCK = 1024
ROWS_PER_SHARD = 8_192
WORDS_PER_SHARD = 1_000_000_000


def words(text: str | Column = "text") -> Column:
    """Number of words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(seed: int, *parts: str) -> Column:
    """Hexadecimal digest of the seed and columns; NULL differs from any text."""
    filled = [F.coalesce(F.concat(F.lit(":"), F.col(p).cast("string")), F.lit("-")) for p in parts]
    return F.md5(F.concat(F.lit(str(seed)), *filled))


def _number(digest: Column, digits: int = 13) -> Column:
    return F.conv(F.left(digest, F.lit(digits)), 16, 10).cast("long")


def targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """A row for each source: source, source_size, n_rows, source_at, weight and target.

    ``sizes`` has source, size and copies.
    """
    sources = stored(
        sizes.groupBy("source").agg(
            F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_rows")
        )
    )
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_at") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("source_at", at.cast("long")).withColumn("weight", weight))
    most = F.col("source_size") * float(repeats)
    budget = sources.agg(F.sum("source_size")).head()[0] or 0
    level, full = 0.0, -1
    while True:
        # Sources at their most keep that; the others share what is left by weight.
        at_most = F.col("weight") * F.lit(level) >= most
        left, open_weight, n_full = sources.agg(
            F.sum(F.when(at_most, most)), F.sum(F.when(~at_most, F.col("weight"))), F.count(F.when(at_most, 1))
        ).head()
        if n_full == full or not open_weight:
            break
        full, level = n_full, (budget * share - (left or 0.0)) / open_weight
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), most))


def sainte_lague(
    parties: DataFrame, group: list[str], order: list[str], weight: str, seats: str, most: str
) -> DataFrame:
    """``parties`` with ``quota``: their group's seats, each to the highest quotient.

    The quotient of a party is ``weight / (2 * quota + 1)``; ties go by ``order``, and no
    party gets more than ``most``, which has to be its proportional share at least. What
    lies safely below that share is given outright, and only a few quotients a party
    beyond it are compared.
    """
    within = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)])
    total, n = F.sum(weight).over(within), F.count(F.lit(1)).over(within)
    sure = F.floor(F.greatest(F.col(seats) - n / 2, F.lit(0)) / F.nullif(total, F.lit(0.0)) * F.col(weight) + 0.5)
    begun = parties.withColumn("quota", F.least(F.coalesce(sure, F.lit(0)).cast("long"), F.col(most)))
    rest = F.col(seats) - F.sum("quota").over(within)
    extra = F.ceil(F.coalesce(F.col(weight) / F.nullif(total, F.lit(0.0)), F.lit(0.0)) * n * 2) + 2
    begun = begun.withColumn("_rest", rest).withColumn(
        "_tries", F.least(extra, F.col("_rest"), F.col(most) - F.col("quota")).cast("long")
    )
    keys = [*group, *order]
    tried = begun.filter(f"_tries > 0 AND {weight} > 0").select(
        *keys, "_rest", "quota", weight, F.explode(F.expr("sequence(0L, _tries - 1)")).alias("_more")
    )
    quotient = F.col(weight) / (2 * (F.col("quota") + F.col("_more")) + 1)
    ranked = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)]).orderBy(quotient.desc(), *order)
    won = tried.withColumn("_place", F.row_number().over(ranked)).filter("_place <= _rest")
    won = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*[F.col(k).alias(f"_{k}") for k in keys], "_won")
    joined = begun.join(won, same(begun, won, [(k, f"_{k}") for k in keys]), "left")
    return joined.withColumn("quota", F.col("quota") + F.coalesce("_won", F.lit(0))).select(
        *parties.columns, "quota"
    )


def block_words(sources: DataFrame, precision: int = PRECISION) -> int:
    """Words of a block: small beside the least positive target."""
    least = sources.filter("target > 0").agg(F.min("target")).head()[0]
    return max(1, min(MOST_BLOCK, int((least or 0.0) // precision)))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _taken(place: Column, block: int) -> Column:
    """Words the mix takes of a shard's first ``place`` ones, from its quota and draw."""
    at = _div(place, F.lit(block))
    extra, n, turn = F.col("extra"), F.col("blocks"), F.col("turn")
    drawn = [_div((at + k) * extra + turn, n) for k in (0, 1)]
    return F.col("each") * place + block * drawn[0] + (drawn[1] - drawn[0]) * (place - at * block)


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    block: int | None = None,
    seed: int = SEED,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """Rows with id, source, size, source_size, target and ``taken`` words."""
    size = words("text") if size is None else size
    units = docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), size.alias("size"))
    units = written(units.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    sources = stored(targets(units, weights, share, repeats))
    block = block or block_words(sources)

    # Sources that are taken whole, ``repeats`` times, need no apportionment.
    whole = F.col("target") >= F.col("source_size") * F.lit(float(repeats))
    n_shards = F.greatest(F.ceil(F.col("n_rows") / rows_per_shard),
                          F.ceil(F.col("source_size") / WORDS_PER_SHARD), F.lit(1)).cast("long")
    sources = stored(sources.withColumn("whole", whole).withColumn("n_shards", n_shards))
    named = sources.select(F.col("source").alias("name"), "source_at", "n_shards")
    placed = units.join(bounded_broadcast(named), F.col("source").eqNullSafe(F.col("name")))
    shard = _number(_seeded(seed, "id", "size")) % F.col("n_shards")
    placed = written(
        placed.select("id", "size", "copies", "source_at", shard.alias("shard")), "shards"
    )
    n_blocks = F.ceil(F.col("shard_size") / block).cast("long")
    shards = stored(
        placed.groupBy("source_at", "shard")
        .agg(F.sum(F.col("size") * F.col("copies")).cast("double").alias("shard_size"))
        .withColumn("blocks", n_blocks)
    )
    most = shards.groupBy("source_at").agg((F.sum("blocks") * repeats).alias("most"))
    open_sources = sources.filter("NOT whole").select("source_at", "target")
    open_sources = open_sources.join(most, "source_at")
    mass = open_sources.agg(F.round(F.sum("target") / block)).head()[0] or 0
    open_sources = open_sources.withColumn("seats", F.lit(int(mass)))
    quotas = sainte_lague(open_sources, [], ["source_at"], "target", "seats", "most")
    quotas = quotas.select("source_at", F.col("quota").alias("seats"))
    open_shards = shards.join(quotas, "source_at").withColumn("most", F.col("blocks") * repeats)
    dealt = sainte_lague(open_shards, ["source_at"], ["shard"], "shard_size", "seats", "most")
    dealt = dealt.select("source_at", "shard", "quota")
    turn = _number(_seeded(seed, "source_at", "shard")) % F.greatest("blocks", F.lit(1))
    plan = stored(
        shards.join(dealt, ["source_at", "shard"], "left")
        .withColumn("quota", F.coalesce("quota", F.col("blocks") * repeats))
        .select(
            "source_at", "shard", F.greatest("blocks", F.lit(1)).alias("blocks"), "quota", turn.alias("turn")
        )
        .join(sources.select("source_at", "source", "source_size", "target"), "source_at")
        .withColumn("each", F.expr("quota div blocks"))
        .withColumn("extra", F.expr("quota % blocks"))
    )
    spans = F.col("size") * F.col("copies")
    order = Window.partitionBy("source_at", "shard").orderBy(_seeded(seed, "id"), "id", "size")
    before = F.coalesce(F.sum(spans).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = placed.withColumn("begin", before)
    keys = [("source_at", "_source_at"), ("shard", "_shard")]
    side = bounded_broadcast(plan.withColumnsRenamed(dict(keys)))
    rows = rows.join(side, reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in keys]))
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    rows = rows.withColumn("begin", F.col("begin") + F.col("copy") * F.col("size"))
    taken = _taken(F.col("begin") + F.col("size"), block) - _taken(F.col("begin"), block)
    return rows.select(
        F.col("id").alias(id_column), F.col("source").alias(source), "size", "source_size", "target",
        taken.cast("long").alias("taken"),
    )


def mix_sql() -> str:
    """The mix of ``documents`` with all defaults in DuckDB's SQL: every quotient is ranked."""
    seeded = "coalesce(':' || CAST({} AS VARCHAR), '-')"

    def number(*parts: str) -> str:
        digest = f"md5('{SEED}' || {' || '.join(seeded.format(p) for p in parts)})"
        return f"CAST('0x' || left({digest}, 13) AS BIGINT)"

    def seats(parties: str, keys: str, order: str, weight: str) -> str:
        return f"""SELECT {keys}, count(*) AS quota FROM (
          SELECT *, row_number() OVER ({order} ORDER BY {weight} / (2 * k + 1) DESC, {keys}) AS place
          FROM (SELECT *, unnest(range(most)) AS k FROM {parties})) WHERE place <= seats GROUP BY {keys}"""

    drawn = "((({0}) // block + {1}) * extra + turn) // n_blocks"
    cut = "{0} * each + block * ({1}) + (({2}) - ({1})) * (({0}) - ({0}) // block * block)"
    begin, end = [cut.format(p, drawn.format(p, 0), drawn.format(p, 1)) for p in ("b", "(b + size)")]
    return f"""
WITH units AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
names AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(DISTINCT (doc_id, size)) AS n_rows,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_at FROM units GROUP BY source),
weighed AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][source_at % {len(WEIGHTS)} + 1] AS weight,
    {REPEATS}.0 * source_size AS top FROM names),
levels AS (SELECT *, top / weight AS full_at,
    ({SHARE} * sum(source_size) OVER () - coalesce(sum(top) OVER lower, 0)) /
    (sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0)) AS level
  FROM weighed WINDOW lower AS (ORDER BY top / weight, source_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sources AS (SELECT w.*, least(weight * coalesce((SELECT min_by(level, full_at) FROM levels WHERE full_at > level), 0), top) AS target
  FROM weighed w),
sized AS (SELECT *, greatest(1, least({MOST_BLOCK}, CAST(floor((SELECT min(target) FROM sources WHERE target > 0) / {PRECISION}) AS BIGINT))) AS block,
    greatest(ceil(n_rows / {ROWS_PER_SHARD}), ceil(source_size / {WORDS_PER_SHARD}), 1)::BIGINT AS n_shards FROM sources),
placed AS (SELECT u.doc_id, u.size, s.source_at, {number("u.doc_id", "u.size")} % n_shards AS shard
  FROM units u JOIN sized s ON u.source IS NOT DISTINCT FROM s.source),
shards AS (SELECT source_at, shard, block, target, top, ceil(sum(size) / block)::BIGINT AS n_blocks, sum(size)::DOUBLE AS shard_size
  FROM placed JOIN sized USING (source_at) GROUP BY source_at, shard, block, target, top),
open_sources AS (SELECT source_at, target, most, round(sum(target) OVER () / block)::BIGINT AS seats
  FROM (SELECT source_at, block, target, (sum(n_blocks) * {REPEATS})::BIGINT AS most FROM shards WHERE target < top GROUP BY ALL)),
source_quotas AS ({seats("open_sources", "source_at", "", "target")}),
open_shards AS (SELECT source_at, shard, shard_size, n_blocks * {REPEATS} AS most, quota AS seats
  FROM shards JOIN source_quotas USING (source_at)),
shard_quotas AS ({seats("open_shards", "source_at, shard", "PARTITION BY source_at", "shard_size")}),
plan AS (SELECT source_at, shard, block, greatest(n_blocks, 1) AS n_blocks,
    quota // greatest(n_blocks, 1) AS each, quota % greatest(n_blocks, 1) AS extra,
    {number("source_at", "shard")} % greatest(n_blocks, 1) AS turn
  FROM (SELECT s.*, CASE WHEN target < top THEN coalesce(quota, 0) ELSE n_blocks * {REPEATS} END AS quota
        FROM shards s LEFT JOIN shard_quotas USING (source_at, shard))),
begun AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source_at, shard
    ORDER BY md5('{SEED}' || {seeded.format("doc_id")}), doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM placed)
SELECT doc_id, size, source_size, target, CAST(({end}) - ({begin}) AS BIGINT) AS taken
FROM begun JOIN plan USING (source_at, shard) JOIN sources USING (source_at)"""
