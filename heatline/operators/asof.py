"""Nearest match in time within a tolerance, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from heatline.operators.scale import bounded_broadcast, rows_per_chunk, same, written

_CHUNK_TOLERANCES = 16
_STRETCH_ROWS = 1 << 15
#: A stretch or part of so many times ``limit`` rows is cut.
_BUSY = 2


def asof_nearest(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str,
    value: str, tolerance_seconds: float, order: list[str] = [], limit: int | None = None,
) -> DataFrame:
    """Add ``matched_time`` and ``matched_value``: the right row nearest in time.

    On equal distance the earlier row wins; beyond the tolerance both are NULL.
    ``order`` ranks right rows of one time: the last is met from later rows, the
    first from earlier ones.

    Time is cut into stretches of some share of the rows, at least 16 tolerances
    long. A right row also goes to the neighbour its tolerance reaches into, so
    each stretch is solved alone by a sort and a running value in each
    direction. Where a count finds a stretch of one key with far more rows than
    ``limit``, it is cut by time into parts of about that many. A part holds its own
    rows and the nearest right row on either side of it, so the parts together hold
    no more than two rows each beyond the stretch.
    """
    limit = limit or rows_per_chunk(left.sparkSession)
    tolerance = int(round(tolerance_seconds * 1_000_000))
    columns = left.columns
    sizes = [_extent(left, left_time), _extent(right, right_time)]
    width = _stretch_width(sizes, tolerance)

    def stretch(micros: Column) -> Column:
        return F.floor(micros / F.lit(width)).cast("long")

    ties = order or [value]
    readings = (
        right.filter(F.col(right_time).isNotNull() & F.col(value).isNotNull())
        .withColumn("_t", F.unix_micros(right_time))
        .select(
            *on, "_t", F.col(value).alias("_early"), F.col(value).alias("_late"),
            *[F.col(c).alias(f"_o{i}") for i, c in enumerate(ties)],
        )
    )
    reach = F.sequence(stretch(F.col("_t") - tolerance), stretch(F.col("_t") + tolerance))
    readings = readings.withColumn("_stretch", F.explode(reach))
    # A left row without a time matches nothing; a hash keeps such rows spread.
    spare = -F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) - (1 << 50)
    wanted = left.withColumn("_t", F.unix_micros(left_time)).withColumn(
        "_stretch", F.coalesce(stretch(F.col("_t")), spare)
    )

    part, names = ["_stretch", *on, "_from", "_share"], [f"_o{i}" for i in range(len(ties))]
    whole = {"_from": F.lit(None).cast("long"), "_share": F.lit(0)}
    wanted, readings = wanted.withColumns(whole), readings.withColumns(whole)
    if sizes[0][0] + sizes[1][0] > _BUSY * limit:
        wanted, readings = _cut(wanted, readings, part, columns, names, limit)

    kinds = dict(readings.dtypes)
    seen = ["_early", "_late", *names]
    both = wanted.select(
        *part, "_t", F.lit(1).alias("_side"), F.struct(*columns).alias("_row"),
        F.lit(None).cast("long").alias("_at"),
        *[F.lit(None).cast(kinds[n]).alias(n) for n in seen],
    ).unionByName(
        readings.select(*part, "_t", F.lit(0).alias("_side"), F.col("_t").alias("_at"), *seen),
        allowMissingColumns=True,
    )
    running = Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, 0)
    onward = running.orderBy("_t", "_side", *names)
    backward = running.orderBy(F.desc("_t"), "_side", *[F.desc(n) for n in names])

    def newest(name: str, window: WindowSpec) -> Column:
        return F.last(name, ignorenulls=True).over(window)

    matched = both.withColumns(
        {
            "_back_t": newest("_at", onward),
            "_back_v": newest("_late", onward),
            "_ahead_t": newest("_at", backward),
            "_ahead_v": newest("_early", backward),
        }
    ).filter("_side = 1")
    back, ahead = F.col("_t") - F.col("_back_t"), F.col("_ahead_t") - F.col("_t")
    use_back = (back <= tolerance) & (F.coalesce(back <= ahead, F.lit(True)))

    def best(which: str) -> Column:
        return F.when(use_back, F.col(f"_back_{which}")).when(
            ahead <= tolerance, F.col(f"_ahead_{which}")
        )

    return matched.select(
        "_row.*",
        F.timestamp_micros(best("t")).alias("matched_time"),
        best("v").alias("matched_value"),
    )


def _extent(df: DataFrame, time: str) -> tuple[int, int, int]:
    """Rows, first and last time; one narrow scan."""
    t = F.unix_micros(time)
    n, first, last = df.agg(F.count(t), F.min(t), F.max(t)).head()
    return n, first or 0, last or 0


def _stretch_width(sizes: list[tuple[int, int, int]], tolerance: int) -> int:
    """Microseconds that hold some thousand rows on average: a window's buffer."""
    rows = sum(n for n, _, _ in sizes)
    span = max(last - first for _, first, last in sizes) + 1
    return max(1, tolerance * _CHUNK_TOLERANCES, span * _STRETCH_ROWS // max(rows, 1))


def _cut(
    wanted: DataFrame, readings: DataFrame, part: list[str], columns: list[str],
    names: list[str], limit: int,
) -> tuple[DataFrame, DataFrame]:
    """Cut stretches with too many rows by time until every part has few, or one time.

    ``_from`` becomes the start of a row's part; it stays NULL in a stretch left whole.
    """
    place = part[:-1]
    rows = wanted.select(*place, "_t").unionByName(readings.select(*place, "_t"))
    some, cut = f"_n > {_BUSY * limit} AND _low IS NOT NULL", False
    while True:
        busy = rows.groupBy(*place).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_low"), F.max("_t").alias("_high")
        ).filter(some)
        step = F.floor((F.col("_high") - F.col("_low") + 1) * (F.lit(float(limit)) / F.col("_n")))
        pairs = [(c, f"_x_{c}") for c in place]
        busy = bounded_broadcast(
            busy.select(
                *[F.col(a).alias(b) for a, b in pairs], "_low", F.greatest(step, F.lit(1)).alias("_step")
            )
        )
        if busy.isEmpty():
            break

        def finer(df: DataFrame, how: str = "left") -> DataFrame:
            start = F.expr("_low + (_t - _low) div _step * _step")
            return df.join(busy, same(df, busy, pairs), how).withColumn(
                "_from", F.coalesce(start, F.col("_from"))
            ).select(*df.columns)

        wanted, readings, rows = finer(wanted), finer(readings), finer(rows, "inner")
        some, cut = f"_n > {_BUSY * limit} AND _low < _high", True
    return _joined_parts(wanted, readings, part, columns, names, limit) if cut else (wanted, readings)


def _joined_parts(
    wanted: DataFrame, readings: DataFrame, part: list[str], columns: list[str],
    names: list[str], limit: int,
) -> tuple[DataFrame, DataFrame]:
    """Give every part the readings next to it, and share out parts of one time.

    Left rows of a part of one time are shared out by row hash; each share gets one
    reading that stands for all of them, with their first and their last value.
    """
    place = part[:-1]
    kinds = dict(readings.dtypes)
    seen = ["_early", "_late", *names]
    rows = wanted.select(
        *place, F.lit(None).cast("long").alias("_t"),
        *[F.lit(None).cast(kinds[n]).alias(n) for n in seen],
    ).unionByName(readings.select(*place, "_t", *seen)).filter("_from IS NOT NULL")
    # A struct is never NULL, so readings with NULL ties count here as in the window.
    rank = F.when(F.col("_t").isNotNull(), F.struct("_t", *names))
    parts = written(
        rows.groupBy(*place).agg(
            F.count_if(F.col("_t").isNull()).alias("_wanted"), F.count(F.lit(1)).alias("_n"),
            F.min("_t").alias("_first_t"), F.min_by("_early", rank).alias("_first_v"),
            F.max("_t").alias("_last_t"), F.max_by("_late", rank).alias("_last_v"),
        ),
        "parts",
    )
    # Only parts of one time are still busy.
    one_time = F.col("_n") > _BUSY * limit
    shares = F.when(one_time, F.greatest(F.ceil(F.col("_wanted") / limit), F.lit(1))).otherwise(1)
    along = Window.partitionBy(*place[:-1]).rowsBetween(Window.unboundedPreceding, -1)
    onward, backward = along.orderBy("_from"), along.orderBy(F.desc("_from"))

    def reading(t: Column, early: Column, late: Column) -> Column:
        return F.struct(t.alias("_t"), early.alias("_early"), late.alias("_late"))

    def beside(which: str, window: WindowSpec) -> Column:
        t, v = (F.last(f"_{which}_{c}", ignorenulls=True).over(window) for c in "tv")
        return reading(t, v, v)

    own = reading(F.col("_first_t"), F.col("_first_v"), F.col("_last_v"))
    added = parts.withColumns(
        {"_before": beside("last", onward), "_after": beside("first", backward)}
    ).filter("_wanted > 0").withColumn(
        "_share", F.explode(F.sequence(F.lit(0), shares.cast("int") - 1))
    ).select(*part, F.inline(F.array("_before", "_after", F.when(one_time, own)))).filter("_t IS NOT NULL")

    pairs = [(c, f"_x_{c}") for c in place]
    busy = bounded_broadcast(
        parts.filter(one_time).select(
            *[F.col(a).alias(b) for a, b in pairs], shares.cast("int").alias("_shares")
        )
    )
    if not busy.isEmpty():
        wanted = wanted.join(busy, same(wanted, busy, pairs), "left").withColumn(
            "_share", F.pmod(F.xxhash64(*columns), F.coalesce("_shares", F.lit(1))).cast("int")
        ).select(*wanted.columns)
        readings = readings.join(busy, same(readings, busy, pairs), "left_anti")
    return wanted, readings.unionByName(added, allowMissingColumns=True)
