"""Alerts per module on a stream of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from heatline.operators.alerts import as_events, risk_transitions
from heatline.operators.scale import same, stored, written
from heatline.streaming.carried import carried_stream


def newest_risk(
    decisions: DataFrame, before: DataFrame | None, keys: list[str], order: list[str]
) -> DataFrame:
    """Each key's risk after some decisions; keys without any keep the one before."""
    newest = decisions.filter("risk_level IS NOT NULL").groupBy(*keys).agg(
        F.max_by("risk_level", F.struct(*order)).alias("risk_level")
    )
    if before is None:
        return newest
    side = newest.select(*[F.col(k).alias(f"_n_{k}") for k in keys])
    kept = before.join(side, same(before, side, [(k, f"_n_{k}") for k in keys]), "left_anti")
    return newest.unionByName(kept.select(*newest.columns))


def risk_changes(
    decisions: DataFrame, root: str, checkpoint: str, keys: list[str] = ["module"],
    order: list[str] = ["event_time"], initial: DataFrame | None = None, events: bool = False,
) -> DataStreamWriter:
    """Rows whose risk differs from the one before, with ``previous_risk``.

    Batches follow one another as they arrive; rows within one stand in ``order``.
    ``initial`` (keys, ``risk_level``) restores an earlier state on the first start.
    Rows without a risk are left out, as in the batch form. With ``events`` the rows are
    the alerts and recoveries they raise.
    """

    def step(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        before = None if before is None else stored(before)
        rows = written(risk_transitions(batch, keys, order, before), "transitions")
        changed = rows.filter("previous_risk != risk_level")
        return (as_events(changed) if events else changed), newest_risk(batch, before, keys, order)

    return carried_stream(decisions, root, checkpoint, step, initial)


def alert_stream(decisions: DataFrame, root: str, checkpoint: str, **options) -> DataStreamWriter:
    """Alert and recovery events of a decision stream; options of ``risk_changes``."""
    return risk_changes(decisions, root, checkpoint, events=True, **options)
