"""What-if temperature shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatline.functions.scalars import clean_name, exact_round
from heatline.schema import SCENARIO_MODULE, SCENARIOS


def scenario_name(name: str) -> str:
    """trimmed upper-case name, checked."""
    cleaned = name.strip().upper()
    if cleaned not in SCENARIOS:
        raise ValueError("Invalid scenario. Allowed values: " + ", ".join(sorted(SCENARIOS)))
    return cleaned


def shift_module(df: DataFrame, scenario: str, column: str = SCENARIO_MODULE) -> DataFrame:
    """One module made warmer; a table without that column is left alone.

    Only the value itself moves. To carry the shift into lags and means, shift
    the module table and derive its features afterwards.
    """
    name = scenario_name(scenario)
    if name == "NORMAL" or column not in df.columns:
        return df
    return df.withColumn(column, exact_round(F.col(column) + F.lit(SCENARIOS[name]), 4))


def scenario_shift(scenario: Column) -> Column:
    """Degrees added by a scenario name; NULL for an unknown one."""
    cleaned, shift = clean_name(scenario), None
    for name, degrees in SCENARIOS.items():
        test = cleaned == name
        shift = F.when(test, degrees) if shift is None else shift.when(test, degrees)
    return shift


def scenario_rows(df: DataFrame, column: str = SCENARIO_MODULE) -> DataFrame:
    """Every row once per scenario."""
    shifted = [
        F.struct(
            F.lit(name).alias("scenario"),
            (exact_round(F.col(column) + degrees, 4) if degrees else F.col(column)).alias(column),
        )
        for name, degrees in SCENARIOS.items()
    ]
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.inline(F.array(*shifted)))
