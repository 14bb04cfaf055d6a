"""Risk and alert truth tables, thresholds, what-if shifts."""

import pytest
from pyspark.sql import functions as F

from heatline.operators import alerts, monitor, project, risk, whatif
from heatline.operators.validate import check_thresholds
from heatline.schema import MODULES
from heatline.sources.sinks import write_thresholds
from heatline.sources.telemetry import read_thresholds

RISK = [
    (27.30, 28.00, "CRITICAL"), (27.06, 27.14, "WARNING"), (27.05, None, "WARNING"),
    (27.10, 26.00, "CRITICAL"), (27.10, 26.50, "WARNING"), (26.60, 26.00, "WARNING"),
    (26.60, 25.00, "WARNING"), (26.40, 25.00, "NORMAL"), (26.60, 26.50, "NORMAL"),
]


def levels(spark, modules=("m",), warning=27.05, critical=27.30):
    return spark.createDataFrame(
        [(m, warning, critical) for m in modules], "module string, warning double, critical double"
    )


def test_risk_truth_table(spark):
    rows = [(i, "m", p, c) for i, (p, c, _) in enumerate(RISK)] + [(99, "other", 30.0, 30.0)]
    df = spark.createDataFrame(
        rows, "i int, module string, predicted_temperature double, current_temperature double"
    )
    got = {r["i"]: r["risk_level"] for r in risk.classify(df, levels(spark)).collect()}
    assert got == {**{i: want for i, (_, _, want) in enumerate(RISK)}, 99: None}
    unknown = risk.unknown_modules(df, levels(spark)).collect()
    assert [r["i"] for r in unknown] == [99]


def decisions(spark, ts, sequence, module="m"):
    rows = [(module, ts(10 * i), 27.0 + i, 26.0, r) for i, r in enumerate(sequence)]
    df = spark.createDataFrame(
        rows, "module string, event_time timestamp, predicted_temperature double, "
        "current_temperature double, risk_level string",
    )
    return df.withColumns(
        {"temperature_delta": F.lit(1.0), "warning_threshold": F.lit(27.05), "critical_threshold": F.lit(27.30)}
    )


NAMES = {"N": "NORMAL", "W": "WARNING", "C": "CRITICAL"}


@pytest.mark.parametrize("limit", [None, 2])
def test_alert_sequence(spark, ts, limit):
    df = decisions(spark, ts, [NAMES[c] for c in "NWWCWCNW"])
    got = alerts.alert_events(df, limit=limit).orderBy("event_time").collect()
    assert [(r["event_type"], r["severity"]) for r in got] == [
        (alerts.ALERT, "WARNING"), (alerts.ALERT, "CRITICAL"), (alerts.ALERT, "CRITICAL"),
        (alerts.RECOVERY, "NORMAL"), (alerts.ALERT, "WARNING"),
    ]
    assert got[0]["message"] == (
        "WARNING temperature risk detected in m. 5-minute forecast: 28.00°C, warning threshold: 27.05°C."
    )
    assert got[1]["message"].endswith("5-minute forecast: 30.00°C, critical threshold: 27.30°C.")
    assert got[3]["message"] == "m returned to normal."


@pytest.mark.parametrize(
    "before, now, event",
    [("N", "N", None), ("N", "W", "A"), ("N", "C", "A"), ("W", "W", None), ("C", "C", None),
     ("W", "C", "A"), ("C", "W", None), ("W", "N", "R"), ("C", "N", "R")],
)
def test_alert_machine(spark, before, now, event):
    wanted = {None: None, "A": alerts.ALERT, "R": alerts.RECOVERY}[event]
    got = spark.range(1).select(alerts.event_type(F.lit(NAMES[before]), F.lit(NAMES[now]))).head()[0]
    assert got == wanted


def test_restored_state(spark, ts):
    first = spark.createDataFrame([("m", "CRITICAL")], "module string, risk_level string")
    got = alerts.alert_events(decisions(spark, ts, ["WARNING", "NORMAL"]), initial=first).collect()
    assert [r["event_type"] for r in got] == [alerts.RECOVERY]


def test_rows_without_risk_change_nothing(spark, ts):
    df = decisions(spark, ts, ["WARNING", None, "WARNING", "NORMAL"])
    got = alerts.alert_events(df).orderBy("event_time").collect()
    assert [r["event_type"] for r in got] == [alerts.ALERT, alerts.RECOVERY]


@pytest.mark.parametrize("bound", [0, 100])
def test_latest_of_keys_without_a_time(spark, ts, monkeypatch, bound):
    monkeypatch.setattr(monitor, "BROADCAST_ROWS", bound)
    rows = [("a", ts(0), 1), ("a", ts(5), 2), ("a", None, 9), ("b", None, 3), (None, ts(2), 4)]
    df = spark.createDataFrame(rows, "k string, event_time timestamp, v int")
    got = monitor.latest_per_key(df, ["k"], ["event_time", "v"]).collect()
    assert {(r["k"], r["v"]) for r in got} == {("a", 2), ("b", 3), (None, 4)}


def test_summary_counts_recoveries_as_alerts(spark, ts):
    stored = alerts.alert_records(
        alerts.alert_events(decisions(spark, ts, [NAMES[c] for c in "NWWCWCNW"]))
    )
    assert tuple(monitor.alert_summary(stored).head()) == (5, 2, 2, 1)
    assert tuple(monitor.alert_summary(stored.limit(0)).head()) == (0, 0, 0, 0)
    one = decisions(spark, ts, ["WARNING"])
    assert tuple(monitor.summary(one, stored).head()) == (1, 5, 2, 2)


def test_history_takes_both_layouts(spark, ts):
    events = alerts.alert_events(decisions(spark, ts, ["WARNING", "NORMAL"]))
    both = project.joined_history(events, alerts.alert_records(events))
    out = project.alert_history(both)
    assert out.columns[:3] == ["Timestamp", "Module", "Event"] and out.columns[-1] == "Severity"
    assert out.filter("Severity IS NULL").count() == 0


def test_threshold_file_round_trip(spark, tmp_path):
    fitted = levels(spark, MODULES).withColumn("source", F.lit("historical_percentiles"))
    write_thresholds(fitted, str(tmp_path / "t"))
    back = check_thresholds(read_thresholds(spark, str(tmp_path / "t")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, fitted.collect()))


def test_threshold_rules(spark, tmp_path):
    def file(text):
        path = tmp_path / "levels.json"
        path.write_text(text)
        return read_thresholds(spark, str(path))

    entries = [f'"{m}": {{"Warning_95": 24.5, "Critical_99": 25}}' for m in MODULES]
    legacy = check_thresholds(file("{" + ",\n".join(entries) + "}"))
    assert {(r["warning"], r["critical"]) for r in legacy.collect()} == {(24.5, 25.0)}
    with pytest.raises(ValueError, match="exactly 8"):
        check_thresholds(file("{" + ", ".join(entries[:7]) + "}"))
    bad = entries[:7] + [f'"{MODULES[7]}": {{"warning": 25, "critical": 25}}']
    with pytest.raises(ValueError, match="Invalid warning/critical thresholds for Module_8"):
        check_thresholds(file("{" + ", ".join(bad) + "}"))
    with pytest.raises(ValueError, match="JSON object"):
        file("[1, 2]")


def test_scenarios(spark):
    df = spark.createDataFrame([(25.12345, 1.0), (None, 1.0)], "Module_6_Avg_Temp double, x double")
    warm = whatif.shift_module(df, " warning ").collect()
    assert [r[0] for r in warm] == [round(25.12345 + 1.0, 4), None]
    assert whatif.shift_module(df, "normal") is df
    assert whatif.shift_module(df.select("x"), "CRITICAL").columns == ["x"]
    assert whatif.scenario_rows(df).count() == 6
    with pytest.raises(ValueError, match="CRITICAL, NORMAL, WARNING"):
        whatif.shift_module(df, "HOT")


def test_rounding_equals_python(spark):
    from heatline.functions.scalars import exact_round, fixed_text

    values = [0.125, 0.375, 1.005, 2.675, 27.06005, -0.001, 1234567.891, 0.00015, 26.00015]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", exact_round(F.col("v"), 4), fixed_text(F.col("v"), 2)).collect()
    for value, rounded, text in got:
        assert rounded == round(value, 4) and text == f"{value:.2f}"


def test_readings_of_status(spark):
    rows = [("Module_10_Avg_Temp", "WARNING"), ("Module_2_Avg_Temp", "WARNING"),
            ("Module_9_Avg_Temp", "CRITICAL"), ("Spare", "WARNING"), ("Module_1_Avg_Temp", "NORMAL")]
    df = spark.createDataFrame(rows, "module string, risk_level string")
    assert [r["module"] for r in monitor.active_list(df).collect()] == [
        "Module_9_Avg_Temp", "Module_2_Avg_Temp", "Module_10_Avg_Temp", "Spare"]
    assert tuple(monitor.active_counts(df).head()) == (4, 3, 1)


def test_sketches_of_days_keep_the_rank(spark, ts):
    """Levels merged from days are within the stated error of the true rank, however split."""
    rows = [("a" if k % 3 == 0 else "b", ts(40 * k), float((k * 7919) % 60_000) ** 1.5) for k in range(60_000)]
    rows += [("a", ts(0), float("nan")), ("a", ts(0), None), ("c", ts(0), 5.0)]
    df = spark.createDataFrame(rows, "module string, event_time timestamp, value double")
    sketches = risk.value_sketches(df, size=256)
    assert sketches.filter("module = 'a'").count() > 20
    old, new = [sketches.filter(F.col("event_date") < d) for d in ("2024-10-01", "2025-01-01")]
    for part, seen in ((old, df.filter("event_time < '2024-10-01'")), (new, df)):
        levels = {r["module"]: r for r in risk.sketched_thresholds(part).collect()}
        known = seen.filter("NOT isnan(value)").dropna().toPandas()
        for module, values in known.groupby("module")["value"]:
            assert levels[module]["n"] == len(values)
            for name, q in (("warning", 0.95), ("critical", 0.99)):
                low, high = (values < levels[module][name]).mean(), (values <= levels[module][name]).mean()
                assert low - risk.rank_error(256) <= q <= high + risk.rank_error(256)


def test_one_object_or_one_to_a_line(spark, tmp_path):
    lines = ['{"a": {"warning": 1, "critical": 2}}', "", '{"b": {"warning": 3, "critical": 4}}']
    (tmp_path / "lines").write_text("\n".join(lines))
    (tmp_path / "whole").write_text('{\n "a": {"warning": 1, "critical": 2},\n "b": {"warning": 3,\n "critical": 4}}\n')
    for name in ("lines", "whole"):
        found = read_thresholds(spark, str(tmp_path / name)).select("module", "warning", "critical").collect()
        assert sorted(map(tuple, found)) == [("a", "1", "2"), ("b", "3", "4")]
    (tmp_path / "bad").write_text("[1]")
    with pytest.raises(ValueError, match="JSON object"):
        read_thresholds(spark, str(tmp_path / "bad"))
