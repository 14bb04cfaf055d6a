"""Column functions: time, text and number rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted source clocks. The first covers fractions and offsets.
TIME_FORMATS = [
    "yyyy-M-d'T'H:m:s[.SSSSSS][XXX][xx]",
    "yyyy-M-d H:m:s",
    "M/d/yyyy H:m:s",
]

MICROS = 1_000_000


def parse_time(text: Column, formats: list[str] = TIME_FORMATS) -> Column:
    """the first format that fits; a clock without a zone is UTC.

    Years have four digits; others would not fit the calendar of later readers.
    """
    found = F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats])
    return F.when(F.year(found).between(1, 9999), found)


def first_filled(*options: Column) -> Column:
    """the first option that is neither NULL nor empty text."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def shifted(time: Column, seconds: float) -> Column:
    """time plus a fixed number of seconds."""
    return time + F.expr(f"INTERVAL '{seconds:.6f}' SECOND")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(MICROS)


def time_parts(time: Column) -> dict[str, Column]:
    """hour, minute, weekday with Monday 0, and weekend as 0/1."""
    weekday = F.weekday(time)
    return {
        "Hour": F.hour(time).cast("float"),
        "Minute": F.minute(time).cast("float"),
        "Weekday": weekday.cast("float"),
        "Is_Weekend": (weekday >= 5).cast("float"),
    }


def is_finite(number: Column) -> Column:
    """F11."""
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))


def known(number: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(number), number)


def text_to_double(text: Column) -> Column:
    """Number written as text; NULL where it is none.

    Digit-group underscores count as part of a number; type suffixes do not.
    """
    plain = F.trim(F.trim(text), F.lit('"'))
    plain = F.when(
        plain.contains("_"), F.regexp_replace(plain, r"(?<=\d)_(?=\d)", "")
    ).otherwise(plain)
    # The pattern is only tried on what could end in a suffix.
    suffixed = F.right(F.rtrim(plain), F.lit(1)).isin("d", "D", "f", "F") & plain.rlike(r"[0-9.][dDfF]\s*$")
    return F.when(~suffixed, plain.try_cast("double"))


def improvement_percent(baseline: Column, mae: Column) -> Column:
    """F10."""
    return (baseline - mae) / F.nullif(baseline, F.lit(0.0)) * 100


def module_label(module: Column) -> Column:
    """display name."""
    return F.replace(module, F.lit("_Avg_Temp"), F.lit(""))


def module_number(module: Column) -> Column:
    """number for sorting; 999 where there is none."""
    return F.coalesce(F.get(F.split(module, "_"), F.lit(1)).try_cast("int"), F.lit(999))


def movement(delta: Column) -> Column:
    """F8."""
    return (
        F.when(delta > 0, "↑ Expected rise")
        .when(delta < 0, "↓ Expected fall")
        .when(delta == 0, "→ Stable")
        .otherwise("N/A")
    )


def accuracy_grade(mae: Column) -> Column:
    """NULL where nothing has been scored."""
    return (
        F.when(mae < 0.5, "Strong forecasting accuracy")
        .when(mae < 1.0, "Good forecasting accuracy")
        .when(mae >= 1.0, "Needs model attention")
    )


def clean_name(text: Column) -> Column:
    """F14."""
    return F.upper(F.trim(text))


def iso_text(time: Column) -> Column:
    """ISO text; the fraction appears only where there is one."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    parts = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.unix_micros(time) % MICROS == 0, whole).otherwise(parts)


def row_mean(columns: list[Column]) -> Column:
    """Mean of the known values of one row; NULL if there are none."""
    present = [known(c) for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in present), F.lit(0.0))
    return total / F.nullif(row_count(columns), F.lit(0))


def row_count(columns: list[Column]) -> Column:
    return sum((known(c).isNotNull().cast("int") for c in columns), F.lit(0))


def row_std(columns: list[Column], ddof: int) -> Column:
    """Standard deviation of one row's known values."""
    mean, n = row_mean(columns), row_count(columns)
    squares = sum(
        (F.coalesce(F.pow(known(c) - mean, F.lit(2)), F.lit(0.0)) for c in columns), F.lit(0.0)
    )
    return F.sqrt(squares / F.when(n > ddof, n - ddof))


def fixed_text(number: Column, digits: int) -> Column:
    """Decimal text of the exact binary value, ties to even; for values that keep a digit."""
    return F.call_function("format_number", number, F.lit("0." + "0" * digits))


def exact_round(number: Column, digits: int) -> Column:
    """F16: rounding of the exact binary value, ties to even."""
    return fixed_text(number, digits).cast("double")
