"""Column expressions shared by the operators.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: days in the mean Gregorian month (365.2425 / 12).
MEAN_MONTH_DAYS = 30.436875

# Natural log of a reading, with a zero counted as 0.1.
LOG_VOLUME = "ln(CASE WHEN volume_kgals = 0 THEN 0.1D ELSE volume_kgals END)"


def null_for_nan(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    return df.withColumns({
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    })


def occupant_key(location_id: Column, cis_occupant_id: Column) -> Column:
    """``<location>-<occupant>``, the occupant padded to three digits at least.

    ``lpad`` would cut a four-digit number, so the number is formatted instead.
    """
    return F.when(
        location_id.isNotNull() & cis_occupant_id.isNotNull(),
        F.format_string("%d-%03d", location_id, cis_occupant_id),
    )


def month_of(ts: Column) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(F.to_date(ts), "MM")


def assemble_date(year: Column, month: Column, day: Column) -> Column:
    """Midnight of year-month-day with the day clamped into that month."""
    first = F.make_date(year, month, F.lit(1))
    clamped = F.greatest(F.lit(1), F.least(day, F.dayofmonth(F.last_day(first))))
    return F.make_date(year, month, clamped).cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from start to end, free of any session time zone."""
    def seconds(ts: Column) -> Column:
        second = F.extract(F.lit("SECOND"), ts).cast("double")
        return F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + second

    return F.datediff(end, start) + (seconds(end) - seconds(start)) / 86400.0


def whole_mean_months(start: Column, end: Column) -> Column:
    """Mean months from start to end, rounded half to even."""
    return F.bround(days_between(start, end) / F.lit(MEAN_MONTH_DAYS)).cast("int")


def late_flag(late_charge: Column) -> Column:
    return (F.coalesce(late_charge, F.lit(0.0)) > 0).cast("int")


def md5_of(*cols: str) -> Column:
    """Hex digest of the columns joined by '|': the reproducible stand-in for a random order."""
    return F.expr(f"md5(binary(concat_ws('|', {', '.join(f'string(`{c}`)' for c in cols)})))")


def md5_number(text: str, part: int = 0) -> Column:
    """A number below 2^32 from the text's digest, one of four (part 0 to 3); other engines can repeat it."""
    return F.expr(f"bigint(conv(substring(md5(binary({text})), {8 * part + 1}, 8), 16, 10))")


def canonical_text(df: DataFrame, column: str) -> str:
    """SQL for a column's value as text that does not depend on the file format or the engine: numbers with a
    fraction to six digits, timestamps to the second, NULL as a text of its own."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        value = f"CAST(CAST(round(CAST(`{column}` AS DOUBLE) * 1000000) AS BIGINT) AS STRING)"
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = f"date_format(`{column}`, 'yyyy-MM-dd HH:mm:ss')"
    else:
        value = f"CAST(`{column}` AS STRING)"
    return f"coalesce({value}, '<null>')"
