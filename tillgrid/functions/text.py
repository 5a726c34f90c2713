"""Text-producing Column expressions: flags, month names, display formats,
log-line parsing and status normalisation. All are built-in expressions so
they stay inside whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    CURRENCY_SYMBOL,
    GROWTH_DOWN_TEXT,
    GROWTH_UP_TEXT,
    MONTH_NAMES,
    PROMOTION_TRUE_TOKENS,
    RANGE_HIGH,
    RANGE_LOW,
    RUN_LOG_PATTERN,
    RUN_LOG_TS_FORMAT,
)


def promotion_flag(col: Column) -> Column:
    """1 when the lower-cased text of the cell is a truth token, else 0."""
    return F.when(F.lower(col.cast("string")).isin(*PROMOTION_TRUE_TOKENS), F.lit(1)).otherwise(F.lit(0))


def _month_array() -> Column:
    return F.array(*[F.lit(m) for m in MONTH_NAMES])


def month_name(month: Column) -> Column:
    """Month number -> English name; anything outside 1..12 -> the number as text."""
    m = month.cast("int")
    return F.when(m.between(1, 12), F.element_at(_month_array(), m)).otherwise(month.cast("string"))


def month_token_map() -> Column:
    """Map from month number text ("1".."12") to month name."""
    return F.map_from_arrays(
        F.array(*[F.lit(str(i + 1)) for i in range(12)]), _month_array())


PEAK_PREFIX = "Peak sales months are"


def rewrite_month_numbers(text: Column) -> Column:
    """Rewrite "Peak sales months are 7, 8, 12." with month names.

    Splits the text after the last "are", splits that tail on commas, keeps
    the pieces that are exactly a month number after trimming (a trailing
    period makes a piece not match) and rebuilds the sentence. Texts without
    the phrase, or with no matching piece, come back unchanged.
    """
    tail = F.element_at(F.split(text, "are"), -1)
    pieces = F.split(F.trim(tail), ",")
    lookup = month_token_map()
    names = F.filter(F.transform(pieces, lambda p: F.element_at(lookup, F.trim(p))),
                     lambda n: n.isNotNull())
    rebuilt = F.concat(F.lit(PEAK_PREFIX + " "), F.array_join(names, ", "), F.lit("."))
    return F.when(text.contains(PEAK_PREFIX) & (F.size(names) > 0), rebuilt).otherwise(text)


def filled(template: str, **values: Column) -> Column:
    """A sentence template with columns in its ``{places}``; NULL if one of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def currency_text(value: Column) -> Column:
    """``₹1,234.50``; missing -> ``₹0.00``. Value rounded half-up to cents first."""
    v = F.coalesce(F.round(value.cast("double"), 2), F.lit(0.0))
    return F.concat(F.lit(CURRENCY_SYMBOL), F.format_number(v, 2))


def python_number_text(value: Column) -> Column:
    """Text of a double rounded to cents, as a plain number at any size ("3.0", "1.5", "20000000.0")."""
    v = value.cast("double")
    return F.when(F.abs(v) >= 1e7, F.regexp_replace(F.format_string("%.2f", v), "0$", "")).otherwise(v.cast("string"))


def forecast_range_text(next_value: Column) -> Column:
    """``"lo - hi"`` for a +/-5 % band, each end rounded half-to-even to an integer; NULL without a forecast."""
    lo = F.bround(next_value * F.lit(RANGE_LOW), 0).cast("bigint")
    hi = F.bround(next_value * F.lit(RANGE_HIGH), 0).cast("bigint")
    return F.concat(lo.cast("string"), F.lit(" - "), hi.cast("string"))


def growth_text(growth: Column) -> Column:
    """``"x% (Increasing 📈)"`` with x = growth*100 rounded to 2 dp."""
    pct = python_number_text(F.round(growth * 100, 2))
    label = F.when(growth > 0, F.lit(GROWTH_UP_TEXT)).otherwise(F.lit(GROWTH_DOWN_TEXT))
    return F.concat(pct, F.lit("% ("), label, F.lit(")"))


def normalise_status(status: Column) -> Column:
    """``upper(status or "UNKNOWN")`` (empty text counts as missing)."""
    s = F.when(F.length(status) > 0, status).otherwise(F.lit(None))
    return F.upper(F.coalesce(s.cast("string"), F.lit("UNKNOWN")))


def status_badge(status: Column) -> Column:
    """Three-way badge class of a normalised status."""
    s = normalise_status(status)
    return (F.when(s == "SUCCEEDED", F.lit("success"))
            .when(s == "FAILED", F.lit("failed"))
            .otherwise(F.lit("running")))


def log_field(line: Column, group: int) -> Column:
    return F.regexp_extract(line, RUN_LOG_PATTERN, group)


def parse_log_line(line: Column) -> dict[str, Column]:
    """Run-log line -> (ts, level, run_id, message); non-matching lines give NULLs."""
    matched = line.rlike(RUN_LOG_PATTERN)
    run_id = log_field(line, 3)
    return {
        "ts": F.when(matched, F.try_to_timestamp(log_field(line, 1), F.lit(RUN_LOG_TS_FORMAT))),
        "level": F.when(matched, log_field(line, 2)),
        "run_id": F.when(matched & (run_id != ""), run_id),
        "message": F.when(matched, log_field(line, 4)),
    }
