"""Date parsing and calendar features as Column expressions (no UDFs).

Dates in text are parsed by shape. A cell's shape is its text with every digit
written as 9 and every letter as a; the layouts that can have this shape are
looked up in one table, made on the driver from the list of layouts, which
also says where day, month and year stand. The cell is then cut at these places
once. No layout is tried on a cell whose shape excludes it, and an impossible
date is found by arithmetic, so bad cells cost no more than good ones.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DATE_FORMATS, MONTH_NAMES, TIME_PART

#: Widths a field of a layout can have; names stand for letters.
FIELD_WIDTHS = {"yyyy": [4], "yy": [2], "MMMM": sorted({len(m) for m in MONTH_NAMES}), "MMM": [3], "MM": [2], "M": [1, 2], "dd": [2], "d": [1, 2]}
#: No shape is longer; longer cells are no dates and aren't translated.
LONGEST_CELL = 32
_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def date_text(col: Column) -> Column:
    """The cell's text without blanks around it and without a time of day and zone behind the date."""
    text = F.trim(col.cast("string"))
    return F.when(text.contains(":"), F.regexp_replace(text, TIME_PART, "")).otherwise(text)


def layout_fields(layout: str) -> list[str] | None:
    """The layout's fields and the text between them; None if it isn't made of one day, month and year alone."""
    parts = re.findall(r"y+|M+|d+|[^A-Za-z']+|.", layout)
    fields = [p for p in parts if p[0].isalpha() or p == "'"]
    if any(f not in FIELD_WIDTHS for f in fields) or sorted(f[0] for f in fields) != ["M", "d", "y"]:
        return None
    return parts


def layout_shapes(layout: str) -> dict[str, dict[str, int]] | None:
    """Each shape the layout can have, with the first character and the width of ``d``, ``m`` and ``y``, and whether the month is a name (1 or 0)."""
    parts = layout_fields(layout)
    if parts is None:
        return None
    shapes = {}
    for widths in itertools.product(*[FIELD_WIDTHS.get(p, [len(p)]) for p in parts]):
        shape, at, places = "", 1, {"m_name": int("MMM" in layout)}
        for part, width in zip(parts, widths, strict=True):
            if part in FIELD_WIDTHS:
                name = part[0].lower()
                places |= {f"{name}_at": at, f"{name}_width": width}
                shape += ("a" if part.startswith("MMM") else "9") * width
            else:
                shape += re.sub("[0-9]", "9", part)
            at += width
        shapes[shape] = places
    return shapes


def shape_table(formats: list[str]) -> dict[str, list[dict[str, int]]] | None:
    """Shape -> where the parts stand, for each layout that can have it, in the layouts' order; None if some
    layout holds more than a day, month and year (then `parse_date_text` tries the layouts)."""
    table: dict[str, list[dict[str, int]]] = {}
    for layout in formats:
        shapes = layout_shapes(layout)
        if shapes is None:
            return None
        for shape, places in shapes.items():
            if places not in table.setdefault(shape, []):
                table[shape].append(places)
    return table


def cell_shape(text: Column) -> Column:
    """Digits as 9, letters as a, everything else as it is; NULL for cells longer than any date."""
    return F.when(F.length(text) <= LONGEST_CELL, F.translate(text, _DIGITS + _LETTERS, "9" * len(_DIGITS) + "a" * len(_LETTERS)))


def month_name_number(text: Column) -> Column:
    """1 to 12 from an English month's name or its first three letters in any case; else NULL."""
    names = {n.lower(): i + 1 for i, m in enumerate(MONTH_NAMES) for n in (m, m[:3])}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(text))


def valid_day(year: Column, month: Column, day: Column) -> Column:
    """DATE of these numbers, NULL if there is no such day."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(30 + (month + (month > 7).cast("int")) % 2)
    return F.when((year >= 1) & month.between(1, 12) & (day >= 1) & (day <= days), F.make_date(year, month, day))


def _staged(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that later filters can't repeat.

    A pushed filter takes the place of a projection's columns, each time they are named; it stops at a
    generator, which here makes one row of one.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_day_by_shape(df: DataFrame, text: Column, day: str, formats: list[str] | None = None) -> DataFrame:
    """``df`` with the date in ``text`` (see `date_text`) as ``day``; NULL if no layout fits.

    Fields have the widths their layout names (``d`` and ``M`` one or two digits). Shape, places and
    parts are each computed once per row.
    """
    table = shape_table(formats or DATE_FORMATS)
    out = _staged(df, "_text", text)
    if table is None:
        return out.withColumn(day, parse_date_text(F.col("_text"), formats)).drop("_text")
    names = ["y_at", "y_width", "m_at", "m_width", "m_name", "d_at", "d_width"]
    kind = "map<string,struct<" + ",".join(f"{n}:int" for n in names) + ">>"

    def places(shape: Column, i: int) -> Column:
        """Where the parts stand in the i-th layout of a shape: one list item per length, each a short map."""
        by_length = []
        for length in range(LONGEST_CELL + 1):
            entries = [x for known, found in sorted(table.items()) if len(found) > i and len(known) == length
                       for x in (F.lit(known), F.struct(*[F.lit(found[i][n]).alias(n) for n in names]))]
            by_length.append(F.create_map(*entries).cast(kind) if entries else F.lit(None).cast(kind))
        return F.try_element_at(F.get(F.array(*by_length), F.length(shape)), shape)

    out, days, cell = _staged(out, "_shape", cell_shape(F.col("_text"))), [], F.col("_text")
    for i in range(max(map(len, table.values()))):  # once, unless layouts of the list share a shape
        out = _staged(out, f"_at{i}", places(F.col("_shape"), i))
        at = F.col(f"_at{i}")
        year, month, date = (F.substring(cell, at[f"{n}_at"], at[f"{n}_width"]) for n in "ymd")
        # The shape says which parts are digits, so these casts can't fail (a failing try_cast costs an exception).
        number = F.when(at["m_name"] == 1, month_name_number(month)).otherwise(month.cast("int"))
        parts = F.struct(year.cast("int").alias("y"), number.alias("m"), date.cast("int").alias("d"))
        out = _staged(out, f"_part{i}", F.when(at.isNotNull(), parts))
        part = F.col(f"_part{i}")
        century = F.when(at["y_width"] > 2, 0).when(part["y"] >= 69, 1900).otherwise(2000)
        days.append(valid_day(part["y"] + century, part["m"], part["d"]))
    return out.withColumn(day, F.coalesce(*days)).drop("_text", "_shape", *[f"_{c}{i}" for i in range(len(days)) for c in ("at", "part")])


def parse_date_text(col: Column, formats: list[str] | None = None) -> Column:
    """``date_text`` -> DATE by trying an ordered list of layouts of any kind; invalid text -> NULL.

    ``try_to_timestamp`` returns NULL instead of failing on bad, empty or
    impossible dates, so the first layout that fits wins and nothing raises
    under ANSI mode. Every layout repeats what it is given, and a miss costs an
    exception; `with_day_by_shape` is the way for layouts of day, month and year.
    """
    text = col
    tries = []
    for fmt in formats or DATE_FORMATS:
        day = F.try_to_timestamp(text, F.lit(fmt)).cast("date")
        if "yy" in fmt and "yyyy" not in fmt:  # 69 to 99 are the last century's
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        tries.append(day)
    return F.coalesce(*tries)


def year_of(col: Column) -> Column:
    return F.year(col)


def month_of(col: Column) -> Column:
    return F.month(col)


def day_of(col: Column) -> Column:
    return F.dayofmonth(col)


def weekday_monday0(col: Column) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col)


def iso_week(col: Column) -> Column:
    """ISO-8601 week number (weeks start Monday, week 1 holds Jan 4th)."""
    return F.weekofyear(col)
