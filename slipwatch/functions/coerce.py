"""Typing and cleaning of loosely typed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipwatch import schema as S

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(c: Column, default: float | Column | None = 0.0) -> Column:
    """Text to double; thousands separators dropped, anything unreadable becomes `default`.

    The pattern guards the cast, because Spark also reads '1d' and 'nan' as numbers.
    """
    text = F.trim(F.regexp_replace(c.cast("string"), ",", ""))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    if default is None:
        return number
    return F.coalesce(number, default if isinstance(default, Column) else F.lit(float(default)))


# Shape of a date text -> how to read it. The shape is tested first, because a failed
# parse is far dearer than a failed match.
DATE_SHAPES = {
    r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$": "d/M/yyyy",
    r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$": "d-M-yyyy",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$": "yyyy-M-d",
    r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$": "d/M/yy",
}


def parse_date(c: Column) -> Column:
    """Date from one of four day-first or ISO shapes, else null."""
    text = F.trim(c)
    out = F.lit(None).cast("date")
    for shape, pattern in DATE_SHAPES.items():
        day = F.try_to_date(text, pattern)
        if pattern.endswith("/yy"):
            # Two-digit years from 69 belong to the last century.
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        out = F.when(text.rlike(shape), day).otherwise(out)
    return out


def month_ordinal(month: Column) -> Column:
    """'YYYY-MM' to months since year 0; the key of calendar windows."""
    return (F.substring(month, 1, 4).try_cast("int") * 12 + F.substring(month, 6, 2).try_cast("int") - 1).cast("int")


def ordinal_month(ordinal: Column) -> Column:
    """Inverse of `month_ordinal`."""
    return F.concat_ws(
        "-",
        F.lpad(F.floor(ordinal / 12).cast("string"), 4, "0"),
        F.lpad((F.pmod(ordinal, F.lit(12)) + 1).cast("string"), 2, "0"),
    )


def mid_month(ordinal: Column) -> Column:
    """The 15th of a month given by its ordinal."""
    return F.make_date(F.floor(ordinal / 12).cast("int"), (F.pmod(ordinal, F.lit(12)) + 1).cast("int"), F.lit(15))


def canonical_sector(c: Column, case_sensitive: bool = False) -> Column:
    """Portal sector label to its group by ordered substring rules, else unchanged."""
    name = F.trim(F.coalesce(F.when(c != "", c), F.lit("Other")))
    seen = name if case_sensitive else F.lower(name)
    out = None
    for words, target in S.SECTOR_RULES:
        hit = F.lit(False)
        for word in words:
            hit = hit | seen.contains(word.capitalize() if case_sensitive else word)
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return out.otherwise(name)


def lookup(c: Column, table: dict[str, object]) -> Column:
    """Value of a small fixed table, null where the key is missing (no join)."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), c)


def alias_sector(c: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(c)), S.SECTOR_ALIASES), F.trim(c))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def money(c: Column) -> Column:
    """Decimal with two places, for text output."""
    return c.cast("decimal(18,2)")


def cents(c: Column) -> Column:
    """Whole cents of amounts that are bounded per group: exact in any order, and cheaper than decimals."""
    return F.rint(c * 100.0).cast("bigint")


def exact_cents(c: Column) -> Column:
    """Whole cents as decimals, for totals over any number of rows; what no decimal holds is left out."""
    return F.rint(c * 100.0).try_cast("decimal(28,0)")


def from_cents(total: Column) -> Column:
    return total / 100.0


def rescale_units(expenditure: Column, cost: Column) -> Column:
    """Spend above twenty times the cost was filed in the smaller unit."""
    return F.when(wrong_units(expenditure, cost), expenditure / 100.0).otherwise(expenditure)


def wrong_units(expenditure: Column, cost: Column) -> Column:
    return (cost > 0) & (expenditure > cost * 20.0)


def mentions(c: Column, words: list[str]) -> Column:
    """Plain substring test for any of the words, case-insensitive."""
    return F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))
