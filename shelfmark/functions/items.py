"""Column expressions over multi-item fields (``ARRAY<STRING>``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space, as a regex class valid in Java and RE2.
SPACE_CLASS = (
    r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
ITEM_DELIMITER = "$|$"

_EDGES = rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.regexp_replace(col(c), _EDGES, "")


def literal_regex(text: str) -> str:
    """``text`` as a regex that matches exactly itself."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def no_items() -> Column:
    return F.array().cast("array<string>")


def split_items(c: str | Column, delimiter: str | None = ITEM_DELIMITER) -> Column:
    """Field to items; null and '' give no item, a blank field gives one empty item."""
    c = col(c)
    if delimiter is None:
        items = F.array(c)
    else:
        items = F.transform(F.split(c, literal_regex(delimiter), -1), strip)
    return F.when(c.isNull() | (c == ""), no_items()).otherwise(items)


def select_items(c: str | Column, selector: int | slice) -> Column:
    """Pick items by position, half-open range or range with a step; a position out of range gives no item."""
    c = col(c)
    if isinstance(selector, int):
        return F.slice(c, selector + 1, 1)
    first, last, step = selector.start or 0, selector.stop, selector.step or 1
    if step == 1:
        length = F.size(c) if last is None else F.lit(max(last - first, 0))
        return F.slice(c, F.lit(first + 1), length)

    def chosen(_, i):
        keep = (i >= first) & ((i - first) % step == 0)
        return keep if last is None else keep & (i < last)

    return F.filter(c, chosen)


def is_empty(c: str | Column) -> Column:
    c = col(c)
    return c.isNull() | (F.size(c) <= 0)


def match_items(c: str | Column, pattern: str) -> Column:
    """Items that match ``pattern`` at their start."""
    return F.filter(col(c), lambda x: x.rlike(rf"\A(?:{pattern})"))


def concat_fields(*fields: str | Column) -> Column:
    """Item lists appended in order, duplicates kept; null when nothing is left."""
    joined = F.concat(*[F.coalesce(col(f), no_items()) for f in fields])
    return F.when(F.size(joined) > 0, joined)


def first_item(c: str | Column) -> Column:
    return F.get(col(c), F.lit(0))


def join_items(c: str | Column, delimiter: str = ITEM_DELIMITER) -> Column:
    """Items back to one field; no items gives ''."""
    return F.coalesce(F.array_join(col(c), delimiter), F.lit(""))
