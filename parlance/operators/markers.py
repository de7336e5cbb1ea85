"""Numbered markers around the items of a batch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import trimmed

MARK = "(?m)^[ \\t]*<{3,}(\\d+)>{3,}"


def encoded(items: Column) -> Column:
    """<<<1>>> and the first item, and so on, with blank lines between."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("<<<"), (i + 1).cast("string"), F.lit(">>>\n"), x)), "\n\n")


def decoded(raw: Column, expected: Column) -> Column:
    """The items of a reply by slot: the last of repeated markers counts, numbers out of range are dropped, missing slots are empty.

    A reply without markers is split at blank lines and fills the slots in order.
    """
    t = trimmed(F.coalesce(raw, F.lit("")))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(MARK), F.lit(1)), lambda x: F.try_to_number(x, F.lit("9999999999")).cast("bigint"))
    bodies = F.transform(F.split(t, MARK), trimmed)
    found = F.arrays_zip(numbers.alias("n"), F.slice(bodies, 2, 1_000_000).alias("body"))
    plain = F.filter(F.transform(F.split(t, "\n\n"), trimmed), lambda x: x != "")
    slots = F.sequence(F.lit(1), F.greatest(F.lit(1), expected))
    by_mark = F.transform(slots, lambda k: F.coalesce(F.try_element_at(F.filter(found, lambda x: x["n"] == k), F.lit(-1))["body"], F.lit("")))
    by_order = F.transform(slots, lambda k: F.coalesce(F.get(plain, k - 1), F.lit("")))
    return F.when(expected < 1, F.array().cast("array<string>")).when(F.size(numbers) == 0, by_order).otherwise(by_mark)
