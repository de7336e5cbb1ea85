"""Search, paging and neighbourhood of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import _ASCII_LOWER, ascii_lower, search_snippet
from parlance.operators.ranking import positions
from parlance.session import written


def matches(c: Column, query: str) -> Column:
    """Literal substring test that folds ASCII case only; % and _ are ordinary characters."""
    return F.instr(ascii_lower(c), query.translate(_ASCII_LOWER)) > 0


def hit(query: str) -> Column:
    """A message that holds the query in either text."""
    return F.coalesce(matches(F.col("original_content"), query), F.lit(False)) | F.coalesce(matches(F.col("translated_content"), query), F.lit(False))


def search(messages: DataFrame, sessions: DataFrame, query: str, most: int = 50) -> DataFrame:
    """Newest hits in sessions neither deleted nor archived; a blank query finds nothing. Ties go by id."""
    open_ = sessions.where(~F.col("status").isin("deleted", "archived")).select(F.col("id").alias("session_id"), F.col("title").alias("session_title"))
    found = messages.where(F.lit(query.strip() != "") & hit(query)).join(open_, "session_id").orderBy(F.desc("created_at"), "id").limit(most)
    shown = F.when(F.coalesce("translated_content", F.lit("")) != "", F.col("translated_content")).otherwise(F.coalesce("original_content", F.lit("")))
    return found.select(F.col("id").alias("message_id"), "session_id", "session_title", "role", search_snippet(shown, query).alias("snippet"), "created_at")


def page(messages: DataFrame, before: int = 0, size: int = 20) -> DataFrame:
    """The newest `size` rows older than display_order `before`; 0 starts at the newest. Rows of one session."""
    rows = messages if not before else messages.where(F.col("display_order") < before)
    return rows.orderBy(F.desc("display_order"), "id").limit(size if size > 0 else 20)


def page_envelope(messages: DataFrame, before: int = 0, size: int = 20) -> DataFrame:
    """(n, next_cursor, has_more): older rows exist only past a full page; the cursor is then the page's least order, else 0."""
    size = size if size > 0 else 20
    rows = messages if not before else messages.where(F.col("display_order") < before)
    # one top-k of size + 1 rows answers both questions
    top = rows.select("display_order", "id").orderBy(F.desc("display_order"), "id").limit(size + 1)
    lists = top.agg(F.sort_array(F.collect_list("display_order"), asc=False).alias("o"))
    n = F.least(F.size("o"), F.lit(size))
    least = F.try_element_at(F.slice("o", 1, size), F.lit(-1))
    last = F.get("o", F.lit(size))
    more = (F.size("o") > size) & (last < least)
    return lists.select(n.alias("n"), F.when(more, least).otherwise(F.lit(0)).cast("bigint").alias("next_cursor"), F.coalesce(more, F.lit(False)).alias("has_more"))


def numbered(messages: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with `position` in session order, for sessions of any size."""
    rows = messages.where("session_id IS NOT NULL").select("session_id", "id", "display_order", "created_at", *[c for c in columns if c not in ("session_id", "id", "display_order", "created_at")])
    return written(positions(rows, ["session_id"], [F.col("display_order"), F.col("created_at"), F.col("id")]), "numbered")


def with_neighbours(rows: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """rows of `numbered` with prev_ and next_ columns; the joins are on (session, position), which doesn't repeat."""
    prev = rows.select("session_id", (F.col("position") + 1).alias("position"), *[F.col(c).alias(f"prev_{c}") for c in before])
    nxt = rows.select("session_id", (F.col("position") - 1).alias("position"), *[F.col(c).alias(f"next_{c}") for c in after])
    out = rows
    if before:
        out = out.join(prev, ["session_id", "position"], "left")
    return out.join(nxt, ["session_id", "position"], "left") if after else out


def merged_pages(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both pages; of a row on both that of the first counts."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))
