"""Inline markdown and regions as HTML."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = re.compile(r"\*\*([^*]+)\*\*|\*([^*]+)\*")


def _escaped(s: str) -> str:
    return html.escape(s).replace("&#x27;", "&#39;")


def inline_html(s: str) -> str:
    """**bold** and *italic* as tags, all else escaped; a text with such tags already is left alone."""
    if re.search("<strong>|<em>|<u>", s):
        return s
    out, at = [], 0
    for m in _SPAN.finditer(s):
        tag, inner = ("strong", m[1]) if m[1] is not None else ("em", m[2])
        out.append(f"{_escaped(s[at : m.start()])}<{tag}>{_escaped(inner)}</{tag}>")
        at = m.end()
    return "".join(out) + _escaped(s[at:])


def text_html(s: str) -> str:
    """Paragraphs at blank lines, breaks at newlines."""
    s = inline_html(re.sub(r"<br ?/?>", "\n", s.replace("\r\n", "\n")))
    paragraphs = ([x.rstrip(" \t") for x in p.strip().split("\n") if x.rstrip(" \t")] for p in s.split("\n\n"))
    return "".join(f"<p>{'<br>\n'.join(p)}</p>\n" for p in paragraphs if p)


def _inline_batch(c: pd.Series) -> pd.Series:
    return c.map(lambda s: None if s is None else inline_html(s))


def _text_batch(c: pd.Series) -> pd.Series:
    return c.map(lambda s: None if s is None else text_html(s))


def inline_html_column(c: Column) -> Column:
    return F.pandas_udf(_inline_batch, "string")(c)


def text_html_column(c: Column) -> Column:
    return F.pandas_udf(_text_batch, "string")(c)


def title_runs(found: DataFrame, key: str, mergeable: Column) -> DataFrame:
    """(key, first_idx, type, lines): runs of titles that continue each other become one; other rows stay single.

    Runs lie inside one page, so a window per page is small.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy("idx")
    joins = (F.col("type") == "title") & (F.lag("type").over(w) == "title") & F.coalesce(mergeable, F.lit(False))
    marked = found.withColumn("__run", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    return marked.groupBy(key, "__run").agg(F.min("idx").alias("first_idx"), F.min("type").alias("type"), F.array_sort(F.collect_list(F.struct("idx", "content", "html"))).alias("lines")).drop("__run")


def page_html(runs: DataFrame, key: str) -> DataFrame:
    """(key, html): the page's regions in order inside one div."""
    lines = F.filter(F.transform("lines", lambda x: F.trim(x["content"])), lambda x: x.isNotNull() & (x != ""))
    joined = F.array_join(lines, "\n")
    body = F.when(F.col("type") == "title", F.concat(F.lit("<h2>"), F.replace(inline_html_column(joined), F.lit("\n"), F.lit("<br>\n")), F.lit("</h2>\n"))).when(F.col("type") == "table", F.concat(F.col("lines")[0]["html"], F.lit("\n"))).when(F.col("type") == "text", text_html_column(joined)).otherwise("")
    parts = runs.select(key, "first_idx", body.alias("body"))
    ordered = F.array_sort(F.collect_list(F.struct("first_idx", "body")))
    return parts.groupBy(key).agg(F.concat(F.lit('<div class="page">\n'), F.array_join(F.transform(ordered, lambda x: x["body"]), ""), F.lit("</div>\n")).alias("html"))
