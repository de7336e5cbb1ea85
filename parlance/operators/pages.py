"""Pages of scanned and printed files: recognised text as JSON, scan detection, previews and tables that go on over a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import estimated_chunks, estimated_minutes, trimmed
from parlance.operators.ranking import positions

RESPONSE = "pages array<struct<index: int, markdown: string>>"
#: Limits of what is accepted: bytes of a PDF and pages.
PDF_BYTES, PDF_PAGES = 50 * 1024 * 1024, 200


def recognised(df: DataFrame, key: str, response: str) -> DataFrame:
    """(key, page_no, markdown) of landed responses; page_no is the index plus one, broken responses have no page."""
    parsed = F.from_json(F.col(response), RESPONSE)
    return df.select(key, F.explode(parsed["pages"]).alias("p")).select(key, (F.col("p.index") + 1).alias("page_no"), F.coalesce("p.markdown", F.lit("")).alias("markdown"))


def first_pages(pages: DataFrame, key: str, n: int) -> DataFrame:
    """(key, text): the markdown of the first n pages in order, parted by empty lines; blank pages are left out."""
    some = pages.where((F.col("page_no") <= n) & (trimmed(F.col("markdown")) != "")).groupBy(key)
    return some.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", trimmed(F.col("markdown")).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def form_feed_pages(c: Column) -> Column:
    """Pages of a printed text, parted by form feeds."""
    return F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\f")


def scan_info(pages: DataFrame, key: str, order: list[Column], chars: Column, sample: int = 10, dense: int = 50, guess: int = 2_000) -> DataFrame:
    """(key, pages, is_scanned, char_count) by the mean length of the first `sample` pages; a key may hold any share of the pages."""
    placed = positions(pages.select(key, chars.alias("__chars"), *[c.alias(f"__k{i}") for i, c in enumerate(order)]), [key], [F.col(f"__k{i}") for i in range(len(order))], "__at")
    sampled = F.coalesce(F.sum(F.when(F.col("__at") <= sample, F.col("__chars"))), F.lit(0))
    found = placed.groupBy(key).agg(F.count("*").alias("pages"), sampled.alias("s"))
    mean = F.floor(F.col("s") / F.least(F.col("pages"), F.lit(sample)))
    return found.select(key, "pages", (mean < dense).alias("is_scanned"), F.when(mean < dense, F.col("pages") * guess).when(F.col("pages") > sample, mean * F.col("pages")).otherwise(F.col("s")).cast("bigint").alias("char_count"))


def file_info(df: DataFrame, key: str, name: Column, size: Column, pages: Column, chars: Column) -> DataFrame:
    """(key, kind, problem, chunks, minutes): which reader takes a file, and why it is refused; NULL problem means accepted."""
    kind = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), "\\.([^.]+)$", 1))
    problem = (
        F.when(~kind.isin("pdf", "docx", "xlsx"), "unsupported")
        .when((kind == "pdf") & (size > PDF_BYTES), "too large")
        .when((kind == "pdf") & (F.coalesce(pages, F.lit(0)) < 1), "no pages")
        .when((kind == "pdf") & (pages > PDF_PAGES), "too many pages")
        .when((kind == "xlsx") & (F.coalesce(chars, F.lit(0)) < 1), "no text")
    )
    chunks = estimated_chunks(chars)
    return df.select(key, kind.alias("kind"), problem.alias("problem"), F.when(problem.isNull(), chunks).alias("chunks"), F.when(problem.isNull(), estimated_minutes(chunks)).alias("minutes"))


def preview(found: DataFrame, key: str) -> DataFrame:
    """(key, text): regions of a page as readable markdown; tables and figures by a mark. Regions of one page are few."""
    part = (
        F.when(F.col("type") == "title", F.concat(F.lit("## "), F.coalesce("content", F.lit(""))))
        .when((F.col("type") == "text") & (trimmed(F.col("content")) != ""), F.col("content"))
        .when(F.col("type") == "table", F.lit("[Bảng]"))
        .when((F.col("type") == "figure") & (F.col("figure_type") == "informational") & (F.coalesce("content", F.lit("")) != ""), F.concat(F.lit("[Hình: "), F.col("content"), F.lit("]")))
    )
    rows = found.select(key, "idx", part.alias("part")).where("part IS NOT NULL").groupBy(key)
    return rows.agg(trimmed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "part"))), lambda x: x["part"]), "\n\n")).alias("text"))


def repaired(tables: DataFrame, key: str, page: str, html: str, crosses: Column, merge) -> DataFrame:
    """(key, page, html): a table that goes on over the page takes the rows of the first table of the next page."""
    nxt = tables.groupBy(key, page).agg(F.min_by(html, "nth").alias("__next")).select(key, (F.col(page) - 1).alias(page), "__next")
    return tables.join(nxt, [key, page], "left").select(key, page, F.when(crosses & F.col("__next").isNotNull(), merge(F.col(html), F.col("__next"))).otherwise(F.col(html)).alias(html))


def header_columns(html: Column) -> Column:
    """Columns of a table by the first row of its head; 0 without one."""
    row = F.regexp_extract(html, "(?s)<thead>(.*?)</tr>", 1)
    return F.regexp_count(row, F.lit("<th>")).cast("int")


def body_columns(html: Column) -> Column:
    """Columns of a table by the first row of its body; 0 without one."""
    row = F.regexp_extract(html, "(?s)<tbody>.*?<tr>(.*?)</tr>", 1)
    return F.regexp_count(row, F.lit("<t[dh]>")).cast("int")
