"""Markdown pages as typed regions, and markdown tables.

A page's blocks are found with Column expressions where order alone matters; the fan-out of a page into regions keeps
state from block to block and runs as one Arrow-batched function per page.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import trimmed

REGION = "array<struct<type: string, content: string, alignment: string, html: string, figure_type: string>>"
# Fixed values.
STAMPS = ("TM/", "UBHC")
WATERMARKS = ("scanned with", "camscanner")
CENTERED = ("Độc lập", "Hạnh phúc")
RIGHT_COLUMN = ("Nợ TK:", "Có TK:", "No TK:", "Co TK:", "Phí:", "Phi:", "VAT:", "Vat:")
ROMAN_LABEL = re.compile(r"(X{0,3})(IX|IV|V?I{0,3})\.", re.IGNORECASE)
HASHES = re.compile(r"(#{1,4})\s+(.+)")
IMAGE = re.compile(r"!\[.*?\]\(.*?\)")


def blocks(md: Column) -> Column:
    """Blank-line delimited blocks; a line that begins with # starts its own."""
    marked = F.transform(F.split(md, "\n"), lambda x: F.when(trimmed(x) == "", F.lit("\x00")).when(trimmed(x).startswith("#"), F.concat(F.lit("\x00"), x)).otherwise(x))
    return F.filter(F.transform(F.split(F.array_join(marked, "\n"), "\x00"), lambda b: F.regexp_replace(b, "^\n+|\n+$", "")), lambda b: b != "")


def is_noise(c: Column) -> Column:
    """A single capital, or at most four code points that are neither ASCII nor Latin."""
    t = trimmed(c)
    return t.rlike("^[A-Z]$") | t.rlike("^[^\\x00-\\x7f\\u00c0-\\u024f\\u1e00-\\u1eff]{1,4}$")


def is_stamp(c: Column) -> Column:
    t = trimmed(c)
    few_lower = F.length(F.regexp_replace(t, "[^a-z]", "")) <= 3
    return F.length(t).between(1, 60) & few_lower & (F.upper(t).contains(STAMPS[0]) | F.upper(t).contains(STAMPS[1]))


def is_bold_heading(c: Column) -> Column:
    t = trimmed(c)
    inner = F.substring(t, F.lit(3), F.length(t) - 4)
    return t.startswith("**") & t.endswith("**") & (F.octet_length(t) >= 5) & ~inner.contains("**") & ~inner.contains("\n")


def is_implied_heading(c: Column) -> Column:
    first = trimmed(F.split_part(c, F.lit("\n"), F.lit(1)))
    return ~c.rlike("^[#|*!>-]") & F.length(first).between(4, 100) & ~first.rlike("\\p{Ll}")


def mergeable_title(c: Column) -> Column:
    t = trimmed(c)
    return (F.length(t) <= 80) & ~c.endswith(":") & ~c.rlike("^(I|II|III|IV|V|VI|VII|VIII|IX|X)\\.( |$)")


def cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, "^\\|+|\\|+$", ""), "\\|"), trimmed)


def is_separator(line: Column) -> Column:
    return F.forall(cells(line), lambda c: c.rlike("^[:-]*$"))


def _caps(s: str) -> bool:
    return s == s.upper()


def alignment(content: str) -> str:
    c = content.strip()
    if ROMAN_LABEL.match(c) or c.upper().startswith("BÊN "):
        return "left"
    return "center" if any(x in content for x in CENTERED) or _caps(c) and len(c) > 3 else "left"


class MarkdownTable:
    """Rows of a markdown table; lines without a leading bar continue the cell before."""

    def __init__(self, block: str):
        lines: list[str] = []
        for line in block.split("\n"):
            if lines and line.strip() and not line.strip().startswith("|"):
                lines[-1] += "<br>" + line.strip()
            else:
                lines.append(line)
        bars = [x.strip() for x in lines if x.strip().startswith("|")]
        self.bars = len(bars)
        split = [[c.strip() for c in b.strip("|").split("|")] for b in bars]
        rules = [all(not c.strip(":-") for c in row) for row in split]
        self.rows = [row for row, rule in zip(split, rules, strict=True) if not rule]
        self.ruled = any(rules)
        first_rule = rules.index(True) if self.ruled else len(rules)
        self.headers = [k < first_rule for k, rule in enumerate(rules) if not rule]

    @property
    def is_table(self) -> bool:
        return self.bars >= 2

    @property
    def is_form(self) -> bool:
        """Two columns of which the second begins with a colon."""
        return len(self.rows) >= 2 and all(len(r) == 2 and (not r[1] or r[1].startswith(":")) for r in self.rows)

    def form_text(self) -> str:
        return "\n".join(f"{a} {b}" for a, b in (r for r in self.rows if len(r) == 2) if a or b)

    def without_empty_columns(self) -> list[list[str]]:
        used = {k for row in self.rows for k, c in enumerate(row) if c.strip()}
        return [[c for k, c in enumerate(row) if k in used] for row in self.rows]

    def html(self) -> str:
        rows, headers = self.without_empty_columns(), self.headers
        if self.ruled and len(rows) > 2 and headers[0] and len(rows[0]) > 1 and 0 < len(rows[0][0]) <= 30 and len(rows[0][1]) >= 10:
            headers = [False] * len(rows)  # a form whose first row is data

        def to_right(line: str) -> bool:
            return line.strip().startswith(RIGHT_COLUMN)

        if any(to_right(x) for row in rows for c in row for x in c.split("<br>")):
            headers = [False] * len(rows)
            if len(rows[0]) > 1 and not any(c.strip() for row in rows for c in row[1:]):
                parts = [([x for x in r[0].split("<br>") if not to_right(x)], [x for x in r[0].split("<br>") if to_right(x)]) for r in rows]
                rows = [["<br>".join(a), *r[1:-1], "<br>".join(b)] for r, (a, b) in zip(rows, parts, strict=True)]
        out = ['<table border="1" style="border-collapse:collapse;width:100%">']
        for row, header in zip(rows, headers, strict=True):
            body = "".join(self._cells(row, header))
            out.append(f"<thead><tr>{body}</tr></thead><tbody>" if header else f"<tr>{body}</tr>")
        return "".join(out) + "</tbody></table>"

    @staticmethod
    def _cells(row: list[str], header: bool) -> Iterable[str]:
        tag, k = ("th" if header else "td"), 0
        while k < len(row):
            end = k + 1
            while header and row[k].strip() and end < len(row) and not row[end].strip():
                end += 1
            yield f'<{tag} colspan="{end - k}">{row[k]}</{tag}>' if end - k > 1 else f"<{tag}>{row[k]}</{tag}>"
            k = end


def _region(kind: str, content: str | None = None, align: str | None = None, html: str | None = None, figure: str | None = None) -> dict:
    return {"type": kind, "content": content, "alignment": align, "html": html, "figure_type": figure}


def _noise(b: str) -> bool:
    low = b.lower()
    if any(w in low for w in WATERMARKS):
        return True
    if re.fullmatch(r"[A-Z]", b) or re.fullmatch("[^\x00-\x7fÀ-ɏḀ-ỿ]{1,4}", b):
        return True
    return len(b) <= 60 and sum("a" <= c <= "z" for c in b) <= 3 and any(s in b.upper() for s in STAMPS)


def regions_of(found: list[str]) -> list[dict]:
    """Typed regions of a page's blocks, in order."""
    out: list[dict] = []
    table_seen = False
    for b in (x.strip() for x in found):
        lines = [x.strip() for x in b.split("\n") if x.strip()]
        if not b or _noise(b):
            continue
        if IMAGE.search(b):
            out.append(_region("figure", figure="decorative"))
        elif (table := MarkdownTable(b)).is_table:
            if table.is_form:
                if text := table.form_text():
                    out.append(_region("text", text, "left"))
            else:
                table_seen = True
                out.append(_region("table", html=table.html()))
        elif b.startswith("**") and b.endswith("**") and len(b.encode()) >= 5 and not re.search(r"\*\*|\n", b[2:-2]):
            out.append(_region("title", b[2:-2].strip(), alignment(b[2:-2].strip())))
        elif not table_seen and b[0] not in "#|*-!>" and 4 <= len(lines[0]) <= 100 and _caps(lines[0]):
            side = "left"
            for x in lines:
                if _caps(x) and len(x) > 3:
                    side = alignment(x)
                    out.append(_region("title", x, side))
                else:
                    out.append(_region("title" if side == "center" else "text", x, side))
        elif m := HASHES.match(b):
            side = alignment(m[2].strip())
            out.append(_region("title", m[2].strip(), side))
            for x in lines[1:]:
                again = HASHES.match(x)
                out.append(_region("title", again[2].strip(), alignment(again[2].strip())) if again else _region("title", x, side))
        else:
            out += [_region("text", x, "left") for x in lines]
    return out


def _regions_batch(found: pd.Series) -> pd.Series:
    return found.map(lambda x: regions_of(list(x)) if x is not None else None)


def regions(df: DataFrame, key: str, md: str) -> DataFrame:
    """(key, idx, type, content, alignment, html, figure_type); NULL and empty pages have no region."""
    return df.select(key, F.posexplode(F.pandas_udf(_regions_batch, REGION)(blocks(F.col(md)))).alias("idx", "r")).select(key, "idx", "r.*")


def segments(found: DataFrame, key: str) -> DataFrame:
    """Translatable regions: (key, idx, text, is_html)."""
    inline = F.coalesce(F.col("content").rlike("<strong>|<em>|<u>"), F.lit(False))
    text = F.when(F.col("type").isin("text", "title"), F.col("content")).when(F.col("type") == "table", F.col("html"))
    return found.select(key, "idx", text.alias("text"), F.when(F.col("type") == "table", True).otherwise(inline).alias("is_html")).where(trimmed(F.col("text")) != "")


def crosses_pages(html: Column) -> Column:
    """A bracketed number and a body of one row: a table that goes on over the page."""
    body = F.substring(html, F.instr(html, "<tbody>"), F.length(html))
    return html.rlike("\\[\\d[\\d.]*\\]") & html.contains("<tbody>") & (F.size(F.split(body, "<tr>")) == 2)


def merge_companion(html: Column, companion: Column) -> Column:
    """Rows of the companion, its headers as data cells, in front of the table's end."""
    rows = F.regexp_replace(F.array_join(F.regexp_extract_all(companion, F.lit("(?s)<tr>.*?</tr>"), F.lit(0)), ""), "<(/?)th", "<$1td")
    at = F.instr(html, "</tbody></table>")
    return F.when((at > 0) & (rows != ""), F.concat(F.substring(html, F.lit(1), at - 1), rows, F.substring(html, at, F.length(html)))).otherwise(html)
