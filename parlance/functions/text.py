"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ELLIPSIS = "…"
VIETNAMESE_ONLY = "ăđơưắằẳẵặấầẩẫậếềểễệốồổỗộớờởỡợứừửữự"
VIETNAMESE_WIDE = "àáâãèéêìíòóôõùúýăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
EAST_ASIAN = "\\p{IsHan}\\u3040-\\u30ff\\uac00-\\ud7af"
REFUSAL_PREFIXES = (
    "i'm sorry, but i cannot",
    "i'm sorry, i cannot",
    "i'm unable to",
    "i cannot assist",
    "i can't help with that",
    "sorry, but i cannot",
    "i cannot provide",
    "i'm not able to",
    "as an ai",
)
SECTION_WORDS = "PHẦN|CHƯƠNG|CHAPTER|PHỤ\\s+LỤC|MỤC|PART"
ROMAN = "I{1,3}|IV|VI{0,3}|IX|XI{0,3}|XIV|XV|XVI{0,3}|XIX|XX"
DEFAULT_TITLE = "Phiên dịch"


def trimmed(c: Column) -> Column:
    """Without outer Unicode white space."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def truncated(c: Column, n: int) -> Column:
    """The first n code points with an ellipsis, or the whole if it is no longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


def letters(c: Column, kind: str = "\\p{L}") -> Column:
    """Number of code points of a class."""
    return F.length(F.regexp_replace(c, f"[^{kind}]", ""))


def token_estimate(c: Column) -> Column:
    """0 for an empty text, else a quarter of its bytes, at least 1."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.octet_length(c) / 4))).cast("int")


def estimated_chunks(chars: Column, size: int = 2_500) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(chars, F.lit(0)) / size)).cast("int")


def estimated_minutes(chunks: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((chunks + 1) / 2)).cast("int")


def page_count(chars: Column, per_page: int = 2_800) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(chars, F.lit(0)) / per_page)).cast("int")


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.floor(done * 100 / total)).cast("int")


def file_size_label(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024))
        .otherwise(F.format_string("%.1f MB", size / (1024 * 1024)))
    )


def language_hint(c: Column) -> Column:
    """vi, en or auto: Vietnamese letters first, East Asian scripts are open, long texts of mostly ASCII letters are English."""
    n, ascii_n = letters(c), letters(c, "A-Za-z")
    english = (F.length(trimmed(c)) >= 28) & (n >= 14) & (ascii_n >= 0.88 * n)
    return F.when(c.rlike(f"(?iu)[{VIETNAMESE_ONLY}]"), "vi").when(c.rlike(f"[{EAST_ASIAN}]"), "auto").when(english, "en").otherwise("auto")


def language_guess(c: Column) -> Column:
    """vi or unknown, by the wider set of letters that other Latin languages share."""
    return F.when(c.rlike(f"(?iu)[{VIETNAMESE_WIDE}]"), "vi").otherwise("unknown")


def mostly_upper(c: Column) -> Column:
    """At least ten letters of which 82 percent are capitals."""
    n = letters(c)
    return (n >= 10) & (letters(c, "\\p{Lu}") >= 0.82 * n)


def heading_level(line: Column) -> Column:
    """0 for body text, 2 to 4 for headings by numbering, keyword or capitals."""
    t = trimmed(line)
    n = F.length(t)
    return (
        F.when(n < 4, 0)
        .when(t.rlike("^\\d+\\.\\d+\\.\\d+\\.?\\s+\\S"), 4)
        .when(t.rlike("^\\d+\\.\\d+\\.?\\s+\\S"), 3)
        .when(t.rlike("^\\d+\\.\\s+\\S") | t.rlike(f"^({ROMAN})\\.\\s+\\S") | t.rlike(f"(?iu)^({SECTION_WORDS})\\s+"), 2)
        .when(mostly_upper(t) & n.between(12, 360), 2)
        .otherwise(0)
    )


def heading_continues(line: Column) -> Column:
    """A wrapped heading's next line: capitals, or a short parenthesis."""
    t = trimmed(line)
    return (t.startswith("(") & t.endswith(")") & (F.length(t) <= 80)) | mostly_upper(t)


def bullet(line: Column) -> Column:
    """• and + bullets as markdown dashes."""
    return F.when(line.rlike("^[•+]\\s+"), F.concat(F.lit("- "), trimmed(F.regexp_replace(line, "^[•+]\\s+", "")))).otherwise(line)


def looks_markdown(c: Column) -> Column:
    return c.contains("##") | c.rlike("(?m)^\\s*##? ") | (F.size(F.split(c, "\\*\\*")) > 2) | (c.contains("![") & c.contains("]("))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape_html(c: Column) -> Column:
    return _replaced(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def escape_xml(c: Column) -> Column:
    return _replaced(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def unescape_xml(c: Column) -> Column:
    """Entities in the order that makes &amp;lt; a bracket."""
    return _replaced(c, (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")))


def title_of(content: Column) -> Column:
    """First line without heading marks, at most 50 code points; a default for blank texts."""
    t = trimmed(content)
    first = trimmed(F.split_part(t, F.lit("\n"), F.lit(1)))
    plain = F.when(first.startswith("#"), trimmed(F.regexp_replace(first, "^#+", ""))).otherwise(first)
    return F.when(F.coalesce(t, F.lit("")) == "", DEFAULT_TITLE).otherwise(truncated(plain, 50))


def session_title(title: Column, content: Column) -> Column:
    t = trimmed(F.coalesce(title, F.lit("")))
    return F.when(t != "", truncated(t, 80)).otherwise(title_of(content))


def file_title(name: Column) -> Column:
    return F.regexp_replace(name, "\\.[^.]+$", "")


def attachment_name(content: Column) -> Column:
    return F.regexp_extract(content, "^📎\\s*(.+?)\\s*$", 1)


def quote_snippet(c: Column, n: int = 140) -> Column:
    return truncated(trimmed(F.regexp_replace(c, "(?U)\\s+", " ")), n)


def search_snippet(content: Column, query: str) -> Column:
    """Newlines as blanks; long texts as a window around the first hit. Positions are code points."""
    c = F.replace(content, F.lit("\n"), F.lit(" "))
    at = F.instr(ascii_lower(c), query.translate(_ASCII_LOWER)) - 1
    start = F.greatest(F.lit(0), at - 40)
    end = F.least(F.length(c), at + len(query) + 60)
    window = F.concat(F.when(start > 0, ELLIPSIS).otherwise(""), F.substring(c, start + 1, end - start), F.when(end < F.length(c), ELLIPSIS).otherwise(""))
    return F.when(F.length(c) <= 120, c).when(at < 0, F.concat(F.substring(c, 1, 120), F.lit(ELLIPSIS))).otherwise(window)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def highlighted(c: Column, query: str) -> Column:
    """Hits of a literal query, in any case, between mark tags."""
    quoted = "".join("\\" + x if not x.isalnum() and x.isascii() else x for x in query)
    return F.regexp_replace(c, f"(?iu)({quoted})", "<mark>$1</mark>")


def is_refusal(c: Column) -> Column:
    t = F.lower(trimmed(c))
    return reduce(lambda a, b: a | b, [t.startswith(p) for p in REFUSAL_PREFIXES])


def json_body(c: Column) -> Column:
    """From the first brace to the last."""
    return F.regexp_extract(c, "(?s)\\{.*\\}", 0)


def title_case_id(c: Column) -> Column:
    """snake_case to Title Case; the rest of each word stays as it is."""
    return F.array_join(F.transform(F.split(c, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def date_label(day: Column, today: Column) -> Column:
    n = F.datediff(today, day)
    return F.when(n == 0, "today").when(n == 1, "yesterday").when(n.between(2, 3), F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "EEEE"))


def unescape_html(c: Column) -> Column:
    """The named entities that text processors write, the ampersand last, so that nothing is unescaped twice."""
    return _replaced(c, (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#34;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")))


def without_deletions(xml: Column) -> Column:
    """Without tracked deletions."""
    return F.regexp_replace(xml, "(?s)<w:del\\b[^>]*>.*?</w:del>", "")


def word_fields(c: Column) -> Column:
    """Picture and link fields of Word as markdown; what trails them is dropped."""
    c = F.regexp_replace(c, "(?i)INCLUDEPICTURE\\s+\"([^\"]+)\"", "\n\n![]($1)\n\n")
    c = F.regexp_replace(c, "(?i)HYPERLINK\\s+\"([^\"]+)\"", "\n[$1]($1)\n")
    return F.regexp_replace(c, "(?i)\\s*\\*?\\s*MERGEFORMAT\\w*", "")


def collapsed_lines(c: Column) -> Column:
    """White space of each line collapsed; paragraphs, parted by an empty line, without outer white space; blank ones dropped."""
    lines = F.transform(F.split(c, "\n\n"), lambda p: F.transform(F.split(trimmed(p), "\n"), lambda x: trimmed(F.regexp_replace(x, "(?U)\\s+", " "))))
    return F.array_join(F.filter(F.transform(lines, lambda x: F.array_join(x, "\n")), lambda p: p != ""), "\n\n")


def docx_markdown(xml: Column) -> Column:
    """Plain markdown of a document part: paragraphs by empty lines, tabs and breaks kept, deletions and tags dropped, fields as markdown."""
    c = F.replace(without_deletions(xml), F.lit("</w:p>"), F.lit("\n\n"))
    c = F.regexp_replace(F.regexp_replace(c, "<w:(br|cr) ?/>", "\n"), "<w:tab ?/>", "\t")
    c = unescape_html(trimmed(strip_tags(c)))
    return trimmed(collapsed_lines(word_fields(collapsed_lines(c))))


def converter_cleaned(md: Column) -> Column:
    """Markdown of a converter without images, footnote marks, quote marks of text boxes and tags; at most one empty line in a row."""
    c = F.regexp_replace(md, "(?i)<img\\b[^>]*/?>", "")
    c = F.regexp_replace(F.regexp_replace(c, "(?i)<sup>[^<]*</sup>", ""), "(?m)^> ?", "")
    return F.regexp_replace(F.regexp_replace(c, "</?[a-zA-Z][^>]*>", ""), "\n{3,}", "\n\n")
