import pytest
from pyspark.sql import functions as F

from parlance.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("value", "want"),
    [("Tôi đang ở đây", "vi"), ("Hello world", "auto"), ("The quick brown fox jumps over the lazy dog again.", "en"), ("The quick brown fox jumps over the lazy dog 漢", "auto"), ("ĐÂY", "vi"), ("café résumé", "auto")],
)
def test_language_hint(spark, value, want):
    assert one(spark, value, X.language_hint) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("1. Scope", 2), ("1.1 Scope", 3), ("1.1.1 Scope", 4), ("IV. Scope", 2), ("phần một", 2), ("SCOPE OF THE WORK", 2), ("plain text here", 0), ("1.", 0), ("", 0)],
)
def test_heading_level(spark, value, want):
    assert one(spark, value, X.heading_level) == want


def test_scalars(spark):
    assert one(spark, "  # Title\nbody", X.title_of) == "Title"
    assert one(spark, " \n", X.title_of) == X.DEFAULT_TITLE
    assert one(spark, "a" * 51, X.title_of) == "a" * 50 + "…"
    assert one(spark, " x\n", X.trimmed) == "x"
    assert one(spark, "<a & 'b'>", X.escape_html) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, "&amp;lt;", X.unescape_xml) == "<"
    assert one(spark, "snake_case_id", X.title_case_id) == "Snake Case Id"
    assert one(spark, "• item", X.bullet) == "- item"
    assert one(spark, "", X.token_estimate) == 0
    assert one(spark, "ab", X.token_estimate) == 1
    assert one(spark, "📎 lease.pdf", X.attachment_name) == "lease.pdf"
    assert one(spark, 1536, X.file_size_label, "bigint") == "1.5 KB"
    assert one(spark, "x {\"a\": 1} y", X.json_body) == '{"a": 1}'
    assert one(spark, "I'm sorry, but I cannot do it", X.is_refusal) is True
    assert one(spark, "Well, I'm sorry, but I cannot", X.is_refusal) is False
    assert one(spark, "a **b** c", X.looks_markdown) is True
    assert one(spark, None, X.quote_snippet) is None


def test_search_snippet(spark):
    long = "x" * 100 + "LEASE" + "y" * 100
    assert one(spark, long, lambda c: X.search_snippet(c, "lease")) == "…" + "x" * 40 + "LEASE" + "y" * 60 + "…"
    assert one(spark, "short\ntext", lambda c: X.search_snippet(c, "zzz")) == "short text"


def test_docx_markdown(spark):
    assert one(spark, "<w:p><w:t>A &amp; B</w:t></w:p><w:del x>gone</w:del><w:p>C</w:p>", X.docx_markdown).strip() == "A & B\n\nC"
