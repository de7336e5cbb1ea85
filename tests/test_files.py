"""Pieces of markdown, pages, publishing and stream sinks on small cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.operators import batching, markdown, pages, regions
from parlance.sources import office, sinks
from parlance.streaming import folds


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(3, 40))
def test_paragraph_pieces(text, n):
    found = markdown.paragraph_pieces(text, n)
    assert all(0 < len(p) <= n for p in found)
    assert "".join("".join(found).split()) == "".join(text.split())


def test_pieces_by_hand():
    assert markdown.paragraph_pieces("aa\n\nbb\n\ncc", 6) == ["aa\n\nbb", "cc"]
    assert markdown.paragraph_pieces("a\n\nbbbbbbbb\n\nc", 4) == ["a", "bbbb", "bbbb", "c"]
    assert markdown.hard_pieces("  abc def ", 4) == ["abc", "def"]
    assert markdown.screen_pieces(" ") == [] and markdown.screen_pieces("x" * 4_500) == ["x" * 4_500]
    assert markdown.screen_pieces("x" * 3_000 + "\n\n\n" + "y" * 3_000) == ["x" * 3_000, "y" * 3_000]
    long = "word " * 4_000
    found = markdown.screen_pieces(long)
    assert all(len(p) <= 9_000 for p in found) and " ".join(found) == long.strip()


def test_inferred_markdown(spark):
    text = "CHƯƠNG I QUY ĐỊNH CHUNG\n(HÀ TÂY CŨ)\nThis is the body.\n\n\n\n1.1 Scope\n\n• one\n+ two\n\nplain"
    got = spark.createDataFrame([(text,), ("## done",), ("",)], "t string").select(markdown.inferred(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in got] == ["## CHƯƠNG I QUY ĐỊNH CHUNG (HÀ TÂY CŨ)\n\nThis is the body.\n\n### 1.1 Scope\n\n- one\n- two\n\nplain", "## done", ""]


def test_batch_numbers_of_nothing(spark):
    df = spark.createDataFrame([(1, [3, 3, 0, 9]), (2, []), (3, None)], "id int, s array<int>")
    got = {r["id"]: r["b"] for r in df.select("id", batching.batch_numbers(F.col("s"), 7).alias("b")).collect()}
    assert got == {1: [0, 0, 0, 1], 2: [], 3: None}


def test_pages(spark):
    broken = [("a", '{"pages":[{"index":0,"markdown":"x"},{"index":1,"markdown":" "},{"index":2,"markdown":"y"}]}'), ("b", "{oops"), ("c", None)]
    found = pages.recognised(spark.createDataFrame(broken, "k string, r string"), "k", "r")
    assert sorted((r["k"], r["page_no"]) for r in found.collect()) == [("a", 1), ("a", 2), ("a", 3)]
    assert [tuple(r) for r in pages.first_pages(found, "k", 2).collect()] == [("a", "x")]
    few = spark.createDataFrame([("f", i, 10) for i in range(12)] + [("g", 0, 900)], "k string, i int, n int")
    got = sorted(tuple(r) for r in pages.scan_info(few, "k", [F.col("i")], F.col("n")).collect())
    assert got == [("f", 12, True, 24_000), ("g", 1, False, 900)]


def test_preview(spark):
    md = "# TITLE\n\ntext\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![x](y)"
    found = regions.regions(spark.createDataFrame([(1, md), (2, None)], "id int, t string"), "id", "t")
    assert [tuple(r) for r in pages.preview(found, "id").collect()] == [(1, "## TITLE\n\ntext\n\n[Bảng]")]


def test_publish_switches_as_a_whole(spark, tmp_path):
    place = f"file://{tmp_path}/p"
    one = spark.range(3)
    sinks.publish({"a": one, "b": one}, place)
    with pytest.raises(Exception):
        sinks.publish({"a": spark.range(9), "b": one.select(F.raise_error(F.lit("no")).alias("x"))}, place)
    assert sinks.published(spark, place, "a").count() == 3
    sinks.publish({"a": spark.range(5), "b": one}, place)
    assert sinks.published(spark, place, "a").count() == 5


def test_whole_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    assert [r["text"] for r in sinks.whole_texts(spark, f"file://{tmp_path}").collect()] == ["x\ny"]


def test_upsert_sink_is_idempotent(spark, tmp_path):
    write = folds.upsert_sink(f"file://{tmp_path}/t", "k")
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 0)
    for _ in range(2):
        write(spark.createDataFrame([("a", 2)], "k string, v int"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/t/version=1").collect()) == [("a", 2), ("b", 1)]


def test_office_looks_and_sheets():
    content = office.make_rich_xlsx(["One two", "", "7"], 'A "b"')
    done = office.translated_xlsx(content, {0: "Un <deux>", 2: ""}, {'A "b"': "C"})
    assert [r["text"] for r in office.xlsx_strings(done)] == ["Un <deux>", "", "7"] and office.sheet_names(done) == ["C"]
    assert [r["text"] for r in office.docx_paragraphs(office.make_rich_docx(["a b", " "], "H", "B"))] == ["a b", "B", "H"]


def test_states_of_streams(spark):
    rows = [("a", 1, "chunk"), ("a", 2, "cancel"), ("a", 3, "chunk"), ("b", 1, "usage"), ("c", 1, "chunk"), ("d", 1, "error"), ("d", 2, "chunk"), ("e", 1, "done")]
    e = spark.createDataFrame([(*r, "x", 1) for r in rows], "stream_id string, seq bigint, type string, content string, tokens bigint")
    assert {r["stream_id"]: (r["state"], r["chunks"]) for r in folds.states(e).collect()} == {"a": ("cancelled", 1), "b": ("pending", 0), "c": ("streaming", 1), "d": ("error", 0), "e": ("idle", 0)}
    assert {r["stream_id"]: r["again"] for r in folds.retries(e).collect()} == {"a": False, "b": False, "c": False, "d": True, "e": False}
