import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import batching, glossary, hierarchy, markers, mutate, reading, regions, render
from parlance.operators.ranking import positions
from parlance.operators.versions import current_rows
from parlance.sources import office
from parlance.streaming import folds


def test_current_rows(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "x"), (None, 1, "y"), ("c", 1, None)], "id string, updated_at int, t string")
    assert sorted(map(tuple, current_rows(df, {"t": F.col("t")}).collect())) == [("a", "new"), ("b", "x"), ("c", None)]
    kept = current_rows(df, {"t": F.col("t")}, keep=F.col("t") == "old")
    assert kept.count() == 0  # the latest version isn't of interest


@pytest.mark.parametrize("n", [0, 1, 200])
def test_positions_match_row_number(spark, n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", rng.randrange(20), i, rng.randrange(5)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, id int, w int")
    got = {r["id"]: (r["p"], r["s"]) for r in positions(df, ["g"], [F.col("o"), F.col("id")], "p", total="s").collect()}
    groups = {}
    for g, o, i, w in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(g, []).append((i, w))
    assert got == {i: (k + 1, len(own)) for own in groups.values() for k, (i, _) in enumerate(own)}
    run = {r["id"]: r["p"] for r in positions(df, ["g"], [F.col("o"), F.col("id")], "p", weight=F.col("w")).collect()}
    assert run == {i: sum(w for _, w in own[: k + 1]) for own in groups.values() for k, (i, _) in enumerate(own)}


def brute_roots(parent):
    out = {}
    for n in parent:
        seen, x = [n], n
        while parent.get(x) in parent or parent.get(x) in tops(parent):
            x = parent[x]
            if x in seen:
                out[n] = (min(seen[seen.index(x) :]), -1)
                break
            seen.append(x)
        else:
            out[n] = (x, len(seen) - 1)
    return out


def tops(parent):
    return {p for p in parent.values() if p and p not in parent}


@pytest.mark.parametrize("seed", [0, 1])
def test_hierarchy(spark, seed):
    rng = random.Random(seed)
    n = 60
    parent = {f"n{i:02}": f"n{rng.randrange(max(1, i - 6), i + 1):02}" if i % 7 else None for i in range(1, n)}
    parent |= {"x1": "x2", "x2": "x3", "x3": "x1", "x4": "x1", "self": "self"}
    rows = spark.createDataFrame([(k, v, "clash") for k, v in parent.items()], "id string, parent string, root string")
    edges = {k: v for k, v in parent.items() if v}
    links = hierarchy.links(rows, "id", "parent")
    h = hierarchy.decompose(links)
    got = {r["node"]: (r["root"], r["depth"]) for r in hierarchy.rooted(h).collect()}
    want = brute_roots(edges)
    assert {k: got[k] for k in want} == want
    labels = {r["node"]: r for r in h.labels.collect()}
    up = {k: r["up"] for k, r in labels.items()}
    below = {}
    for k in labels:
        x = up[k]
        while x:
            below.setdefault(x, set()).add(k)
            x = up[x]
    for k, r in labels.items():
        own = {q for q, s in labels.items() if s["root"] == r["root"] and r["first"] < s["first"] < r["first"] + r["size"]}
        assert own == below.get(k, set()) and r["size"] == len(own) + 1
    paths = {r["node"]: r["path"] for r in hierarchy.paths(h.labels).collect()}
    for k in labels:
        chain, x = [k], up[k]
        while x:
            chain.append(x)
            x = up[x]
        assert paths[k] == chain[::-1]
    reach = {(r["node"], r["below"]) for r in hierarchy.descendants(h.labels, h.labels.where("depth = 0")).collect()}
    assert reach == {(k, b) for k, own in below.items() if up[k] is None for b in own}


def test_hierarchy_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, parent string")
    assert hierarchy.rooted(hierarchy.decompose(hierarchy.links(empty, "id", "parent"))).count() == 0
    orphans = spark.createDataFrame([("a", "gone"), ("b", ""), (None, "a")], "id string, parent string")
    assert [tuple(r) for r in hierarchy.rooted(hierarchy.decompose(hierarchy.links(orphans, "id", "parent"))).collect()] == [("a", "a", 0)]


@pytest.mark.parametrize(("sizes", "limit", "want"), [([20, 20, 20], 100, [0, 0, 0]), ([20, 20, 20], 25, [0, 1, 2]), ([20, 20, 20], 45, [0, 0, 1]), ([], 10, []), ([0, 30, 0], 25, [0, 1, 1]), ([60, 5], 25, [0, 1])])
def test_greedy_batches(spark, sizes, limit, want):
    df = spark.createDataFrame([(sizes,)], "s array<int>")
    assert df.select(batching.batch_numbers(F.col("s"), limit).alias("b")).first()["b"] == want


def test_segment_batches(spark):
    def run(rows):
        return spark.createDataFrame([(rows,)], "s array<struct<size: bigint, is_html: boolean>>").select(batching.segment_batch_numbers(F.col("s")).alias("b")).first()["b"]

    assert run([(5, False), (5, True), (5, False)]) == [0, 1, 2]
    assert run([(3000, False), (3000, False)]) == [0, 1]
    assert run([(1, False)] * 31) == [0] * 30 + [1]
    assert run([]) == []


@pytest.mark.parametrize(
    ("raw", "n", "want"),
    [
        ("<<<1>>>\nA\n\n<<<2>>>\nB", 2, ["A", "B"]),
        ("first\n\nsecond", 3, ["first", "second", ""]),
        ("only", 2, ["only", ""]),
        ("<<<1>>>\n[1] item", 1, ["[1] item"]),
        ("<<<2>>>\nB", 3, ["", "B", ""]),
        ("  <<<<<<<1>>>>>>>\nA\nB", 1, ["A\nB"]),
        ("<<<1>>>x\n<<<1>>>y\n<<<9>>>z", 2, ["y", ""]),
        ("", 2, ["", ""]),
    ],
)
def test_marker_decode(spark, raw, n, want):
    df = spark.createDataFrame([(raw, n)], "raw string, n int")
    assert df.select(markers.decoded(F.col("raw"), F.col("n")).alias("o")).first()["o"] == want


def test_markers_round_trip(spark):
    items = ["a\nb", "c", "đ 😀"]
    df = spark.createDataFrame([(items,)], "i array<string>")
    assert df.select(markers.decoded(markers.encoded(F.col("i")), F.size("i")).alias("o")).first()["o"] == items


def test_mutations(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, mutate.insert_or_ignore(base, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, mutate.upsert(base, new.distinct(), ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    nulls = spark.createDataFrame([(1, None)], "k int, v string")
    assert sorted(map(tuple, mutate.update_by_key(base, nulls, "k", ["v"]).collect()), key=str) == [(1, None), (2, "b")]
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, p int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert sorted(map(tuple, mutate.cascade(child, "p", parent, "id").collect()), key=str) == [(1, 1), (3, None)]
    assert sorted(map(tuple, mutate.set_null(child, "p", parent, "id").collect()), key=str) == [(1, 1), (2, None), (3, None)]


def test_paging(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(1, 41)], "id string, display_order bigint")
    first = reading.page_envelope(df).first()
    assert (first["n"], first["next_cursor"], first["has_more"]) == (20, 21, True)
    second = reading.page_envelope(df, before=21).first()
    assert (second["n"], second["next_cursor"], second["has_more"]) == (20, 0, False)
    assert [r["id"] for r in reading.page(df, before=3).collect()] == ["2", "1"]
    empty = reading.page_envelope(df.limit(0)).first()
    assert (empty["n"], empty["next_cursor"], empty["has_more"]) == (0, 0, False)


def test_regions():
    md = ["# Title\nSub", "SCANNED WITH X", "漢字", "TM/UBND", "![a](b)", "| a | b |\n|---|---|\n| 1 | 2 |\nmore", "| Name | : X |\n| Age | : 3 |", "**Note:**", "AFTER TABLE", "line one\nline two"]
    got = [(r["type"], r["content"]) for r in regions.regions_of(md)]
    assert got == [("title", "Title"), ("title", "Sub"), ("figure", None), ("table", None), ("text", "Name : X\nAge : 3"), ("title", "Note:"), ("text", "AFTER TABLE"), ("text", "line one"), ("text", "line two")]
    table = regions.MarkdownTable("| H1 | | H2 |\n|---|---|---|\n| 1 | | 2 |")
    assert table.html() == '<table border="1" style="border-collapse:collapse;width:100%"><thead><tr><th>H1</th><th>H2</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>'
    assert not regions.MarkdownTable("| one row |").is_table


def test_blocks(spark):
    df = spark.createDataFrame([("intro\n# H\nafter\n\n\nlast",), ("",)], "md string")
    assert [r["b"] for r in df.select(regions.blocks(F.col("md")).alias("b")).collect()] == [["intro", "# H\nafter", "last"], []]


def test_render():
    assert render.inline_html("a **b** *c* <d>") == "a <strong>b</strong> <em>c</em> &lt;d&gt;"
    assert render.inline_html("<em>x</em> **y**") == "<em>x</em> **y**"
    assert render.text_html("a<br>b  \n\nc") == "<p>a<br>\nb</p>\n<p>c</p>\n"


def test_glossary_match(spark):
    entries = spark.createDataFrame([("e1", "en", "vi", "x", "legal"), ("e2", "en", "vi", "y", None)], "id string, source_lang string, target_lang string, target string, doc_type string")
    variants = spark.createDataFrame([("e1", "lease"), ("e2", "tax")], "entry_id string, source string")
    terms = spark.createDataFrame([("t1", ["nope", "lease"], "en", "vi", "legal"), ("t2", ["tax"], "en", "vi", None)], "term_id string, sources array<string>, source_lang string, target_lang string, doc_type string")
    assert {r["term_id"]: r["entry_id"] for r in glossary.match_terms(terms, entries, variants).collect()} == {"t1": "e1", "t2": None}
    assert {r["term_id"]: r["entry_id"] for r in glossary.match_terms(terms, entries, variants, null_safe=True).collect()} == {"t1": "e1", "t2": "e2"}


def test_office_round_trip(spark):
    docx = office.make_docx(["Hello & bye", "", "đ 😀"])
    assert [r["text"] for r in office.docx_paragraphs(docx)] == ["Hello & bye", "đ 😀"]
    changed = office.translated_docx(docx, {("word/document.xml", 0): "<Xin chào>"})
    assert [r["text"] for r in office.docx_paragraphs(changed)] == ["<Xin chào>", "đ 😀"]
    xml = b"<w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p>"
    assert office.patched(xml, ["c"]).count(b"<w:t") == 2 and [n[2] for n in office.part_paragraphs(office.patched(xml, ["c"]))[0]] == ["c", ""]
    with pytest.raises(ValueError):
        office.patched(xml, [])
    xlsx = office.make_xlsx(["a<b", "12"])
    assert [(r["text"], r["translatable"]) for r in office.xlsx_strings(xlsx)] == [("a<b", True), ("12", False)]
    assert [r["text"] for r in office.xlsx_strings(office.translated_xlsx(xlsx, {1: "x&y"}))] == ["a<b", "x&y"]
    df = spark.createDataFrame([("p", bytearray(docx))], "path string, content binary")
    assert [r["text"] for r in office.read_docx(df).orderBy("idx").collect()] == ["Hello & bye", "đ 😀"]


def test_folds(spark, tmp_path):
    rows = [("a", 1, "chunk", "he", None), ("a", 2, "chunk", "llo", None), ("a", 3, "usage", None, 7), ("a", 4, "done", None, None), ("b", 1, "chunk", "x", None), ("b", 2, "error", None, None), ("c", 1, "chunk", "abcdefgh", None), ("c", 1, "chunk", "abcdefgh", None)]
    schema = "stream_id string, seq bigint, type string, content string, tokens bigint"
    df = spark.createDataFrame(rows, schema)
    want = {("a", "done", "hello", 7), ("b", "error", "", 0), ("c", "streaming", "abcdefgh", 2)}
    assert set(map(tuple, folds.fold_batch(df).collect())) == want
    df.dropDuplicates().write.parquet(str(tmp_path / "in"))
    stream = folds.fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert set(map(tuple, spark.table("folded").collect())) == want


def test_thinned(spark):
    df = spark.createDataFrame([([1, 3, 6, 10, 11, 100],)], "p array<int>")
    assert df.select(batching.thinned(F.col("p")).alias("o")).first()["o"] == [1, 6, 11, 100]
