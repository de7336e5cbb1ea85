import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.llm import align, chunking, conversations, defects, langid, refusals, tokens
from parlance.llm.sentences import blank, sentences

SAMPLES = [
    ("The manager lost the lease and asked for a new one. The invoice must be paid.", "en"),
    ("We are sorry, but we cannot accept the contract without a stamp.", "en"),
    ("Người quản lý làm mất hợp đồng và xin cấp lại. Hóa đơn phải được trả.", "vi"),
    ("Rất tiếc, chúng tôi không thể nhận hợp đồng khi chưa có dấu.", "vi"),
    ("Le responsable a perdu le bail et en demande un autre. La facture doit être payée.", "fr"),
    ("担当者が契約書を紛失し、再発行を依頼しました。請求書を支払います。", "ja"),
    ("담당자가 계약서를 잃어버려 다시 발급해 달라고 했습니다.", "ko"),
    ("经理丢失了合同，要求补办。发票必须支付。", "zh"),
]


@pytest.fixture(scope="module")
def model():
    return langid.fit(SAMPLES)


def test_sentences():
    assert sentences("A b. C!\nD。E？ --- \nF") == ["A b.", "C!", "D。", "E？", "F"]
    assert sentences("3.5 and x.y") == ["3.5 and x.y"]
    assert sentences(None) == sentences("") == sentences(" \n--") == []


def test_blank(spark):
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "…"), (4, "a"), (5, "7")], "i int, c string")
    assert [r["b"] for r in df.orderBy("i").select(blank(F.col("c")).alias("b")).collect()] == [True, True, True, False, False]


def test_languages(model):
    found = langid.segments(model, ["The invoice must be paid. 请求 经理丢失了合同。 La facture doit être payée.", "Nguoi quan ly lam mat hop dong", "123", None, "", "The lease. X-12. The invoice."])
    assert [s["lang"] for s in found[0]] == ["en", "zh", "fr"]
    assert [s["seg_no"] for s in found[0]] == [0, 1, 2]
    assert [s["lang"] for s in found[1]] == ["vi"]
    assert [s["lang"] for s in found[2]] == [None]
    assert found[3] == found[4] == []
    assert len(found[5]) == 1 and found[5][0]["lang"] == "en" and 0 < found[5][0]["confidence"] <= 1


def test_languages_in_spark(spark, model):
    df = spark.createDataFrame([(1, "经理丢失了合同。", "clash"), (1, "经理丢失了合同。", "clash"), (2, None, None)], "id int, t string, segments string")
    rows = langid.with_segments(df, "t", model, ["id"]).collect()
    assert sorted((r["id"], [s["lang"] for s in r["segments"]]) for r in rows) == [(1, ["zh"]), (1, ["zh"]), (2, [])]
    assert langid.with_segments(df.limit(0), "t", model, ["id"]).count() == 0


def test_model_needs_labels():
    with pytest.raises(ValueError):
        langid.fit([(None, "en"), ("x", None)])
    with pytest.raises(ValueError):
        langid.fit([("x", "en")] * 3, most=2)


def test_heldout_languages():
    train, test = [x for i, x in enumerate(SAMPLES) if i % 2 == 0], SAMPLES
    m = langid.fit(train + SAMPLES)
    assert all(m.labels[row.argmax()] == want for row, (_, want) in zip(m.scores([t for t, _ in test]), test, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!。", max_size=400), st.integers(5, 60))
def test_cuts_round_trip(text, limit):
    overlap = limit // 4
    found = chunking.cuts(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in found) == text
    assert all(e - s <= limit and s <= c < e for s, c, e in found)
    assert all(s == max(0, c - min(overlap, limit - (e - c))) for s, c, e in found)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \t.\n!。\u00a0", max_size=120), st.integers(5, 40))
def test_level_found_is_the_boundary(text, limit):
    """The level at which the programme finds its cuts is the boundary by definition."""
    if len(text) > limit:
        assert chunking.cut(text, limit, limit // 5)[1] == chunking.boundary(text, limit)


@pytest.mark.parametrize("text", ["aa bb. cc dd.\nee ff gg. hh", "aa bb cc dd ee. ff\ngg", "aaaaaaa bb.cc dd. e f g", "a b c d e f g h i j k"])
def test_cuts_are_best(text):
    """Against every set of cuts of a short text at any position but inside words, of which none is too long."""
    from itertools import combinations

    limit, overlap = 12, 2
    at, kind = chunking.candidates(text, limit, overlap)
    levels = {i: 2 for i in range(1, len(text)) if text[i].isspace() or text[i - 1].isspace()} | dict(zip(at.tolist(), kind.tolist(), strict=True))
    target = len(text) / np.ceil(len(text) / (limit - overlap))
    cost = chunking.penalties(target, limit)

    def value(points):
        edges = [0, *points, len(text)]
        total = sum(cost[levels[p]] for p in points)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > limit:
                return np.inf
            total += chunking.BALANCE * ((b - a - target) / target) ** 2 + (max(0, b - a + overlap - limit) / overlap if a else 0)
        return total

    best = min(value(p) for k in range(6) for p in combinations(sorted(levels), k))
    assert value([c for _, c, _ in chunking.cuts(text, limit, overlap)][1:]) == pytest.approx(best)


def test_boundaries():
    assert chunking.boundary("a\nb", 3) == "paragraph"
    assert chunking.boundary("aaa. bbb.", 5) == "sentence"
    assert chunking.boundary("aaa bbb ccc", 5) == "word"
    assert chunking.boundary("aaaaaaaaa", 5) == "none"
    assert chunking.boundary("", 5) == "paragraph"
    assert chunking.cuts("x" * 100_000, 2_500, 100)[-1][2] == 100_000


def test_split_in_spark(spark):
    df = spark.createDataFrame([(1, "aa bb\ncc dd ee ff", 9), (2, None, 9), (3, "", 9), (4, "aa", 9)], "id int, t string, piece int")
    rows = chunking.split(df, "t", ["id"], 8, 2).collect()
    assert {r["id"] for r in rows} == {1, 4} and all(len(r["piece"]) <= 8 for r in rows)
    with pytest.raises(ValueError):
        chunking.split(df, "t", ["id"], 8, 8)


def test_conversations(spark):
    rows = [
        ("s1", "a", " User", 1, True), ("s1", "x", "SYSTEM", 2, False), ("s1", "b", "assistant", 5, True),
        ("s2", "c", "user", 1, True),
        ("s3", "d", "assistant", 1, True), ("s3", "e", "user", 2, True),
        ("s4", "f", "user", 1, True), ("s4", "g", "assistant", 2, None),
        ("s5", "h", "user", 1, True), ("s5", "i", "assistant", 2, True), ("s5", "j", "tool", 3, True),
        ("s6", "k", "user", 1, True), ("s6", "l", None, 2, True),
        (None, "m", "user", 1, True), (None, "n", "assistant", 2, True),
        ("s7", "o", "user", 1, True), ("s7", "p", "assistant", 1, True), ("s8", "q", "system", 1, True),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "channel string, node string, role string, o int, ok boolean, turn_no string")
    got = sorted(map(tuple, conversations.conversations(df, "channel", "node", "role", ["o"], "ok").drop("part").collect()))
    assert got == [("s1", 1, "a", "user"), ("s1", 2, "b", "assistant"), ("s7", 1, "o", "user"), ("s7", 2, "p", "assistant")]
    assert conversations.conversations(df.limit(0), "channel", "node", "role", ["o"], "ok").count() == 0


def test_gaps(spark):
    roles = ["user", "assistant", "user", None, "User ", "assistant", "user", "assistant"]
    rows = [("s", str(i), roles[i], f"2024-01-0{1 + 2 * (i // 4)} 00:00:{i:02}") for i in range(8)]
    rows += [("t", "z", "user", None), ("u", "x", "user", "2024-01-01 00:00:00"), ("u", "y", None, "2024-01-01 00:00:09"), ("u", "w", "user", "2024-01-09 00:00:00")]
    df = spark.createDataFrame(rows, "c string, n string, r string, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("ok", F.lit(True))
    seconds = conversations.calibrated_gap(conversations.gap_histogram(df, "c", "n", "r", ["ts"], "ts"))
    assert 9 < seconds < 86_400
    got = sorted(map(tuple, conversations.conversations(df, "c", "n", "r", ["ts"], "ok", "ts", seconds, infer=True).collect()))
    assert got == [("s", p, k + 1, str(4 * p + k), ("user", "assistant")[k % 2]) for p in range(2) for k in range(4)] + [("u", 0, 1, "x", "user"), ("u", 0, 2, "y", "assistant")]
    assert conversations.conversations(df, "c", "n", "r", ["ts"], "ok", "ts", seconds).where("c = 's' AND part = 0").count() == 0
    assert conversations.calibrated_gap(conversations.gap_histogram(df.limit(1), "c", "n", "r", ["ts"], "ts")) == float("inf")


def test_by_length_band():
    pairs = [(i, j) for i, j, _ in align.by_length([10, 20, 30, 40], [11, 19, 31, 41])]
    assert pairs == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert align.by_length([], [1]) == [] == align.by_length([1], [])


def test_beads_are_those_of_the_band():
    """Side by side as one by one, for texts of all shapes."""
    rng = random.Random(1)
    sizes = [([rng.randint(1, 200) for _ in range(rng.randint(0, 40))], [rng.randint(1, 200) for _ in range(rng.randint(0, 40))]) for _ in range(150)]
    sizes += [([9] * 500, [9] * 500), ([5], [1] * 40), ([7] * 300, [7] * 3)]
    for (a, b), got in zip(sizes, align.beads(sizes), strict=True):
        want = align.by_length(a, b)
        assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in want] or sum(c for *_, c in got) == pytest.approx(sum(c for *_, c in want))


def test_long_texts_train():
    """A text of 500 sentences gives its confident pairs like any other."""
    src = "\n".join(f"The lease {4000 + i} was signed on time." for i in range(500))
    tgt = "\n".join(f"Le bail {4000 + i} a été signé à temps." for i in range(500))
    assert len(list(align.confident([(src, tgt)]))) == 500


def test_very_long_texts_align():
    src = [f"Lease {7000 + i}." for i in range(1_500)]
    tgt = [f"Bail {7000 + i}." for i in range(1_500)]
    assert align.align(src, tgt, "fr", table_of([("lease", "bail")], "fr"))[0] == [(i, i) for i in range(1_500)]


def hashes(words):
    return np.array([align.token_hash(w) for w in words], np.uint64)


def table_of(pairs, lang):
    return align.Table(align.source_ids(hashes([a for a, _ in pairs]), lang), hashes([b for _, b in pairs]), np.ones(len(pairs)))


def test_align_merges_moves_and_gaps():
    words = [("lease", "bail"), ("stamp", "tampon"), ("invoice", "facture"), ("paid", "paye"), ("signed", "signe"), ("thank", "merci"), ("answer", "reponse")]
    table = table_of(words, "fr")
    src = ["Lease signed.", "Stamp 4711 lease.", "Invoice paid.", "Thank answer."]
    assert align.align(src, ["Bail signe.", "Tampon 4711 bail.", "Facture paye.", "Merci reponse."], "fr", table)[0] == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert align.align(src, ["Merci reponse.", "Bail signe.", "Tampon 4711 bail."], "fr", table)[0] == [(0, 1), (1, 2), (3, 0)]
    assert align.align(src, ["Bail signe, facture paye.", "Tampon 4711 bail."], "fr", table)[0] == [(0, 0), (1, 1), (2, 0)]
    assert align.align(src[:1], [], "fr", table)[0] == []


def test_training_finds_translations(spark):
    rng = random.Random(0)
    words = [("lease", "bail"), ("stamp", "tampon"), ("invoice", "facture"), ("house", "maison"), ("tax", "taxe"), ("office", "bureau")]
    rows = []
    for _ in range(120):
        pick = rng.sample(words, 3)
        rows.append(([align.token_hash("fr " + a) - 2**63 for a, _ in pick], [align.token_hash(b) - 2**63 for _, b in rng.sample(pick, 3)]))
    found = align.train(spark.createDataFrame(rows, "s array<bigint>, t array<bigint>"))
    for a, b in words:
        lo, hi = (int(x[0]) for x in found.ranges(np.array([align.token_hash("fr " + a) - 2**63], np.int64).view(np.uint64)))
        best = lo + int(found.p[lo:hi].argmax())
        assert int(found.t[best : best + 1].view(np.int64)[0]) == align.token_hash(b) - 2**63 and found.p[best] > 0.5
    assert len(align.train(spark.createDataFrame([], "s array<bigint>, t array<bigint>")).t) == 0


def test_training_is_that_of_one_process(spark):
    """Rounds over many tasks give the table that a plain programme gives."""
    rng = random.Random(4)
    rows = [(rng.sample(range(20), 4), rng.sample(range(100, 120), 3)) for _ in range(60)]
    found = align.train(spark.createDataFrame(rows, "s array<bigint>, t array<bigint>").repartition(5), iterations=3)
    t: dict = {}
    for k in range(3):
        counts: dict = {}
        for s, own in rows:
            for w in own:
                p = {x: 1.0 if not k else t.get((x, w), 0.0) for x in s}
                for x in s:
                    if p[x]:
                        counts[x, w] = counts.get((x, w), 0) + p[x] / sum(p.values())
        sums: dict = {}
        for (x, _), c in counts.items():
            sums[x] = sums.get(x, 0) + c
        t = {(x, w): c / sums[x] for (x, w), c in counts.items() if sums[x] >= (2 if not k else 0) and c >= align.LEAST * sums[x]}
    got = {(int(found.s[i]), int(w)): float(p) for i, w, p in zip(found.per, found.t, found.p)}
    assert got.keys() == t.keys() and all(got[x] == pytest.approx(t[x], rel=1e-4) for x in t)


#: Refusals that no frame yields, written for this test.
UNSEEN = [
    "I'm afraid I can't translate this letter for you.", "I do not translate documents that contain private data.", "Sorry, but this is content I'm not comfortable translating.",
    "I must respectfully decline to provide this translation.", "This appears to contain confidential information; I can't process it.", "Je regrette, je ne peux pas vous fournir la traduction demandée.",
    "Cette traduction m'est impossible car le contenu est sensible.", "En tant que modèle de langage, je ne traduis pas ce genre de documents.", "Tôi rất tiếc nhưng không thể giúp bạn dịch đoạn văn này.",
    "Nội dung này vi phạm chính sách nên tôi không thể dịch.", "恐れ入りますが、こちらの文章の翻訳は対応いたしかねます。", "私はAIですので、このような機密文書を翻訳することはできません。",
    "죄송합니다. 이 문서의 번역은 해 드릴 수 없습니다.", "저는 AI 모델이라 이런 요청에 응할 수 없습니다.", "抱歉，我不能为您翻译这份合同。", "由于内容涉及隐私，我无法提供译文。", "此类文件我不能协助翻译。",
]


def test_refusals():
    no = refusals.Refusals([t for t, _ in SAMPLES])
    assert sum(no.declines(t) for t in UNSEEN) >= 0.9 * len(UNSEEN)
    assert no.declines("> I AM UNABLE TO PROCESS THIS SORT OF THING.")
    assert not any(no.declines(t) for t, _ in SAMPLES)
    assert not any(no.declines(t) for own in refusals.OTHERWISE.values() for t in own)
    assert no.scores([]) == [] and not no.declines("") and not no.declines("123")


def test_refusals_of_frames_left_out(monkeypatch):
    """Of each third of the frames, left out of the fit, at least nine in ten sentences are found."""
    whole = refusals.FRAMES
    missed = total = 0
    for part in range(3):
        rest = {k: {**v, "core": tuple(c for i, c in enumerate(v["core"]) if i % 3 != part)} for k, v in whole.items()}
        out = {k: {**v, "core": tuple(c for i, c in enumerate(v["core"]) if i % 3 == part)} for k, v in whole.items()}
        monkeypatch.setattr(refusals, "FRAMES", rest)
        no = refusals.Refusals([t for t, _ in SAMPLES])
        monkeypatch.setattr(refusals, "FRAMES", out)
        texts = [t for lang in out for t in refusals.composed(random.Random(part), lang, 60)]
        missed += sum(not no.declines(t) for t in texts)
        total += len(texts)
    assert missed <= 0.1 * total


def test_copies():
    assert defects.is_copy("Pay the lease!", "> **pay THE lease**")
    assert defects.is_copy("Pay the lease", "Translation: Pay the lease")
    assert not defects.is_copy("123", "123")
    assert not defects.is_copy("Pay the lease", "Payez le bail")


def test_judge(model):
    sound = [(f"The manager lost the lease {i}00. The invoice must be paid by {i}77.", f"Le responsable a perdu le bail {i}00. La facture doit être payée avant {i}77.", "fr") for i in range(1, 60)]
    sound += [(f"The manager lost the lease {i}00. The invoice must be paid by {i}77.", f"经理丢失了合同 {i}00，要求补办。发票必须支付 {i}77。", "zh") for i in range(1, 60)]
    random.Random(0).shuffle(sound)
    table = table_of([("invoice", "facture"), ("paid", "payée"), ("lease", "bail"), ("lost", "perdu"), ("manager", "responsable"), ("must", "doit")], "fr")
    judge = defects.Judge(model, refusals.Refusals([t for t, _ in SAMPLES]), table).train(sound)
    prompt, reply, _ = next(x for x in sound if x[2] == "fr")
    got = judge.judge([(prompt, reply, "fr"), (prompt, None, "fr"), (prompt, " …", "fr"), (prompt, "I cannot help with documents of this sort.", "fr"), (prompt, "> " + prompt.upper(), "fr"), (prompt, "经理丢失了合同600，要求补办。发票必须支付677。", "fr"), (prompt, reply[:50], "fr"), (prompt, reply, None), ("600\n700", "600\n700", "fr")])
    assert got == [None, "empty", "empty", "refusal", "copy", "wrong_language", "truncated", None, None]
    assert judge.judge([]) == []


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "id int, t string")
    got = {r["id"]: r["tokens"] for r in tokens.token_counts(df, "t", ["id"]).collect()}
    assert got[2] == got[3] == 0 and got[1] >= 2
