"""Operators do the whole job: no language, path or long text is left out."""

import inspect
import random
import re
import tracemalloc
import unicodedata

import numpy as np

from parlance.llm import align, defects, langid, refusals


def test_language_of_the_whole_text(spark):
    model = langid.fit([("the house is red and the door is open", "en"), ("la maison est rouge et la porte est ouverte", "fr")] * 3)
    text = "la maison est rouge\nla porte est ouverte\n" + "7" * 80 + "\nla maison"
    assert [model.labels[k] for k in align.languages(model, [text, None])][0] == "fr"
    rows = spark.createDataFrame([("the red house 4711\nthe open door 4712", "la maison rouge 4711\nla porte ouverte 4712\n" + "=" * 90)], "a string, b string")
    got = {x for r in align.confident_pairs(rows, "a", "b", model).collect() for x in r["s"]}
    house = np.array([align.token_hash("house")], np.uint64)
    fr, en = (int(align.source_ids(house, x).view(np.int64)[0]) for x in ("fr", "en"))
    assert fr in got and en not in got


def test_length_programme_is_not_bound_to_a_band():
    # the end lies outside a narrow band
    for m in (17, 40, 400):
        assert len(align.by_length([30], [30] * m)) <= 1
        assert len(align.by_length([30] * m, [30])) <= 1
    rng = random.Random(1)
    for _ in range(60):
        a = [rng.randint(1, 200) for _ in range(rng.randint(1, 60))]
        at = rng.randrange(len(a))
        # a block left out, and others added
        b = [max(1, x + rng.randint(-5, 5)) for x in a[:at] + a[at + rng.randint(0, 40) :]] + [rng.randint(1, 200) for _ in range(rng.randint(0, 30))]
        ratio = sum(b) / max(1, sum(a))
        full, wide = align._banded([x * ratio for x in a], b, len(a) + len(b)), align.by_length(a, b)
        i, j, want = len(a), len(b), []
        while i or j:
            di, dj = align.MOVES[full[1][i][j]]
            want += [(i - 1, j - 1)] if di == dj else []
            i, j = i - di, j - dj
        assert b == [] or [(x, y) for x, y, _ in wide] == ([(0, 0)] if len(a) == len(b) == 1 else want[::-1])


def test_translations_do_not_depend_on_tasks(spark):
    assert align.ITERATIONS >= 4 and inspect.signature(defects.Judge.train).parameters["rounds"].default >= 400
    rng = random.Random(2)
    # each pair of words is faint in any one pair of sentences, many together aren't
    pairs = [(list(range(120)), rng.sample(range(200, 230), 12)) for _ in range(40)]
    df = spark.createDataFrame(pairs, "s array<bigint>, t array<bigint>")
    one, many = align.train(df.coalesce(1), 3), align.train(df.repartition(40), 3)
    assert len(one.t) and one.t.tolist() == many.t.tolist() and one.s.tolist() == many.s.tolist() and np.allclose(one.p, many.p, atol=1e-4)


def test_long_texts_train_the_table():
    src = "\n".join(f"The house number {1000 + k} in Street {k % 7} is red and wide{k % 3}." for k in range(700))
    tgt = "\n".join(f"La maison {1000 + k} de la Rue {k % 7} est rouge et large{k % 3}." for k in range(700))
    pairs = list(align.confident([(src, tgt)]))
    assert len(pairs) > 600 and all(align.token_hash("house") in s and align.token_hash("maison") in t for _, s, t in pairs)


def test_no_translation_is_dropped_from_a_large_table(spark, monkeypatch):
    rng = random.Random(3)
    pairs = spark.createDataFrame([(rng.sample(range(60), 6), rng.sample(range(200, 260), 5)) for _ in range(400)], "s array<bigint>, t array<bigint>")

    def rows(table):
        return {(int(a), int(b)): float(p) for x in (table if isinstance(table, align.Parts) else [table]) for a, b, p in zip(x.s[x.per], x.t, x.p, strict=True)}

    whole = rows(align.train(pairs))
    # 200 entries at once
    monkeypatch.setattr(align, "WORDS", 4)
    found = align.train(pairs)
    got = rows(found)
    assert len(whole) > 400 and got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-4 for k in got)
    assert len(list(found)) > 2 and all(0 < len(x.t) < 400 for x in found)


def test_every_sentence_that_holds_a_part_is_tried():
    # four sentences cover the last one of the source, and only the one that covers it least has room for it
    assert align._likely(np.array([0.7, 0.64, 1.0, 0.9, 0.9, 0.65, 0.2])) == [2, 3, 4, 0, 5]


def test_any_sentence_of_the_prompt_may_be_the_one_rendered():
    model = langid.fit([("the house is red and the door is open", "en"), ("la maison est rouge et la porte est ouverte", "fr")] * 3)
    words = {"house": "maison", "red": "rouge", "door": "porte", "open": "ouverte"}
    hashes = [np.array([align.token_hash(w) for w in own], np.uint64) for own in (words, words.values())]
    judge = defects.Judge(model, refusals.Refusals(["The house is red."]), align.Table(align.source_ids(hashes[0], "fr"), hashes[1], np.ones(4)))
    prompt = "Seven grey ducks swim.\nEight brown foxes run.\nhouse red door open.\nNine white owls wait."
    x = judge.features([(prompt, "maison rouge porte ouverte", "fr")])[0]
    assert x[-1, 28] == 1 and x[-1, 29] == 0


def test_tables_in_parts_judge_and_align_alike(spark, monkeypatch):
    model = langid.fit([("the house is red and the door is open", "en"), ("la maison est rouge et la porte est ouverte", "fr")] * 3)
    declines = refusals.Refusals(["The house is red."])
    rows = spark.createDataFrame([(k, f"The house is red {k}.\nThe door {k} is open.", f"La maison est rouge {k}.\nLa porte {k} est ouverte.", "fr") for k in range(40)], "id int, a string, b string, lang string")
    whole = align.lexicon(rows, "a", "b", model)
    monkeypatch.setattr(align, "WORDS", 0.2)
    parts = align.lexicon(rows, "a", "b", model)
    assert len(whole.t) and isinstance(parts, align.Parts) and len(parts.frames) > 1
    ends = spark.createDataFrame([(k, f"The house is red {k}.\nThe door {k} is open.", (f"La maison est rouge {k}.\nLa porte {k} est ouverte.", f"La maison est rouge {k}.\nLa", None)[k % 3], "fr") for k in range(9)], "id int, a string, b string, lang string")
    sound = [(r["a"], r["b"], r["lang"]) for r in rows.collect()]
    got = [[sorted(tuple(r) for r in align.aligned(ends, "id", "a", "b", model, t, declines).collect()), sorted(tuple(r) for r in defects.defects(ends, "a", "b", "lang", ["id"], defects.Judge(model, declines, t).train(sound)).collect())] for t in (whole, parts)]
    assert got[0] == got[1] and len(got[0][0]) >= 9 and len(got[0][1]) == 9


def test_counts_of_a_part_are_whole_in_little_memory():
    rng = np.random.default_rng(5)
    s, t = rng.integers(0, 40, 30_000).astype(np.uint64), rng.integers(100, 130, 30_000).astype(np.uint64)
    held = ([s[:9_000], s[9_000:]], [t[:9_000], t[9_000:]], [np.ones(9_000), np.ones(21_000)])
    found = align._named(held).to_pylist()
    pairs = {(r["s"], r["t"]): r["n"] for r in found if r["t"] is not None}
    assert held == ([], [], []) and len(pairs) == 40 * 30 and all(n == ((s == a) & (t == b)).sum() for (a, b), n in pairs.items())
    assert {r["s"]: r["n"] for r in found if r["t"] is None} == {a: (s == a).sum() for a in range(40)}
    many = 2_000_000
    held = tuple([rng.integers(0, k, many).astype(np.uint64)] for k in (2_000, 200)) + ([np.ones(many)],)
    tracemalloc.start()
    align._named(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the columns, their keys, an order and a copy in that order
    assert peak < 60 * many, peak / many


def test_places_are_counted_in_less_memory_than_ids():
    rng = np.random.default_rng(6)
    many = 1_000_000
    # the same words stand in the names of two batches
    names = ([np.arange(500, dtype=np.uint64), np.arange(500, dtype=np.uint64)], [np.arange(40, dtype=np.uint64) + 7, np.arange(60, dtype=np.uint64) + 7])
    s, t = rng.integers(0, 1_000, many).astype(np.uint32), rng.integers(0, 100, many).astype(np.uint32)
    ids = [np.concatenate(own)[x] for own, x in zip(names, (s, t), strict=True)]
    held = ([s], [t], [np.ones(many)])
    del s, t
    tracemalloc.start()
    found = align._named(held, names)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * many, peak / many
    assert names == ([], []) and found.sort_by([("s", "ascending"), ("t", "ascending")]).to_pylist() == align._named(tuple([x] for x in (*ids, np.ones(many)))).sort_by([("s", "ascending"), ("t", "ascending")]).to_pylist()


def test_names_without_cells_in_a_part_are_passed_over():
    names = ([np.array([3, 5, 9], np.uint64)], [np.array([20, 21], np.uint64)])
    found = align._named(([np.array([1, 1], np.uint32)], [np.array([0, 0], np.uint32)], [np.ones(2)]), names).to_pylist()
    assert found == [{"s": 5, "t": 20, "n": 2.0}, {"s": 5, "t": None, "n": 2.0}]


def test_candidates_do_not_depend_on_what_is_held(spark, monkeypatch):
    rng = random.Random(4)
    pairs = spark.createDataFrame([(rng.sample(range(60), 6), rng.sample(range(200, 260), 5), 2) for _ in range(400)], "s array<bigint>, t array<bigint>, n bigint").coalesce(1)
    count = lambda: {(r["s"], r["t"]): r["n"] for r in align._candidates(pairs).collect()}
    whole = count()
    table = align.train(pairs)
    # both are passed in the middle of a batch
    monkeypatch.setattr(align, "HELD", 500)
    monkeypatch.setattr(align._cells, "__defaults__", (100,))
    assert count() == whole and len(whole) > 400
    again = align.train(pairs)
    assert again.s.tolist() == table.s.tolist() and again.t.tolist() == table.t.tolist() and np.allclose(again.p, table.p, atol=1e-5)


def test_words_of_many_texts_are_scored_in_parts(monkeypatch):
    model = langid.fit([(" ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(26)), f"l{k}") for k in range(12)])
    texts = [[f"w{chr(97 + k % 12)}{chr(97 + j % 26)}" for j in range(k % 90)] for k in range(6_000)]
    model.scores_words(texts[:100])
    tracemalloc.start()
    found = model.scores_words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words = sum(map(len, texts))
    assert peak < 150 * words, peak / words
    monkeypatch.setattr(langid, "HELD", 7)
    assert np.array_equal(found, model.scores_words(texts)) and not found[0].any()
    assert all(np.allclose(found[k], sum(model.words[w] for w in texts[k])) for k in (1, 89, 4_000))


def test_quick_readings_of_texts_are_those_of_the_patterns():
    rng = random.Random(7)
    signs = ["a", "É", "ß", "İ", "Σ", "σ", "\u0301", "々", "漢", "カ", "・", "한", "ё", "ا", "²", "Ⅷ", "٣", "7", "12", ",345", "1\u202f000", "_", "-", ".", "。", "!", "…", "...", ":", "»", "”", "(", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "𝒳", "𠀀", "😀", "Bank", "the"]
    end, dangling = re.compile(r"[.!?。！？]['\"”’»)\]*_`]*\s*\Z"), re.compile(r"(?:\.\.\.|…|[,;:\[({、，；：-])\s*\Z")
    for _ in range(20_000):
        t = "".join(rng.choices(signs, k=rng.randint(0, 9)))
        assert defects.closes(t) == bool(end.search(t)) and defects.dangles(t) == bool(dangling.search(t))
        assert defects.folded(t) == re.sub(r"[\W_]+", "", unicodedata.normalize("NFC", t).casefold())
        assert langid.words_of(t) == langid.WORD.findall(t.lower())
        assert list(align.lexical_ids(t).items()) == [(align.token_hash(k), w) for k, w in align.lexical(t).items()]
