import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.llm import mixing, packing, spans


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20), st.sampled_from([40, 64]))
def test_plan_uses_every_item_once(histogram, capacity):
    used = {}
    for content, n in packing.plan(dict(histogram), capacity):
        assert n > 0 and sum(s * k for s, k in content) <= capacity
        for s, k in content:
            used[s] = used.get(s, 0) + n * k
    assert used == histogram


def test_plan_fills_exactly():
    assert packing.plan({6: 2, 4: 2}, 10) == [(((6, 1), (4, 1)), 2)]
    assert packing.plan({5: 1, 3: 1, 2: 1}, 10) == [(((5, 1), (3, 1), (2, 1)), 1)]
    assert packing.plan({4: 1, 3: 2, 2: 3}, 12) == [(((4, 1), (3, 2), (2, 1)), 1), (((2, 2),), 1)]
    boxes = packing.plan({s: 50 for s in range(1, 257)}, 256)
    assert sum(s * 50 for s in range(1, 257)) / (256 * sum(n for _, n in boxes)) > 0.99


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=12), st.integers(1, 30), st.integers(1, 30))
def test_complements_are_found_if_there_are_any(histogram, gap, own):
    """Against every choice of at most three items."""
    from itertools import combinations

    left = np.zeros(64, np.int64)
    for s, n in histogram.items():
        left[s] = n
    left[own] += 1
    items = [s for s, n in histogram.items() for _ in range(n)]
    want = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(items, k))
    found = packing.Sums(left).find(gap, own)
    assert (found is not None) == want
    if found:
        assert sum(found) == gap and all(found.count(s) <= histogram.get(s, 0) for s in found)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, 7 if i < 60 else rng.randrange(0, 90)) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(rows, "id bigint, n int").withColumn("box", F.lit("clash"))
    out = packing.pack(df, "id", "n", 32).collect()
    assert {r["id"] for r in out} == {i for i, _ in rows}
    total, boxes = {}, {}
    for r in out:
        total[r["id"]] = total.get(r["id"], 0) + r["size"]
        if r["box"] is not None:
            boxes[r["box"]] = boxes.get(r["box"], 0) + r["size"]
    assert total == {i: n or 0 for i, n in rows}
    assert max(boxes.values()) <= 32 and sorted(boxes) == list(range(len(boxes)))
    for i, n in rows:
        parts = [r for r in out if r["id"] == i]
        assert len(parts) == (max(1, -(-(n or 0) // 32)))  # divided only if larger than a box
    fill = packing.fill(packing.pack(df, "id", "n", 32), 32).first()
    assert fill["tokens"] == sum(n or 0 for _, n in rows) and fill["filled"] > 0.95
    assert packing.pack(df.limit(0), "id", "n", 32).count() == 0


def test_rates():
    rate, total = mixing.rates({"a": 100.0, "b": 1000.0}, {"a": (0.5, 2), "b": (0.5, 2), "gone": (0.3, 1)})
    assert rate == {"a": 2.0, "b": 0.2} and total == 400.0
    assert mixing.rates({}, {"a": (1.0, 1)}) == ({}, 0.0)


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else "small", rng.randrange(1, 50)) for i in range(900)] + [(5000, None, 10), (5001, "other", 10), (5002, "big", None), (5003, "big", 0)]
    df = spark.createDataFrame(rows, "id bigint, source string, n int").withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.7, 3), ("none", 0.1, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, "id", "source", "n", targets)
    got = out.collect()
    assert got == mixing.mix(df, "id", "source", "n", targets).collect() or sorted(got) == sorted(mixing.mix(df, "id", "source", "n", targets).collect())
    caps = {"big": 1, "small": 3}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in got)
    share = {r["source"]: r for r in mixing.shares(out, "source", "n", targets).collect()}
    assert share["big"]["share"] == pytest.approx(0.3, abs=0.01) and share["small"]["share"] == pytest.approx(0.7, abs=0.01) and share["none"]["tokens"] == 0
    assert mixing.mix(df.limit(0), "id", "source", "n", targets).count() == 0


def brute(docs, k):
    where = {}
    for i, t in docs.items():
        for p in range(len(t or "") - k + 1):
            where.setdefault(t[p : p + k], set()).add(i)
    out = {}
    for i, t in docs.items():
        covered = set()
        for p in range(len(t or "") - k + 1):
            if len(where[t[p : p + k]]) > 1:
                covered.update(range(p, p + k))
        if covered:
            out[i] = len(covered)
    return out


def corpus():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdeđ😀 語") for _ in range(150))
    docs = {i: "".join(rng.choice("abcdeđ😀 語") for _ in range(rng.randrange(0, 400))) for i in range(1, 25)}
    for i in range(1, 12):
        at = rng.randrange(len(docs[i]) + 1)
        docs[i] = docs[i][:at] + passage[rng.randrange(20) :] + docs[i][at:]
    docs[30] = docs[31] = docs[2]
    docs[32] = "x" * 300
    docs[33] = passage * 2  # repeats inside one record
    docs[34] = "unique " * 60
    docs[35], docs[36] = None, ""
    return docs


@pytest.mark.parametrize("bucket", [spans.BUCKET, 0])
def test_spans_against_brute_force(spark, bucket):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs.items()], "id bigint, t string, mini string")
    got = {r["id"]: r["shared"] for r in spans.shared_spans(df, "id", "t", 80, bucket).collect()}
    assert got == brute(docs, 80)


def test_spans_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint, t string")
    assert spans.shared_spans(empty, "id", "t", 80).count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(empty, "id", "t", 10)


def test_window_hashes():
    c = spans.codes_of("abcabcabc")
    h = spans.window_hashes(c, 3, spans._B1)
    assert len(h) == 7 and h[0] == h[3] == h[6] and len(set(h.tolist())) == 3
    assert len(spans.window_hashes(c, 10, spans._B1)) == 0


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr(spans, "SLICE", 1000)
    rng = random.Random(4)
    c = spans.codes_of("".join(rng.choice("abcdef") for _ in range(5000)))
    at, n, mini = spans.super_kmers(c, 100)
    assert at[0] == 0 and np.array_equal(at[1:], (at + n)[:-1]) and at[-1] + n[-1] == 5000 - 100 + 1


def test_by_text_agrees():
    strings, low, high = ["aab" * 40, "baa" * 40], np.array([1, 2]), np.array([1, 2])
    assert spans.shared_windows(strings, low, high, 70) == spans._by_text(strings, low, high, 70)
