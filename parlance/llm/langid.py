"""Language of words, sentences and texts by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to the longest known character
n-grams that cover it, from N characters down to one. The model is fitted on labelled samples, of which there are at most
`SAMPLES` (parameter of `fit`); everything else runs over whole texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parlance.llm.sentences import ALPHABET, ASTRAL, COUNTS, LETTER, pieces, unaccented

#: Most labelled rows that a model is fitted on.
SAMPLES = 20_000
#: Longest character n-gram for unseen words.
N = 5
#: Han, kana, then words of all other scripts.
WORD = re.compile(r"[一-鿿々]+|[぀-ヿ]+|[가-힣]+|[^\W\d_々぀-ヿ一-鿿가-힣]+")
#: The same for texts without characters beyond the basic plane, words of letters first.
_BASIC = re.compile(f"[{ALPHABET}]+|[一-鿿々]+|[぀-ヿ]+|[가-힣]+")
#: The same for ASCII in lower case.
_ASCII = re.compile(r"[a-z]+")
#: Remembered words, checked between batches.
CACHE = 400_000
#: Words whose scores are held at once.
HELD = 100_000
#: A sentence whose best language leads by less than this (in nats) says nothing of its own.
LEAD = 0.8


#: Most rows with a language label of uncertain worth that widen the vocabulary, and their lengths in code points.
NOISY, LENGTHS = 4_000, (21, 20_000)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type, width: int | None = None):
        self.data, self.size = np.zeros((1024,) if width is None else (1024, width), kind), 0

    def add(self, value: float | np.ndarray) -> None:
        if self.size == len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.size] = value
        self.size += 1

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.data[at]


class Model:
    """Word and n-gram log frequencies per language. Picklable and of a size bounded by the samples."""

    def __init__(self, labels: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray], unseen: np.ndarray):
        self.labels, self.words, self.grams, self.unseen = labels, words, grams, unseen
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows = Grown(float, len(self.labels))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def backoff(self, word: str) -> np.ndarray:
        """Score of the n-grams that cover the word, the longest known ones first.

        Damped by the root of their number, but for Han runs, which are phrases rather than words.
        """
        w, at, total, n = f"^{word}$", 0, self.unseen.copy(), 1
        while at < len(w):
            for k in range(min(N, len(w) - at), 0, -1):
                if (g := self.grams.get(w[at : at + k])) is not None:
                    total, n, at = total + g * (k / 3), n + 1, at + max(1, k - 1)
                    break
            else:
                at += 1
        return total if "一" <= word[0] <= "鿿" else total / n**0.5

    def row(self, word: str) -> int:
        if (n := self.cache.get(word)) is not None:
            return n
        v = self.words.get(word)
        self.rows.add(self.backoff(word) if v is None else v)
        self.cache[word] = n = self.rows.size - 1
        return n

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row of log scores per text; all zero for a text without words."""
        return self.scores_words([words_of(t) for t in texts])

    def scores_words(self, texts: list[list[str]]) -> np.ndarray:
        """scores of texts given by their words."""
        if len(self.cache) >= CACHE:
            self._forget()
        get, flat, ends = self.cache.get, [], []
        for words in texts:
            ids = list(map(get, words))
            if None in ids:
                ids = [self.row(w) if n is None else n for w, n in zip(words, ids, strict=True)]
            flat.extend(ids)
            ends.append(len(flat))
        out = np.zeros((len(texts), len(self.labels)))
        flat, ends = np.asarray(flat, np.int64), np.asarray(ends, np.int64)
        some = np.flatnonzero(np.diff(ends, prepend=0))
        ends = ends[some]
        starts = np.append(0, ends[:-1])
        a = 0
        while a < len(some):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + HELD, side="right")))
            out[some[a:b]] = np.add.reduceat(self.rows[flat[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], axis=0)
            a = b
        return out


def words_of(text: str) -> list[str]:
    """Words in lower case; runs of Han, kana and Hangul come as one each."""
    text = text.lower()
    return (_ASCII if text.isascii() else WORD if ASTRAL.search(text) else _BASIC).findall(text)


def fit(samples: Iterable[tuple[str | None, str | None]], most: int = SAMPLES) -> Model:
    """Model from (text, language). Rows without text or language are passed over; each text also counts without its accents."""
    counts: dict[str, Counter] = {}
    for n, (text, lang) in enumerate(samples):
        if n >= most:
            raise ValueError(f"more than {most} labelled rows")
        if not text or not lang:
            continue
        c = counts.setdefault(lang, Counter())
        text = unicodedata.normalize("NFC", text)
        c.update(words_of(text))
        if (plain := unaccented(text)) != text and any("a" <= ch <= "z" for ch in plain.lower()):
            for w in words_of(plain):
                c[w] += 0.2
    labels = sorted(counts)
    if not labels:
        raise ValueError("no labelled rows")

    def table(per: list[Counter], alpha: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
        vocabulary = set().union(*per)
        sums = np.array([sum(c.values()) + alpha * len(vocabulary) for c in per])
        rows = {w: np.log((np.array([c[w] for c in per]) + alpha) / sums) for w in vocabulary}
        base = np.log(alpha / sums)
        return {w: v - v.max() for w, v in rows.items()}, base - base.max()

    def grams(c: Counter) -> Counter:
        out: Counter = Counter()
        for w, n in c.items():
            w = f"^{w}$"
            for k in range(1, N + 1):
                for i in range(len(w) - k + 1):
                    out[w[i : i + k]] += n
        return out

    per = [counts[x] for x in labels]
    words, unseen = table(per, 0.1)
    shapes, _ = table([grams(c) for c in per], 0.5)
    return Model(labels, words, shapes, unseen * 0)


def widened(samples: list[tuple[str | None, str | None]], noisy: Iterable[tuple[str | None, str | None]]) -> Model:
    """Model from samples with right labels, and from those sentences of noisy rows for which a first model agrees with the row's label."""
    first = fit(samples)
    more: list[tuple[str, str]] = []
    noisy = [x for x in noisy if x[0] and x[1] in first.labels]
    for (text, lang), (_, row) in zip(noisy, sentence_languages(first, [t for t, _ in noisy]), strict=True):
        more.extend((text[a:b], lang) for a, b, x, _ in row if x < 0 or first.labels[x] == lang)
    return fit([*samples, *more[: SAMPLES * 10]], most=SAMPLES * 11)


class Reading:
    """The counted sentences of many texts, one after the other: `starts` holds the place of each text's first one."""

    def __init__(self, model: Model, texts: list[str | None]):
        self.spans, flat, self.starts = [], [], [0]
        for t in texts:
            own = [(a, b) for a, b in pieces(t) if COUNTS.search(t, a, b)] if t else []
            self.spans += own
            flat.extend(t[a:b] for a, b in own)
            self.starts.append(len(flat))
        self.texts = [s if s.isascii() else unicodedata.normalize("NFC", s) for s in flat]
        self.words = [words_of(s) for s in self.texts]
        self.lettered = [bool(LETTER.search(s)) for s in self.texts]
        scores = self.scores = model.scores_words(self.words)
        best = scores.argmax(axis=1) if len(flat) else np.zeros(0, int)
        top = np.sort(scores, axis=1)
        lead = top[:, -1] - top[:, -2] if scores.shape[1] > 1 else np.ones(len(flat))
        #: label number of each sentence; -1 for one that says nothing of its own: it has no letters, or no language leads clearly
        self.labels = np.where((lead >= LEAD) & np.array(self.lettered, bool), best, -1).tolist()
        self.confidence = (1 / np.exp(scores - top[:, -1:]).sum(axis=1) if len(flat) else np.zeros(0)).tolist()

    def whole(self, k: int) -> int:
        """Label number of a text: of its first sentence that has one, else of all taken together; -1 if no sentence has a letter."""
        a, b = self.starts[k], self.starts[k + 1]
        for x in self.labels[a:b]:
            if x >= 0:
                return x
        return int(self.scores[a:b].sum(axis=0).argmax()) if any(self.lettered[a:b]) else -1


def sentence_languages(model: Model, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, int, float]]]]:
    """Per text the label number of the whole, and its counted sentences as (start, end, label number or -1, confidence)."""
    r = Reading(model, texts)
    out = []
    for k in range(len(texts)):
        a, b = r.starts[k], r.starts[k + 1]
        out.append((r.whole(k), [(*r.spans[i], r.labels[i], r.confidence[i]) for i in range(a, b)]))
    return out


def settled(row: list[tuple[int, int, int, float]], whole: int) -> list[int]:
    """Label of each sentence: those that say nothing take the one before, the first ones the next, all of them `whole`."""
    out = [x[2] for x in row]
    last = next((x for x in out if x >= 0), whole)
    for i, x in enumerate(out):
        last = out[i] = last if x < 0 else x
    return out


def runs(labels: list[int]) -> list[tuple[int, int, int]]:
    """(label, first sentence, sentence after the last) of the longest runs of one label."""
    out: list[tuple[int, int, int]] = []
    for i, x in enumerate(labels):
        if out and out[-1][0] == x:
            out[-1] = (x, out[-1][1], i + 1)
        else:
            out.append((x, i, i + 1))
    return out


SEGMENTS = T.ArrayType(T.StructType([T.StructField("seg_no", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))


def segments(model: Model, texts: list[str | None]) -> list[list[dict]]:
    """Per text its longest runs of sentences in one language, with code point positions and the mean confidence of the sentences."""
    out = []
    for whole, row in sentence_languages(model, texts):
        if not row:
            out.append([])
            continue
        labels = settled(row, whole)
        own = []
        for k, (x, a, b) in enumerate(runs(labels)):
            voices = [r[3] for r in row[a:b] if r[2] == x]
            own.append({"seg_no": k, "first": row[a][0], "last": row[b - 1][1], "lang": model.labels[x] if x >= 0 else None, "confidence": float(np.mean(voices)) if voices else 0.0})
        out.append(own)
    return out


def with_segments(df: DataFrame, text: str, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` and `segments` of each row's text, in Arrow batches. NULL, empty and letterless texts have none or a NULL language."""
    schema = T.StructType([df.schema[k] for k in keep]).add("segments", SEGMENTS)
    arrow = to_arrow_schema(schema)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = segments(m, b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(i).cast(arrow.field(i).type) for i in range(len(keep))] + [pa.array(rows, type=arrow.field("segments").type)], schema=arrow)

    return df.select(*keep, F.col(text)).mapInArrow(run, schema)
