"""Defects of prompt and reply pairs.

A linear-chain conditional random field tags each sentence of a reply as answer, refusal, echo, foreign or unfinished; the
share of the reply that each tag covers, with the definitions of the defects, gives the pair's defect. The field is
trained on a bounded sample of sound pairs and on copies of them that are broken on purpose, so no labels are needed.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parlance.llm.align import Parts, Table, lexical_ids, narrowed, tables, token_set
from parlance.llm.langid import Model, Reading, sentence_languages
from parlance.llm.refusals import DECLINES, FRAMES, OTHERWISE, Refusals, composed
from parlance.llm.sentences import COUNTS, LETTER, nfc, pieces

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Most sound pairs that the field is trained on, and the code points that their texts stay under.
SAMPLE, LENGTH = 600, 3_000
#: Letters and digits that a lead-in before a copy may have.
LEAD_IN = 24
#: Log odds above which a prompt declines something itself.
ASKS = 1.0
#: Weight of the Gaussian prior on the field's parameters.
PRIOR = 0.05
_MARKS = re.compile(r"[\W_]+")
_ASCII_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_STOPS, _CLOSERS = (".", "!", "?", "。", "！", "？"), "'\"”’»)]*_`"
_DANGLING = ("...", "…", *",;:[({、，；：-")
FEATURES = 31
#: Letters and digits below which a last sentence without an end is a fragment that needs no rendering.
FRAGMENT = 12


def folded(text: str) -> str:
    """Letters and digits without case."""
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_MARKS).decode()
    return _MARKS.sub("", nfc(text).casefold())


def closes(text: str) -> bool:
    """It ends with a stop, perhaps in quotes or brackets."""
    return text.rstrip().rstrip(_CLOSERS).endswith(_STOPS)


def dangles(text: str) -> bool:
    """It ends with what something should follow."""
    return text.rstrip().endswith(_DANGLING)


def size(text: str) -> int:
    """Bytes in UTF-8, in which the same content is about as long in every script."""
    return len(text.encode("utf-8", "surrogatepass"))


def is_copy(prompt: str, reply: str) -> bool:
    """The prompt again, apart from case, white space, punctuation, quoting or a short lead-in; never for a prompt without letters."""
    a, b = folded(prompt), folded(reply)
    return bool(a) and b.endswith(a) and len(b) - len(a) <= LEAD_IN and bool(LETTER.search(prompt))


class Rendering:
    """How much of a sentence the sentences of a reply render; the reply is read from its end, and only as far as needed."""

    def __init__(self, reply: list[str], lang: str, table: Table):
        self.reply, self.lang, self.table = reply, lang, table
        self.tokens: dict[int, dict[int, float]] = {}

    def _tokens(self, j: int) -> dict[int, float]:
        if (own := self.tokens.get(j)) is None:
            own = self.tokens[j] = lexical_ids(self.reply[j])
        return own

    def share(self, sentence: str, enough: float) -> float:
        """Share of the tokens that the best sentence of the reply, or two neighbours together, render; any value from
        `enough` on is as good as the best."""
        return self.share_ids(lexical_ids(sentence), enough)

    def share_ids(self, own: dict[int, float], enough: float) -> float:
        """share of a sentence given by its tokens."""
        whole = sum(own.values())
        if not own or not self.reply:
            return 0.0
        hashes = list(own)
        links = list(zip(own.values(), hashes, self.table.rows(hashes, self.lang), strict=True))
        best, after = 0.0, None
        for j in range(len(self.reply) - 1, -1, -1):
            have = self._tokens(j)
            cover = []
            for w, h, row in links:
                if h in have:
                    cover.append(w)
                else:
                    top = 0.0
                    for t in row:
                        if t in have and row[t] > top:
                            top = row[t]
                    cover.append(w * top)
            best = max(best, sum(cover))
            if after is not None:
                best = max(best, sum(map(max, cover, after)))
            if best >= enough * whole:
                break
            after = cover
        return best / whole


def _may_hold(text: str, word: str) -> bool:
    """False only if the word can't be part of the folded text."""
    return "・" in word or (w := word.casefold()) in text or text in w


class Judge:
    """Everything that judging a pair takes; picklable."""

    def __init__(self, model: Model, refusals: Refusals, table: Table | Parts | None):
        self.model, self.refusals, self.table = model, refusals, table
        self.emit, self.move = np.zeros((FEATURES, len(TAGS))), np.zeros((len(TAGS), len(TAGS)))
        self.stretch = np.ones(len(model.labels))

    def apart(self) -> Judge:
        """A copy without the table."""
        out = copy(self)
        out.table = None
        return out

    def features(self, pairs: list[tuple[str, str, str | None]], each: list[Table] | None = None) -> tuple[np.ndarray, list[int], list[int], list[bool], np.ndarray]:
        """(one row of features per counted sentence of all replies, sentences per reply, their lengths, whether they have letters, lengths of the prompts).

        `each` holds every pair's table, if they don't share one.
        """
        labels = self.model.labels
        pairs = [(nfc(p), nfc(r), t) for p, r, t in pairs]
        read = Reading(self.model, [r for _, r, _ in pairs])
        number = {x: k for k, x in enumerate(labels)}
        counts = np.diff(read.starts)
        declined = self.refusals.scores_words(read.words)
        # what the definitions say of a pair, and what its prompt declines itself
        facts = np.zeros((len(pairs), 12))
        echo = np.zeros(len(read.texts), bool)
        langs = np.array(read.labels)
        asking: list[tuple[int, list[str]]] = []
        prompts: list[tuple[list[tuple[int, int]], bool, dict[int, float]]] = []
        sought: dict[int, set[int]] = {}
        for k, (prompt, _, _) in enumerate(pairs):
            asked = _spans(prompt)
            closed = closes(prompt)
            if len(asked) > 1 and not closed and len(folded(prompt[asked[-1][0] :])) < FRAGMENT:
                asked, closed = asked[:-1], True
            final = lexical_ids(prompt[asked[-1][0] : asked[-1][1]]) if asked else {}
            prompts.append((asked, closed, final))
            sought.setdefault(read.whole(k), set()).update(final)
        if not each and self.table is not None:
            # look all of them up at once
            for whole, hashes in sought.items():
                self.table.rows(list(hashes), labels[whole] if whole >= 0 else "")
        for k, (prompt, reply, target) in enumerate(pairs):
            whole = read.whole(k)
            first, last = read.starts[k], read.starts[k + 1]
            langs[first:last][langs[first:last] < 0] = whole
            texts = read.texts[first:last]
            asked, closed, final = prompts[k]
            ends = closes(reply) and not dangles(reply)
            tail, head = 1.0, 0.0
            if asked and texts:
                seen = Rendering(texts, labels[whole] if whole >= 0 else "", each[k] if each else self.table)
                tail = seen.share_ids(final, 0.6)
                if len(asked) > 1 and not closed and ends:
                    # the prompt itself breaks off, the reply doesn't: the last whole sentence will do
                    tail = max(tail, seen.share(prompt[asked[-2][0] : asked[-2][1]], 0.6))
                head = float(tail < 0.4 and any(seen.share(prompt[a:b], 0.5) >= 0.5 for a, b in asked[:-1]))
            long = size(reply.rstrip()) / max(1, size(prompt[: asked[-1][1]] if asked else "")) / (self.stretch[whole] if whole >= 0 else 1.0)
            known = number.get(target, -1)
            done = tail >= 0.6 and (ends or not closed and long >= 0.75) or ends and len(texts) >= len(asked)
            facts[k] = (known, closed, ends, dangles(reply) and not dangles(prompt), tail, head, long, len(asked), done, 0, 0, sum(b - a for a, b in asked))
            own = folded(prompt)
            if own and LETTER.search(prompt):
                words = read.words[first:last]
                if not words or not words[-1] or _may_hold(own, words[-1][-1]):
                    facts[k, 9] = is_copy(prompt, reply)
                if facts[k, 9]:
                    echo[first:last] = True
                else:
                    for i, t in enumerate(texts, first):
                        if not words[i - first] or _may_hold(own, words[i - first][0]):
                            echo[i] = len(e := folded(t)) >= 2 and e in own
            if last > first and declined[first:last].max() > DECLINES:
                asking.append((k, [prompt[a:b] for a, b in asked]))
        for k, best in zip((k for k, _ in asking), self._declining([s for _, s in asking]), strict=True):
            facts[k, 10] = best
        row = np.repeat(np.arange(len(pairs)), counts)
        known, closed, ends, dangling, tail, head, long, n, done, copy, asks = facts[row, :11].T
        closed, ends = closed > 0, ends > 0
        lettered = np.array(read.lettered, bool)
        final = np.zeros(len(row), bool)
        final[np.cumsum(counts)[counts > 0] - 1] = True
        told = (known >= 0) & lettered
        # more than half of the sentences that have letters are in another language
        other = np.bincount(row, weights=told & (langs != known), minlength=len(pairs))
        foreign = 2 * other > np.bincount(row, weights=lettered, minlength=len(pairs))
        more = n <= counts[row]
        declines = declined > DECLINES
        columns = [
            np.ones(len(row), bool), declines, (declined > -2) & ~declines, declines & (asks > 0), declines & (tail >= 0.6), echo, copy > 0,
            told & (langs == known), told & (langs != known), ~told, foreign[row], ~foreign[row] & told & (langs != known),
            final, *(final & c for c in (
                closed & ~ends, dangling > 0, tail < 0.2, (tail >= 0.2) & (tail < 0.4), (tail >= 0.4) & (tail < 0.6), tail >= 0.6, closed & ends, ~closed & ~ends,
                long < 0.5, (long >= 0.5) & (long < 0.7), (long >= 0.7) & (long < 0.85), long >= 0.85, (tail >= 0.6) & (long >= 0.7),
                closed & ends & more, closed & ends & ~more, (tail < 0.4) & (head > 0), (tail < 0.4) & (head == 0), done > 0)),
        ]
        return np.stack(columns, axis=1).astype(float), counts.tolist(), [len(t) for t in read.texts], read.lettered, facts[:, 11]

    def _declining(self, rows: list[list[str]]) -> list[bool]:
        """Whether a sentence of each prompt declines something itself; a translation of it is no refusal."""
        flat = self.refusals.scores([s for r in rows for s in r])
        out, at = [], 0
        for r in rows:
            out.append(max(flat[at : at + len(r)], default=-9.0) > ASKS)
            at += len(r)
        return out

    def _measure(self, sound: list[tuple[str, str, str]]) -> None:
        """How long replies in each language are for their prompts, by the median of the sound pairs."""
        ratios: dict[str, list[float]] = {}
        for p, r, t in sound:
            ratios.setdefault(t, []).append(size(r) / size(p))
        for t, own in ratios.items():
            self.stretch[self.model.labels.index(t)] = float(np.median(own))

    def tags(self, x: np.ndarray, counts: list[int]) -> np.ndarray:
        """Best tags of the sentences of all replies by Viterbi, side by side."""
        scores = x @ self.emit
        counts = np.asarray(counts, dtype=np.int64)
        first = np.cumsum(counts) - counts
        out = np.zeros(len(scores), np.int64)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0]
        if not len(order):
            return out
        best, back = scores[first[order]].copy(), []
        for k in range(1, int(counts[order[0]])):
            live = int(np.searchsorted(-counts[order], -k, side="left"))
            step = best[:live, :, None] + self.move
            back.append(step.argmax(axis=1))
            best[:live] = step.max(axis=1) + scores[first[order[:live]] + k]
        now = best.argmax(axis=1)
        for k in range(len(back), -1, -1):
            live = int(np.searchsorted(-counts[order], -k, side="left"))
            out[first[order[:live]] + k] = now[:live]
            if k:
                now[:live] = back[k - 1][np.arange(live), now[:live]]
        return out

    def judge(self, pairs: list[tuple[str | None, str | None, str | None]], each: list[Table] | None = None) -> list[str | None]:
        """The first defect that holds of each (prompt, reply, target language), or None, by what the tags cover of the reply.

        `each` holds every pair's table, if they don't share one.
        """
        out: list[str | None] = ["empty" if not r or not COUNTS.search(r) else None for _, r, _ in pairs]
        todo = [i for i, x in enumerate(out) if x is None]
        if not todo:
            return out
        x, counts, sizes, lettered, asked = self.features([pairs[i] for i in todo], [each[i] for i in todo] if each else None)
        tags = self.tags(x, counts)
        row = np.repeat(np.arange(len(todo)), counts)
        size, letters = np.array(sizes, float), np.array(lettered, float)

        def half(tag: int, weight: np.ndarray) -> np.ndarray:
            covered = np.bincount(row, weights=weight * (tags == tag), minlength=len(todo))
            return 2 * covered - np.bincount(row, weights=weight, minlength=len(todo))

        repeated = np.bincount(row, weights=size * (tags == ECHO), minlength=len(todo)) >= 0.8 * asked
        refusal, echo, foreign = half(REFUSAL, size), half(ECHO, size), half(FOREIGN, letters)
        last = np.cumsum(counts) - 1
        for k, i in enumerate(todo):
            if refusal[k] >= 0:
                out[i] = "refusal"
            elif echo[k] >= 0 and repeated[k]:
                out[i] = "copy"
            elif foreign[k] > 0:
                out[i] = "wrong_language"
            elif tags[last[k]] == UNFINISHED:
                out[i] = "truncated"
        return out

    def train(self, sound: list[tuple[str, str, str]], seed: int = 0, rounds: int = 400) -> Judge:
        """Fit the field on at most SAMPLE sound pairs (prompt, reply, target language) and on broken copies of them."""
        rng = random.Random(seed)
        pairs: list[tuple[str, str, str | None]] = []
        gold: list[int] = []  # the defect's tag; ANSWER for sound pairs
        tongues = sorted(FRAMES)
        sound = sound[:SAMPLE]
        self._measure(sound)

        def add(prompt: str, reply: str, target: str | None, tag: int) -> None:
            pairs.append((prompt, reply, target))
            gold.append(tag)

        for k, (prompt, reply, target) in enumerate(sound):
            for p, r in ((prompt, reply), (_open(prompt), _open(reply)))[: 1 + k % 2]:
                add(p, r, target, ANSWER)
                if len(r) > 8:
                    add(p, _cut(r, rng), target, UNFINISHED)
            if k % 3 == 0:
                add(_open(prompt), reply, target, ANSWER)
            if len(own := _spans(reply)) > 1 and k % 2:
                # a sentence left out further up is no defect
                a, b = own[rng.randrange(len(own) - 1)]
                add(prompt, reply[:a] + reply[b:], target, ANSWER)
            kind = k % 4
            other = next(((p, r, t) for p, r, t in sound[k + 1 :] + sound[:k] if t != target), None)
            prompt = _open(prompt) if rng.random() < 0.3 else prompt
            tongue = target if target in FRAMES and rng.random() < 0.5 else rng.choice(tongues)
            if kind == 0:
                asked = rng.choice(OTHERWISE[rng.choice(tongues)]) if rng.random() < 0.2 else prompt
                add(asked, " ".join(composed(rng, tongue, rng.choice((1, 1, 2)))), target, REFUSAL)
            elif kind == 1:
                add(prompt, _again(prompt, reply, rng), target, ECHO)
            elif kind == 2 and other:
                add(prompt, other[1] if rng.random() < 0.7 else _cut(other[1], rng), target, FOREIGN)
                # asked for in another language, the same reply is foreign
                add(prompt, reply if rng.random() < 0.8 else _cut(reply, rng), other[2], FOREIGN)
                if len(own := _spans(prompt)) > 1:
                    # some sentences of the prompt are no copy of it
                    a = rng.randrange(1, len(own))
                    add(prompt, prompt[: own[a - 1][1]] if rng.random() < 0.5 else prompt[own[a][0] :], target, FOREIGN)
            elif kind == 3 and target in FRAMES:
                # the translation of a text that declines something is an answer
                asked = " ".join(composed(rng, rng.choice([x for x in tongues if x != target]), 1))
                add(asked, " ".join(composed(rng, target, 1)), target, ANSWER)
        for _ in range(min(60, len(sound))):
            figures = "\n".join(str(rng.randrange(10**5, 10**7)) for _ in range(rng.randint(2, 12)))
            pairs += [(figures, figures, sound[0][2]), (figures, figures[: rng.randint(3, len(figures) - 4)], sound[0][2])]
            gold += [ANSWER, UNFINISHED]
        if not pairs:
            return self
        whole = self.table
        if isinstance(whole, Parts):
            self.table = whole.of({h for p, _, _ in pairs for h in token_set(nfc(p))}, [*self.model.labels, ""])
        x, counts, *_ = self.features(pairs)
        self.table = whole
        tags, at = np.zeros(len(x), int), 0
        for n, g in zip(counts, gold, strict=True):
            if g == UNFINISHED:
                tags[at + n - 1 : at + n] = g
            elif g != ANSWER:
                tags[at : at + n] = g
            at += n
        _fit(self, x, counts, tags, rounds)
        return self


def _open(text: str) -> str:
    """Without the stop at its end."""
    return text.rstrip(" \n.。!！?？")


def _spans(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b in pieces(text) if COUNTS.search(text, a, b)]


def _again(prompt: str, reply: str, rng: random.Random) -> str:
    """The prompt once more, as it is, in other case, quoted, or after a lead-in of the reply's first letters."""
    way = rng.randrange(7)
    lead = reply[: rng.randint(2, 14)].strip()
    return (prompt, prompt.upper(), f'"{prompt}"', "> " + prompt, f"{lead}: {prompt}")[min(way, 4)]


def _cut(reply: str, rng: random.Random) -> str:
    """Cut inside the text, half the time with what broken streams leave behind, at times at a sentence's end."""
    own = _spans(reply)
    if len(own) > 1 and rng.random() < 0.4:
        return reply[: own[rng.randrange(len(own) - 1)][1]]
    at = rng.randint(max(2, len(reply) // 5), len(reply) * 4 // 5) if len(reply) > 12 else len(reply) // 2
    return reply[:at].rstrip() + rng.choice(("", "", "", "...", "…", ",", " ["))


def _fit(judge: Judge, x: np.ndarray, counts: list[int], tags: np.ndarray, rounds: int) -> None:
    """Maximum likelihood with a Gaussian prior by Adam; equal sequences are run once, those of one length side by side."""
    seen: dict[tuple[int, bytes, bytes], int] = {}
    kept: dict[int, list[tuple[int, tuple]]] = {}
    at = 0
    for n in counts:
        if n:
            key = (n, x[at : at + n].astype(bool).tobytes(), tags[at : at + n].tobytes())
            if key not in seen:
                kept.setdefault(n, []).append((at, key))
            seen[key] = seen.get(key, 0) + 1
        at += n
    k = len(TAGS)
    groups = []
    gold_emit, gold_moves = np.zeros_like(judge.emit), np.zeros_like(judge.move)
    for n, own in kept.items():
        at = np.array([a for a, _ in own])[:, None] + np.arange(n)
        f, times = x[at], np.array([seen[key] for _, key in own], float)
        hot = np.eye(k)[tags[at]] * times[:, None, None]
        gold_emit += np.einsum("ntf,ntk->fk", f, hot, optimize=True)
        gold_moves += np.einsum("nti,ntj->ij", hot[:, :-1], np.eye(k)[tags[at]][:, 1:])
        groups.append((n, f, times))
    params = [judge.emit, judge.move]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        emit, moves = np.zeros_like(judge.emit), np.zeros_like(judge.move)
        grow = np.exp(params[1])
        for n, f, times in groups:
            s = f @ params[0]
            top = s.max(axis=2, keepdims=True)
            e = np.exp(s - top)
            # forward and backward sums, scaled at each step
            alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.zeros((len(e), n))
            for t in range(n):
                a = e[:, t] if not t else (alpha[:, t - 1] @ grow) * e[:, t]
                scale[:, t] = a.sum(axis=1)
                alpha[:, t] = a / scale[:, t, None]
            for t in range(n - 2, -1, -1):
                beta[:, t] = ((e[:, t + 1] * beta[:, t + 1]) @ grow.T) / scale[:, t + 1, None]
            marginal = alpha * beta * times[:, None, None]
            emit += f.reshape(-1, f.shape[2]).T @ marginal.reshape(-1, k)
            if n > 1:
                after = e[:, 1:] * beta[:, 1:] / scale[:, 1:, None] * times[:, None, None]
                moves += (alpha[:, :-1].reshape(-1, k).T @ after.reshape(-1, k)) * grow
        grads = [gold_emit - emit - PRIOR * params[0], gold_moves - moves - PRIOR * params[1]]
        for i, g in enumerate(grads):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            params[i] = params[i] + 0.15 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    judge.emit, judge.move = params


def is_sound(model: Model, refusals: Refusals, prompt: str, reply: str, target: str | None) -> bool:
    """Fit for training: both end, the reply is all in the target language, declines nothing and isn't the prompt."""
    if not prompt or not reply or target not in model.labels or not closes(prompt) or not closes(reply) or dangles(reply):
        return False
    whole, row = sentence_languages(model, [nfc(reply)])[0]
    texts = [reply[a:b] for a, b, _, _ in row]
    return bool(row) and all(x in (-1, whole) for _, _, x, _ in row) and model.labels[whole] == target and not is_copy(prompt, reply) and not any(x > DECLINES for x in refusals.scores(texts))


def _spoken(model: Model, texts: list[str | None]) -> list[str]:
    """The language under which Judge.features looks up the words of each reply's prompt."""
    read = Reading(model, [nfc(t or "") for t in texts])
    return [model.labels[x] if (x := read.whole(k)) >= 0 else "" for k in range(len(texts))]


def defects(rows: DataFrame, prompt: str, reply: str, target: str, keep: list[str], judge: Judge) -> DataFrame:
    """`keep` and `defect` of each row; defect is NULL for sound pairs. target holds base codes; NULL is never wrong. Rows need a prompt."""
    schema = T.StructType([rows.schema[k] for k in keep]).add("defect", T.StringType())
    arrow = to_arrow_schema(schema)
    links = []
    if isinstance(judge.table, Parts):
        rows = narrowed(rows.select(*dict.fromkeys([*keep, prompt, reply, target])), prompt, reply, judge.model, judge.table, _spoken)
        judge, links = judge.apart(), ["link_s", "link_t", "link_r"]
    shared = rows.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for big in batches:
            for at in range(0, big.num_rows, 2_000):
                b = big.slice(at, 2_000)
                n = len(keep)
                found = own.judge(list(zip(*(b.column(n + i).to_pylist() for i in range(3)), strict=True)), list(tables(b, n + 3)) if links else None)
                yield pa.RecordBatch.from_arrays([b.column(i).cast(arrow.field(i).type) for i in range(n)] + [pa.array(found, pa.string())], schema=arrow)

    return rows.select(*keep, prompt, reply, target, *links).mapInArrow(run, schema)
