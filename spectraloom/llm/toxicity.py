"""Toxicity by a support vector machine over a gap-weighted subsequence kernel.

A text is a bag of words (a run of single letters counts as a word, too). Two
words are as alike as the subsequences they share, each weighted down by the
letters it spans, so gaps and inserted characters cost little. Nyström
landmarks turn the kernel into features; a linear SVM over them scores words,
and a logistic fit over a text's highest word scores gives its score. Words
are trained as instances of labelled texts: those of a toxic text that score
highest are its evidence, all words of clean texts are counter-evidence.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import hash_sample, tidied

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SPELLED = re.compile(r"(?<!\S)(?:\w[\W_]*\s+){2,}\w(?!\w)")

#: Subsequences of words that one numpy step of the kernel works on (or those of 64 words).
_THREES = 1 << 16


@dataclass(frozen=True)
class Settings:
    """sample_texts: labelled rows of each label to learn from (about; by id hash), whole texts.
    landmarks: of toxic words; half as many of clean ones. decay: weight of a spanned letter.
    longest: letters of a word; a longer one is scored by overlapping windows.
    top: highest word scores that describe a text. cache_words: word scores a
    worker keeps in each of two generations.
    """

    sample_texts: int = 2500
    landmarks: int = 32
    decay: float = 0.6
    longest: int = 20
    top: int = 3
    rounds: int = 4
    cache_words: int = 400_000


def tokens_of(text: str) -> set[str]:
    """Distinct lower-case tokens between spaces; spelled-out words (single letters with spaces) come joined, too."""
    text = text.lower()
    found = set(text.split())
    found.update(re.sub(r"[\W_]+", "", m[0]) for m in _SPELLED.finditer(text))
    return found


def words_in(token: str, longest: int) -> list[str]:
    """The word of a token, without punctuation at its ends; windows of a long one, none of a short one."""
    w = token if token.isalpha() else _EDGE.sub("", token)
    if len(w) <= longest:
        return [w] if len(w) > 2 else []
    return [w[i : i + longest] for i in range(0, len(w) - longest // 2, longest // 2)]


def words_of(text: str, longest: int) -> set[str]:
    return {w for token in tokens_of(text) for w in words_in(token, longest)}


def _codes(words: list[str], width: int) -> np.ndarray:
    """Letters as numbers 1 to 255, 0 behind the end."""
    padded = "".join([w.ljust(width, "\0") for w in words]) if any(len(w) != width for w in words) else "".join(words)
    letters = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)
    return np.where(letters > 0, letters % 255 + 1, 0).astype(np.int64)


class SubsequenceKernel:
    """Gap-weighted kernel of common subsequences of three letters, normalised and squared, against fixed landmarks."""

    def __init__(self, landmarks: list[str], decay: float, longest: int):
        self.landmarks, self.decay, self.longest = landmarks, decay, longest
        codes = _codes(landmarks, max(map(len, landmarks)))
        used = np.unique(codes[codes > 0])
        # A letter's number among those of the landmarks, from 1; the row of three such numbers in the table of weights; 0 for none.
        self._letter = np.zeros(256, np.int32)
        self._letter[used] = np.arange(1, len(used) + 1)
        self._base = len(used) + 1
        (i, j, k), weight = self._threes(codes.shape[1])
        keys = self._keys(self._letter[codes], i, j, k)
        mark, at = np.nonzero((codes[:, i] > 0) & (codes[:, j] > 0) & (codes[:, k] > 0))
        found, row = np.unique(keys[mark, at], return_inverse=True)
        self._row = np.zeros(self._base**3, np.int32)
        self._row[found] = np.arange(1, len(found) + 1)
        table = np.zeros((len(found) + 1, len(landmarks)))
        np.add.at(table, (row + 1, mark), weight[at])
        self._table = table.astype(np.float32)
        self._norm = np.sqrt(self.own(landmarks))

    def own(self, words: list[str]) -> np.ndarray:
        """Kernel of each word with itself."""
        t = np.ascontiguousarray(_codes(words, max(map(len, words))).T)
        width = len(t)
        steps = np.arange(width)[:, None] - np.arange(width)[None, :]
        carry = np.where(steps >= 0, float(self.decay) ** np.maximum(steps, 0), 0)
        one, two, three = np.zeros(t.shape), np.zeros(t.shape), np.zeros(t.shape[1])
        for i in range(width):
            m = ((t == t[i]) & (t[i] > 0)) * self.decay**2
            three += (m[1:] * two[:-1]).sum(0)
            inc = np.zeros(t.shape)
            inc[1:] = m[1:] * one[:-1]
            two = self.decay * two + carry @ inc
            one = self.decay * one + carry @ m
        return np.maximum(three, 1e-12)

    def __call__(self, words: list[str]) -> np.ndarray:
        """(words, landmarks) of kernel values in 0 to 1."""
        out = np.zeros((len(words), len(self.landmarks)))
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            same = np.flatnonzero(lengths == n)
            for a in range(0, len(same), step := max(64, _THREES // max(1, math.comb(int(n), 3)))):
                part = same[a : a + step]
                out[part] = self._of_length([words[i] for i in part], int(n))
        like = out / self._norm[None]
        return like * like

    def _threes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of three letters of a word of n, in order, and the weights of what they span."""
        places = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3).T
        return places, (float(self.decay) ** (places[2] - places[0] + 1)).astype(np.float32)

    def _keys(self, letters: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (letters[:, i] * self._base + letters[:, j]) * self._base + letters[:, k]

    def _of_length(self, words: list[str], n: int) -> np.ndarray:
        """Values of words of n letters, by their subsequences that a landmark has; not yet divided by the landmarks' norms."""
        t = _codes(words, n)
        (i, j, k), weight = self._threes(n)
        row = self._row[self._keys(self._letter[t], i, j, k)].ravel()
        hit = np.flatnonzero(row)
        three = np.zeros((len(words), len(self.landmarks)), np.float32)
        if len(hit):
            word = hit // len(weight)
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            three[word[begin]] = np.add.reduceat(self._table[row[hit]] * weight[hit % len(weight), None], begin)
        return three / np.sqrt(self.own(words))[:, None]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(30):
        gap = 1 - y * (x @ w)
        on = gap > 0
        h = reg + 2 * c * (x[on] * weight[on, None]).T @ x[on]
        new = np.linalg.solve(h, 2 * c * (x[on] * (weight[on] * y[on])[:, None]).sum(0))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w = w + step
        if abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Word weights over the landmarks, and the fit over the ``top`` word scores; without landmarks every score is ``prior``."""

    def __init__(self, settings: Settings, prior: float, landmarks: list[str] = (), alpha: np.ndarray | None = None, bias: float = 0.0, fit: np.ndarray | None = None):
        self.settings, self.prior, self.landmarks, self.alpha, self.bias, self.fit = settings, prior, list(landmarks), alpha, bias, fit
        self._kernel = SubsequenceKernel(self.landmarks, settings.decay, settings.longest) if self.landmarks else None
        self._young: dict[str, float] = {}
        self._old: dict[str, float] = {}

    def __getstate__(self):
        return self.settings, self.prior, self.landmarks, self.alpha, self.bias, self.fit

    def __setstate__(self, state):
        self.__init__(*state)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words by the kernel, every word's against every landmark; -2 at least."""
        out = np.empty(len(words))
        for a in range(0, len(words), 8192):
            out[a : a + 8192] = np.maximum(self._kernel(words[a : a + 8192]) @ self.alpha + self.bias, -2.0)
        return out

    def _learn(self, tokens: set[str]) -> None:
        """Scores of tokens (the highest of their words, at least -2) into the cache."""
        parts = {}
        for t in tokens:
            if (known := self._old.get(t)) is not None:
                self._young[t] = known
            else:
                parts[t] = words_in(t, self.settings.longest)
        fresh = sorted({w for p in parts.values() for w in p} - self._young.keys())
        if fresh:
            self._young.update(zip(fresh, self.word_scores(fresh).tolist(), strict=True))
        for t, p in parts.items():
            self._young[t] = max(-2.0, *map(self._young.__getitem__, p)) if p else -2.0

    def features(self, texts: list[str]) -> np.ndarray:
        """The ``top`` highest token scores of each text."""
        bags = list(map(tokens_of, texts))
        self._learn(set().union(*bags) - self._young.keys())
        out = np.full((len(texts), self.settings.top), -2.0)
        for i, bag in enumerate(bags):
            best = heapq.nlargest(self.settings.top, map(self._young.__getitem__, bag))
            out[i, : len(best)] = best
        if len(self._young) > self.settings.cache_words:
            self._old, self._young = self._young, {}
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self._kernel is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.fit[:-1] + self.fit[-1], -30, 30)))


def _parts(word: str) -> set[str]:
    """Runs of four and five letters."""
    return {word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1)}


def train(texts: list[str], toxic: list[int], settings: Settings = Settings()) -> Model:
    """A model of labelled texts; with one label only, that label's share is every score."""
    s, y = settings, np.array(toxic, float)
    prior = float(y.mean()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return Model(s, prior)
    bags = [words_of(t, s.longest) for t in texts]
    in_toxic, in_clean = Counter(), Counter()
    for bag, label in zip(bags, toxic, strict=True):
        (in_toxic if label else in_clean).update(bag)
    n1, n0 = y.sum(), len(y) - y.sum()
    lean = lambda k, c: np.log((k + 0.1) / (n1 + 1)) - np.log((c + 0.5) / (n0 + 1))
    odds = {w: lean(k, in_clean[w]) for w, k in in_toxic.items()}
    part_toxic, part_clean = Counter(), Counter()
    for words, parts in ((in_toxic, part_toxic), (in_clean, part_clean)):
        for w, k in words.items():
            for part in _parts(w):
                parts[part] += k
    worth = lambda o, k: float(o * np.sqrt(k)) if o > 1.5 and k > 1 else 0.0
    by_part = {g: worth(lean(k, part_clean[g]), k) for g, k in part_toxic.items() if k > 1}
    evidence = {w: e for w, k in in_toxic.items() if (e := max(worth(odds[w], k), 0.7 * max((by_part.get(g, 0.0) for g in _parts(w)), default=0.0) if in_clean[w] == 0 else 0.0)) > 0}
    ranked = sorted(evidence, key=lambda w: (-evidence[w], w)) or sorted(odds, key=lambda w: (-odds[w], w))[:50]
    strong = ranked[:600]
    plain = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    rare = sorted((w for w, k in in_clean.items() if k < 5), key=lambda w: hash_of(w))[:2500]
    clean = list(dict.fromkeys(plain[:1500] + rare))
    if not clean:
        return Model(s, prior)

    def spread(words: list[str], worth: dict, k: int) -> list[str]:
        """Greedy choice of words that are worth much and unlike those chosen before."""
        gram = SubsequenceKernel(words, s.decay, s.longest)(words)
        value = np.sqrt(np.array([max(float(worth[w]), 1e-6) for w in words]))
        near, chosen = np.zeros(len(words)), []
        for _ in range(min(k, len(words))):
            chosen.append(int(np.argmax(value * (1.0001 - near))))
            near = np.maximum(near, np.minimum(gram[:, chosen[-1]], 1.0))
        return [words[i] for i in chosen]

    marks = list(dict.fromkeys(spread(strong[:200], evidence | {w: 1.0 for w in strong if w not in evidence}, s.landmarks) + spread(clean[:200], in_clean, s.landmarks // 2)))
    kernel = SubsequenceKernel(marks, s.decay, s.longest)
    gram = np.vstack([kernel(marks[a : a + 256]) for a in range(0, len(marks), 256)]).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T

    def model(w: np.ndarray, fit: np.ndarray) -> Model:
        return Model(s, prior, marks, root @ w[:-1], float(w[-1]), fit)

    def features(words: list[str]) -> np.ndarray:
        return np.vstack([kernel(words[a : a + 256]) for a in range(0, len(words), 256)]).astype(float) @ root

    good = {w: evidence.get(w, 1.0) for w in strong}
    top = {}
    for i in range(s.rounds):
        clean_now = [w for w in clean if w not in good]
        names = list(good) + clean_now
        x = features(names)
        label = np.array([1.0] * len(good) + [-1.0] * len(clean_now))
        weight = np.concatenate([np.sqrt(np.array([min(good[w], 25.0) for w in good])), np.sqrt(np.array([1.0 + min(in_clean[v], 24) for v in clean_now]))])
        w = _svm(x, label, weight, 30.0)
        now = model(w, np.zeros(s.top + 1))
        if i == s.rounds - 1:
            break
        hard = Counter()
        for a in range(0, len(bags), 200):
            now.features(texts[a : a + 200])
        known = now._old | now._young
        for bag, is_toxic in zip(bags, toxic, strict=True):
            best = sorted(bag, key=lambda v: -known.get(v, -9.0))[:4]
            if is_toxic:
                for v in best:
                    if known.get(v, -9.0) > 0 and in_clean[v] == 0:
                        good.setdefault(v, 1.0)
            else:
                hard.update(v for v in best if known.get(v, -9.0) > -0.8 and odds.get(v, 0) < 1.5)
        for v in hard:
            good.pop(v, None)
        clean = list(dict.fromkeys(clean + sorted(hard)[:3000]))
    x = np.vstack([now.features(texts[a : a + 200]) for a in range(0, len(texts), 200)])
    return model(w, _logistic(x, y))


def hash_of(word: str) -> int:
    h = 1469598103934665603
    for b in word.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of the texts of ``docs`` (doc_id, text) with a non-null ``labels.toxic`` (doc_id, toxic).

    The driver gets about ``sample_texts`` rows of each label; of a repeated id
    the least text counts, null texts are left out, and no labelled row at all
    gives the score 0.
    """
    s = settings
    marked = labels.filter("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    chosen = [r for label, rows in marked.groupBy("toxic").count().collect() for r in hash_sample(marked.filter(F.col("toxic") == label), "doc_id", rows, s.sample_texts).collect()]
    by_id = {r.doc_id: r.toxic for r in sorted(chosen)}
    if not by_id:
        return Model(s, 0.0)
    # At most 4 * sample_texts ids.
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in by_id], "id long"))
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id").groupBy("id").agg(F.min("text").alias("text"))
    rows = sorted(rows.collect())
    return train([r.text for r in rows], [by_id[r.id] for r in rows], s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, score, predicted.

    One map over whole texts, no shuffle. A null or empty text has the score of
    a text without words; repeated rows score alike; other columns are not read.
    """

    @tidied
    def work(batches):
        for b in batches:
            out = []
            for a in range(0, b.num_rows, 128):
                out.append(model.scores([t or "" for t in b.column("text").slice(a, 128).to_pylist()]))
            values = np.concatenate([np.zeros(0), *out])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values), pa.array((values >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double, predicted int")
