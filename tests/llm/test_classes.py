"""Word classes: every training word is clustered, and scores are those of the class model."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from spectraloom.llm import brown


def hashed(spark, words):
    batch = pa.RecordBatch.from_arrays([pa.array([w]) for w in [" ".join(words)]], ["text"])
    return dict(zip(words, next(brown._tokens(batch))[1].view(np.int64).tolist()))


def corpus():
    """Two kinds of frequent words that stand among their own; each rare word once, between two of one kind."""
    rng, texts, kind = random.Random(1), [], {}
    for half, common in enumerate((["aa", "ab", "ac"], ["ba", "bb", "bc"])):
        for i in range(60):
            rare = f"r{half}x{i}"
            kind[rare] = half
            texts.append(" ".join([*rng.choices(common, k=5), rare, *rng.choices(common, k=5)]))
        kind |= dict.fromkeys(common, half)
    return texts, kind


@pytest.mark.parametrize("head", [6, 1000])
def test_rare_words_are_clustered(spark, head):
    texts, kind = corpus()
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    table, _ = brown.fit(train, brown.Settings(head=head, clustered=6, contexts=6, classes=2))
    rows = {r.w: r for r in table.collect()}
    of = {w: rows[h].k for w, h in hashed(spark, list(kind)).items()}
    assert len(rows) == len(kind) and {(kind[w], of[w]) for w in kind} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})


@pytest.mark.parametrize("head", [1, 3, 1000])
def test_scores_are_those_of_the_class_model(spark, head):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(14)]
    texts = [" ".join(rng.choices(words, [2**-i for i in range(14)], k=rng.randrange(12))) for _ in range(40)] + ["once twice twice", "twice w0"]
    docs = spark.createDataFrame([*enumerate(texts), (100, "new w0 new new once w1"), (101, None)], "doc_id long, text string").repartition(3)
    train = docs.filter("doc_id < 100")
    s = brown.Settings(head=head, clustered=3, contexts=3, classes=2)
    table, _ = brown.fit(train, s)
    by_hash = {r.w: (r.c, r.k) for r in table.collect()}
    known = {w: by_hash[h] for w, h in hashed(spark, [*words, "once", "twice"]).items() if h in by_hash}
    kinds, moves, size = 4, collections.Counter(), collections.Counter()
    for t in texts:
        seen = [(3,), *(((known[w][1], 2) if known[w][0] == 1 else (known[w][1],)) for w in t.split()), (3,)]
        moves.update((x, y) for a, b in zip(seen, seen[1:]) for x in a for y in b)
    for c, k in known.values():
        size[k] += c
    total = [sum(moves[x, y] for y in range(kinds)) for x in range(kinds)]
    for r in brown.score(docs, train, s).join(docs, "doc_id").collect():
        want, last = 0.0, 3
        for w in [*(r.text or "").split(), None]:
            c, k = (1, 3) if w is None else known.get(w, (0, 2))
            want += math.log10((moves[last, k] + 0.5) / (total[last] + 0.5 * kinds)) + (math.log10(c / size[k]) if w in known else 0)
            last = k
        assert r.score == pytest.approx(want, rel=1e-9)
