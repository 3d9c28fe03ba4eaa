"""Language ID, language model, toxicity, tokenizer, mix and pipeline."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import odd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectraloom.llm import bpe, brown, langid, mixing, queries, toxicity
from spectraloom.llm.common import bucket_of, read

DATA = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(deadline=None, max_examples=300)
@given(st.one_of(st.text(max_size=60), st.text("aeinst 'ßñ日\n12", max_size=60)))
def test_encoding_is_tiktoken(tokenizer, reference, text):
    ids = tokenizer.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert tokenizer.decode(ids) == text.encode()


@settings(deadline=None)
@given(st.text("abcdeinst", min_size=1, max_size=30), st.text("abcdeinst", max_size=8), st.integers(0, 30), st.integers(0, 5))
def test_appends_and_edits(tokenizer, text, more, at, n):
    v, data = tokenizer.vocabulary, text.encode()
    table = bpe.PrefixTable(v, data)
    assert table.append(more.encode()).tokens() == bpe.PrefixTable(v, data + more.encode()).tokens()
    at = min(at, len(table.data))
    want = table.data[:at] + b"xyz" + table.data[at + n :]
    assert table.edit(at, at + n, b"xyz").tokens() == bpe.PrefixTable(v, want).tokens()


def test_digests(spark, reference):
    rows = odd.documents()
    got = bpe.digests(odd.frame(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        ids = reference.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    ids = bpe.encode(odd.frame(spark, rows), PATH, public_tokenizers.PATTERN)
    back = bpe.decode(ids, PATH, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded) == text[r.doc_id].encode() for r in back)
    assert bpe.digests(odd.empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_small_cache_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    t = bpe.Tokenizer(reference._mergeable_ranks, public_tokenizers.PATTERN)
    text = "the cat sat on the mat and the cat ran " * 3
    assert t.digest(text) == t.digest(text) and t.digest(text)[0] == len(reference.encode_ordinary(text))


def test_language_id(spark):
    docs = read(spark, DATA, "documents")
    got = queries.op2_language_id(spark, DATA).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert np.mean([r.accepted for r in held]) > 0.97


def test_language_id_odd_rows(spark):
    rows = odd.documents()
    docs = odd.frame(spark, rows)
    model = langid.fit(docs)
    assert set(model) == {"en", "fr"}
    got = langid.identify(docs, model).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text[r.doc_id] or "")) for r in got)
    assert langid.accepted(docs, model).columns == docs.columns
    assert langid.fit(odd.empty(spark)) == {} and langid.identify(odd.empty(spark), {}).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_base_scores_and_model(spark):
    docs = read(spark, DATA, "documents")
    got = queries.op5_brown_scores(spark, DATA).collect()
    words = {r.doc_id: tokens(r.text) for r in docs.collect()}
    c = collections.Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
    n, below = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for r in got:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / below) for x in w), rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("s", [brown.Settings(), brown.Settings(head=20, clustered=10, contexts=5, classes=3)])
def test_scores_of_odd_rows(spark, s):
    rows = odd.documents()
    docs = odd.frame(spark, rows)
    train = docs.filter(bucket_of("doc_id", 5) != 1)
    got = brown.score(docs, train, s).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    text = {r[0]: r[1] for r in rows}
    assert all(r.n_tokens == len(tokens(text[r.doc_id])) for r in got)
    assert brown.score(odd.empty(spark), odd.empty(spark), s).count() == 0
    alone = brown.score(docs, odd.empty(spark), s).collect()
    assert all(r.base_score == pytest.approx(0.0) and r.n_known == 0 and r.train_tokens == 0 for r in alone)


def test_exchange_finds_two_languages():
    rng = np.random.default_rng(0)
    beside = np.zeros((40, 20), int)
    for w in range(40):
        half = (w % 2) * 10
        beside[w, half : half + 10] = rng.integers(5, 20, 10)
    of = brown.exchange(beside, 2, 10)
    assert len(set(of[::2])) == 1 and len(set(of[1::2])) == 1 and of[0] != of[1]


def test_toxicity_held_out(spark):
    labels = read(spark, DATA, "labels")
    got = queries.op10_toxicity(spark, DATA).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in held if a.toxic for b in held if not b.toxic]
    assert np.mean(pairs) > 0.7


def brute_kernel(a, b, decay):
    """Sum over common 3-letter subsequences of decay to the letters spanned."""
    def spans(w):
        out = collections.Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    out[w[i] + w[j] + w[k]] += decay ** (k - i + 1)
        return out

    x, y = spans(a), spans(b)
    return sum(v * y[u] for u, v in x.items())


def test_kernel_is_brute_force():
    words = ["idiot", "idxiot", "scum", "clown", "abcabc", "aaa"]
    k = toxicity.SubsequenceKernel(["idiot", "clowns", "abc"], 0.6, 20)
    got = k(words)
    for i, w in enumerate(words):
        for j, z in enumerate(k.landmarks):
            own = math.sqrt(brute_kernel(w, w, 0.6) * brute_kernel(z, z, 0.6))
            assert got[i, j] == pytest.approx((brute_kernel(w, z, 0.6) / own) ** 2, abs=1e-5)


def test_toxicity_tolerates_insertions():
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    texts, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["gobbhead", "wumpkin", "zogface"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels, toxicity.Settings(landmarks=8))
    base = " ".join(rng.choice(plain) for _ in range(30))
    clean, direct, gapped = model.scores([base, base + " gobbhead wumpkin zogface", base + " gobb*head wumpk-in zogxface"])
    assert direct > 0.9 > 0.5 > clean and gapped > clean
    again = toxicity.Model(*model.__getstate__())
    assert np.allclose(again.scores([base]), clean)


def test_toxicity_odd_rows(spark):
    rows = odd.documents()
    docs = odd.frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    for m in (toxicity.fit(docs, labels), toxicity.fit(docs, labels.filter("toxic = 1")), toxicity.fit(docs, labels.filter("false"))):
        got = toxicity.score(docs, m).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd.empty(spark), m).count() == 0


def fill(sizes, weights, total, most):
    """Targets by sharing again until none is above its cap."""
    target, left, open_ = {}, total, set(sizes)
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark):
    rows = odd.documents(n=300)
    docs = odd.frame(spark, rows)
    got, spans, plan = mixing.mix(docs)
    got = got.collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or ""))
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(3, 0.001 * want[s]) for s in order)
    again = {(r.row, r.taken) for r in mixing.mix(docs)[0].collect()}
    assert again == {(r.row, r.taken) for r in got}
    ranks = plan.groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in ranks)


def test_mix_blocks_and_reruns(spark):
    docs = odd.frame(spark).coalesce(1)
    one = {(r.doc_id, r.taken) for r in mixing.mix(docs, block_tokens=64)[0].collect()}
    assert one == {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5, "doc_id"), block_tokens=64)[0].collect()}
    assert mixing.mix(odd.empty(spark))[0].count() == 0
    done = mixing.mixed_documents(docs)
    assert done.columns == docs.columns and done.count() > 0


def test_points_are_even(spark):
    x = np.array([r[0] for r in spark.range(5000).select(mixing.point(F.col("id"))).collect()])
    far = spark.range(1).select(mixing.point(F.lit(10**12)), mixing.point(F.lit(10**12 + 1))).first()
    assert ((far[1] - far[0]) % 1) == pytest.approx((math.sqrt(5) - 1) / 2, abs=1e-4)
    assert np.abs(np.histogram(x, 50, (0, 1))[0] - 100).max() <= 3


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = read(spark, DATA, "documents").limit(300)
    kept = docs
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        from spectraloom.llm.common import stored

        kept = stored(stage(spark, kept, DATA))
        assert kept.columns == docs.columns, name
        sizes.append(kept.count())
    assert sizes[0] >= 0.97 * 300 and sizes[0] >= sizes[1] >= sizes[2] > 200
    last = pipeline.STAGES[-1][1](spark, kept, DATA)
    assert last.count() == sizes[-1] and set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "source_mix", "byte_bpe"]
    odd_docs = odd.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        stage(spark, odd_docs, DATA).count()
        stage(spark, odd_docs.filter("false"), DATA).count()
