"""Line dedup against brute-force edit similarity, whatever the candidates are found by."""

import random

import odd
import pytest
from test_pairs import edits, line_words, union_find

from spectraloom.llm import lines


def rows_of(texts):
    rest = odd.documents()[0][2:]
    return [(i, t, *rest) for i, t in enumerate(texts)]


def near_lines(seed=3):
    """Lines of 5 to 90 words, some of short words only, each with copies at up to an eighth of its words changed, left out or put in."""
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, most)))
    out = []
    for n in (5, 9, 10, 12, 18, 19, 20, 30, 60, 90):
        for most in (3, 9):
            base = [word(most) for _ in range(n)]
            out.append(base)
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.randint(1, max(1, n // 8))):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.randint(0, 1)] = [word(most) for _ in range(rng.randint(0, 1))]
                out.append(copy)
    out += [["same"] * n for n in (9, 10, 30, 33, 34)] + [["x", "y"] * 15, ["x", "y"] * 16]
    rng.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("settings", [lines.Settings(), lines.Settings(pair_bucket=1), lines.Settings(similarity=0.8), lines.Settings(similarity=0.6)])
def test_every_similar_pair_is_joined(spark, settings):
    texts = near_lines()
    words = {i: line_words(t) for i, t in enumerate(texts)}
    find, join = union_find(words)
    for a in words:
        for b in range(a):
            most = max(len(words[a]), len(words[b]))
            if words[a] == words[b] or edits(words[a], words[b]) <= int((1 - settings.similarity) * most + 1e-9):
                join(a, b)
    got = lines.deduplicate(odd.frame(spark, rows_of(texts)), settings).collect()
    assert {r.doc_id for r in got if r.n_removed} == {i for i in words if find(i) != i}


def test_one_changed_word_is_found(spark):
    """60 pairs each of 12, 30 and 60 words, of short and of long words, with one word changed."""
    rng = random.Random(5)
    word = lambda least, most: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(least, most)))
    texts = []
    for n in (12, 30, 60):
        for sizes in ((3, 3), (2, 9)):
            for _ in range(60):
                base = [word(*sizes) for _ in range(n)]
                copy = list(base)
                copy[rng.randrange(n)] = "changed"
                texts += [" ".join(base), " ".join(copy)]
    got = {r.doc_id: r.n_removed for r in lines.deduplicate(odd.frame(spark, rows_of(texts))).collect()}
    assert all(got[i] == i % 2 for i in got)


def test_repeated_and_null_ids_keep_lines_of_their_own(spark):
    rest = odd.documents()[0][2:]
    rows = [(1, "one line that both have\nfirst own line", *rest), (1, "second own line\none line that both have", *rest), (None, "a line without an id\nfirst own line", *rest), (None, None, *rest)]
    got = sorted((r.doc_id or 0, r.text or "", r.n_lines, r.n_removed) for r in lines.deduplicate(odd.frame(spark, rows)).collect())
    assert [g[2:] for g in got if g[0] == 0] == [(0, 0), (2, 0)]
    texts = [t for i, t, _, _ in got if i == 1]
    assert sum("one line that both have" in t for t in texts) == 1 and sum("second own line" in t for t in texts) == 1
    assert not any("first own line" in t for t in texts)
