"""The Jaccard join, line dedup and suffix dedup against brute force."""

import hashlib
import re

import odd
import pytest

from spectraloom.llm import jaccard, lines, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def union_find(names):
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    return find, join


@pytest.mark.parametrize("settings", [jaccard.Settings(), jaccard.Settings(block_nodes=3, leaders=1), jaccard.Settings(overlap=1, block_tokens=100, counter_bits=12)])
def test_jaccard_components(spark, settings):
    rows = odd.documents()
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    find, join = union_find(sets)
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                join(a, b)
    classes, links = jaccard.join(odd.frame(spark, rows), settings)
    got = classes.collect()
    assert len(got) == len(rows)
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.component_id == find(r.doc_id) for r in got)
    assert all(100 * len(sets[r.a] & sets[r.b]) >= 75 * len(sets[r.a] | sets[r.b]) for r in links.collect())
    first = {}
    for x in names:
        first.setdefault(frozenset(sets[x]) or x, x)
    assert all(r.class_id == first[frozenset(sets[r.doc_id]) or r.doc_id] for r in got)


def test_jaccard_empty(spark):
    classes, links = jaccard.join(odd.empty(spark))
    assert classes.count() == 0 and links.count() == 0


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def line_words(raw):
    return tuple(w for w in re.split(r"[\W_]+", raw.lower()) if w)


def line_rows():
    rows = odd.documents()
    base = " ".join(f"w{i}" for i in range(120))
    text = "\n".join([base, base.replace("w7 ", "v7 "), base.upper() + "!", "short", "Short.", "x"])
    more = "\n".join([base.replace("w99", "u99"), "other words", base + " tail"])
    return rows + [(900, text, *rows[0][2:]), (901, more, *rows[0][2:]), (902, base, *rows[0][2:])]


@pytest.mark.parametrize("settings", [lines.Settings(), lines.Settings(pair_bucket=1), lines.Settings(similarity=0.95)])
def test_line_groups(spark, settings):
    rows = line_rows()
    docs = odd.frame(spark, rows)
    every = lines.lines(docs, settings).collect()
    text = {r[0]: r[1] for r in rows}
    words = {r.h: line_words(text[r.doc_id].split("\n")[r.line]) for r in every}
    find, join = union_find(words)
    names = sorted(words)
    for i, a in enumerate(names):
        for b in names[:i]:
            k = int((1 - settings.similarity) * max(len(words[a]), len(words[b])) + 1e-9)
            if abs(len(words[a]) - len(words[b])) <= k and edits(words[a], words[b]) <= k:
                join(a, b)
    first = {}
    for r in sorted({(r.doc_id, r.line, r.h) for r in every}):
        first.setdefault(find(r[2]), r[:2])
    gone = {(r.doc_id, r.line) for r in every if first[find(r.h)] != (r.doc_id, r.line)}
    got = lines.deduplicate(docs, settings).collect()
    assert len(got) == len(rows)
    for r in got:
        parts = [] if text[r.doc_id] is None else text[r.doc_id].split("\n")
        keep = [p for i, p in enumerate(parts) if (r.doc_id, i) not in gone]
        assert (r.n_lines, r.n_removed) == (len(parts), len(parts) - len(keep))
        assert r.text == (None if text[r.doc_id] is None else "\n".join(keep))
    assert got[0].key == "k"


def test_near_lines_are_grouped(spark):
    got = {r.doc_id: r for r in lines.deduplicate(odd.frame(spark, line_rows())).collect()}
    assert got[900].text.split("\n")[0].startswith("w0 ") and got[902].text == ""


def test_lines_empty_and_same_columns(spark):
    assert lines.deduplicate(odd.empty(spark)).count() == 0
    done = lines.without_repeated_lines(odd.frame(spark))
    assert done.columns == odd.frame(spark).columns
    assert {"!!! ..."} <= {r.text for r in done.collect()}


def cut(rows, width=50):
    """(kept bytes, removed, spans) by document and text."""
    first: dict = {}
    for i, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: x[0]):
        data = text.encode()
        for p in range(len(data) - width + 1):
            first.setdefault(data[p : p + width], i)
    out = {}
    for i, text in {(r[0], r[1]) for r in rows}:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if first[data[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[i, text] = (kept, sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)))
    return out


@pytest.mark.parametrize("settings", [suffixes.Settings(), suffixes.Settings(shard_bytes=200, merge_bytes=1500), suffixes.Settings(group_stretches=2)])
def test_suffix_dedup(spark, settings):
    rows = [r for r in odd.documents(n=40) if r[1] is None or len(r[1]) < 5000]
    rows += [(700 + i, "ab" * 60 + "é" * i, *rows[0][2:]) for i in range(4)] + [(800, "x" * 49, *rows[0][2:]), (801, "x" * 50, *rows[0][2:]), (802, "x" * 51, *rows[0][2:])]
    want = cut(rows)
    got = suffixes.remove(odd.frame(spark, rows), settings).collect()
    assert len(got) == len(rows)
    by = {i: v for (i, _), v in want.items()}
    for r in got:
        kept, removed, spans = by[r.doc_id]
        assert bytes(r.kept) == kept and len(r.spans) == spans and r.n_bytes == len(kept) + removed


def test_suffix_dedup_empty(spark):
    assert suffixes.remove(odd.empty(spark)).count() == 0


def test_merged_transform_is_sorted():
    texts = [hashlib.sha256(bytes([i % 5])).hexdigest().encode() + bytes([97 + i]) for i in range(12)]
    shards = [suffixes.shard_transform(texts[a : a + 4], 50) for a in (0, 4, 8)]
    z, differs = suffixes.merge(shards, [8, 8, 8], 50)
    seen, order = [0, 0, 0], []
    for s in z:
        t, p, _ = shards[s]
        order.append(texts[4 * s + t[seen[s]]][p[seen[s]] :][:50])
        seen[s] += 1
    assert order == sorted(order)
    assert [a != b for a, b in zip(order[1:], order, strict=False)] == differs[1:].tolist()
