"""N-gram Jaccard join with a token-group matrix.

Texts become sets of shingle hashes; equal sets are one node. Nodes that share
a min-hash are compared in blocks that have one leader in common, which ties
most copies together. What may still link different components is found with
the matrix: nodes are partitioned into groups by the most common token that
they share with others, and the matrix holds for each token the groups whose
token union has it (tokens of the sets' prefixes, rare ones first). A node's
overlap with a group's union bounds its overlap with any member; only groups
that reach the bound are opened, and their members compared on whole sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import components, mix, release, shingles, steps, stored, text_buffer, tidied, word_hashes


@dataclass(frozen=True)
class Settings:
    """width, num / den: shingle length, least similarity.

    overlap: prefix tokens that a pair must share (prefixes are as much
    longer). leaders: min-hashes. block_nodes, block_tokens: nodes and tokens
    of a group on average, at most. counter_bits: tokens are counted in so many
    hashed counters (2**bits) for the prefix order, which any counts leave exact.
    """

    width: int = 5
    num: int = 75
    den: int = 100
    overlap: int = 3
    leaders: int = 3
    block_nodes: int = 1024
    block_tokens: int = 1 << 19
    counter_bits: int = 20


def _sets(batch: pa.RecordBatch, column: str, width: int):
    """The shingle set of each row's text."""
    raw, offsets = text_buffer(batch.column(column))
    for a, z in steps(offsets):
        h, at = word_hashes(raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
        for i in range(z - a):
            yield shingles(h[at[i] : at[i + 1]], width)


_CHUNK = 4096


def token_counts(docs: DataFrame, s: Settings) -> np.ndarray:
    """Hashed counters of the tokens of all texts, a table of fixed size."""
    size = 1 << s.counter_bits
    shift = np.uint64(64 - s.counter_bits)

    @tidied
    def add(batches):
        total = np.zeros(size, np.int32)
        for b in batches:
            tokens = np.concatenate([np.zeros(0, np.uint64), *_sets(b, "text", s.width)])
            total += np.bincount((tokens >> shift).astype(np.int64), minlength=size).astype(np.int32)
        if total.any():
            lists = pa.FixedSizeListArray.from_arrays(pa.array(total), _CHUNK).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size // _CHUNK)), lists], ["chunk", "n"])

    @tidied
    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, n in zip(b.column("chunk").to_pylist(), b.column("n"), strict=True):
                n = n.values.to_numpy().astype(np.int64)
                sums[chunk] = sums[chunk] + n if chunk in sums else n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["chunk", "n"])

    parts = docs.select("text").mapInArrow(add, "chunk long, n array<int>").repartition("chunk").mapInArrow(merge, "chunk long, n array<long>")
    out = np.zeros(size, np.int64)
    for chunk, n in parts.collect():
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = n
    return out


def signatures(docs: DataFrame, counts: np.ndarray, s: Settings) -> DataFrame:
    """doc_id, n, f1, f2, mins array<long>, prefix array<long> of every text."""
    excess = max(0, int(counts.max(initial=0)).bit_length() - 23)
    sent = docs.sparkSession.sparkContext.broadcast((counts >> excess).astype(np.uint32))
    shift = np.uint64(64 - s.counter_bits)
    salts = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64) for i in range(s.leaders)]

    def prefix(h: np.ndarray, table: np.ndarray) -> np.ndarray:
        n = len(h)
        size = min(n, n - -(-s.num * n // s.den) + (s.overlap if n >= 4 else 1))
        order = (table[(h >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (mix(h) >> np.uint64(24))
        return h[np.argpartition(order, size - 1)[:size]] if size else h

    @tidied
    def work(batches):
        table = sent.value
        for b in batches:
            n, f1, f2, mins, pre = [], [], [], [], []
            for h in _sets(b, "text", s.width):
                n.append(len(h))
                f1.append(int(h.sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                f2.append(int(np.bitwise_xor.reduce(mix(h)).view(np.int64)) if len(h) else 0)
                mins.append(np.array([mix(h ^ x).min() for x in salts], np.uint64).view(np.int64) if len(h) else np.zeros(0, np.int64))
                pre.append((prefix(h, table) >> np.uint64(16)).view(np.int64))
            many = lambda x: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *x])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), many(mins), many(pre)], ["doc_id", "n", "f1", "f2", "mins", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, n long, f1 long, f2 long, mins array<long>, prefix array<long>")


class _Group:
    """The sets of a group's members as postings, and which members are connected so far."""

    def __init__(self, ids: list[int], labels: list[int], sets: list[np.ndarray], s: Settings):
        self.ids, self.s = np.array(ids), s
        self.sizes = np.array([len(x) for x in sets])
        self.roots = {c: c for c in labels}
        self.labels = labels
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def _root(self, c: int) -> int:
        self.roots.setdefault(c, c)
        while self.roots[c] != c:
            self.roots[c] = c = self.roots[self.roots[c]]
        return c

    def links(self, i: int, label: int, x: np.ndarray) -> list[tuple[int, int]]:
        """Members similar to ``x`` that it was not connected with yet; it is then."""
        if not len(x):
            return []
        a, z = np.searchsorted(self.tokens, x, "left"), np.searchsorted(self.tokens, x, "right")
        on = z > a
        a, many = a[on], (z - a)[on]
        if not len(a):
            return []
        at = np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        hits = np.flatnonzero((self.s.den * common >= self.s.num * (len(x) + self.sizes - common)) & (common > 0))
        out = []
        for j in hits:
            mine, other = self._root(label), self._root(self.labels[j])
            if mine != other:
                self.roots[mine] = other
                out.append((i, int(self.ids[j])))
        return out


def linked(rows: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Verified links (a, b) of groups; ``rows`` (g: group, query: boolean, id, c: component so far).

    The members of a group (query false) are held as postings of their whole
    sets and compared with one another; queries stream by. Only links between
    what is not connected yet are returned, so they connect all that any
    similar pair of a group connects.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    both = rows.hint("merge").join(texts, F.col("id") == F.col("_id")).select("g", "query", "id", "c", "text")
    both = both.repartition("g").sortWithinPartitions("g", "query", "id")

    @tidied
    def work(batches):
        current, held, group = None, [], None

        def close():
            nonlocal group
            if group is None and held:
                group = _Group([i for i, _, _ in held], [c for _, c, _ in held], [x for _, _, x in held], s)
                return [pair for i, c, x in held for pair in group.links(i, c, x)]
            return []

        for batch in batches:
            found = []
            names = zip(*(batch.column(k).to_pylist() for k in ("g", "query", "id", "c")), strict=True)
            for (g, query, i, c), x in zip(names, _sets(batch, "text", s.width), strict=True):
                if g != current:
                    found += close()
                    current, held, group = g, [], None
                if query:
                    found += close()
                    found += group.links(i, c, x) if group is not None else []
                else:
                    held.append((i, c, x))
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in found], pa.int64()), pa.array([v[1] for v in found], pa.int64())], ["a", "b"])
        found = close()
        yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in found], pa.int64()), pa.array([v[1] for v in found], pa.int64())], ["a", "b"])

    return both.mapInArrow(work, "a long, b long")


def _blocks(s: Settings):
    return F.ceil(F.greatest(F.col("c") / s.block_nodes, F.col("tokens") / s.block_tokens))


def join(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of ``docs`` (doc_id, text).

    classes: doc_id, n_shingles, component_id, class_id — component_id is the
    smallest doc_id reachable by links, class_id the smallest with an equal set.
    links: a, b — verified links between class representatives, enough to
    connect every component.

    A null text, or one without words, has an empty set and links with nothing;
    its component is itself, as is that of an empty table's no rows. Texts with
    fewer than ``width`` words are one shingle. Rows that repeat a doc_id keep
    the component of that id. Other columns are not read.
    """
    s = settings
    table = stored(signatures(docs, token_counts(docs, s), s))
    nodes = stored(table.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), *(F.min(F.col("mins")[i]).alias(f"m{i}") for i in range(s.leaders))))

    keyed = nodes.select("id", "n", F.posexplode(F.array(*(f"m{i}" for i in range(s.leaders)))).alias("k", "m"))
    mine = F.xxhash64("id")
    led = keyed.groupBy("k", "m").agg(F.min("id").alias("lead"), F.count("*").alias("c"), F.sum("n").alias("tokens"), F.bit_xor(mine).alias("who")).filter("c > 1").dropDuplicates(["c", "who"])
    led = led.withColumn("blocks", _blocks(s)).select("k", "m", "lead", "blocks")
    place = lambda block: F.xxhash64("k", "m", block.cast("long")).alias("g")
    members = keyed.join(led, ["k", "m"]).filter("blocks = 1 or id <> lead").select(place(F.pmod(mine, "blocks")), "id")
    leads = led.filter("blocks > 1").select("k", "m", F.col("lead").alias("id"), F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"))
    first = stored(members.union(leads.select(place(F.col("block")), "id")).select("g", F.lit(False).alias("query"), "id", F.col("id").alias("c")))
    links = stored(linked(first, docs, s))
    release(docs.sparkSession)

    label = components(links)
    placed = stored(nodes.select("id", "n").join(label.select("id", F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id")))
    tokens = stored(_shared_tokens(table, placed))
    second = stored(_opened(tokens, s))
    links = stored(links.union(linked(second, docs, s)))
    release(docs.sparkSession)

    label = components(links)
    classes = nodes.join(label, "id", "left").select("f1", "f2", "n", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    found = table.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2", "n"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")), links


def _shared_tokens(table: DataFrame, placed: DataFrame) -> DataFrame:
    """token, df, id, c, n: prefix tokens of nodes, but only tokens that nodes of different components have."""
    prefixes = table.select("doc_id", "prefix")
    tokens = placed.hint("merge").join(prefixes, F.col("id") == F.col("doc_id")).select("id", "c", F.explode(F.array_distinct("prefix")).alias("token"))
    every = Window.partitionBy("token")
    shared = tokens.withColumn("lo", F.min("c").over(every)).withColumn("hi", F.max("c").over(every)).withColumn("df", F.count("*").over(every))
    return shared.filter("lo < hi").select("token", "df", "id").join(placed, "id")


def _opened(tokens: DataFrame, s: Settings) -> DataFrame:
    """g, query, id, c: members of the groups that are opened, and the queries that open them."""
    home = tokens.groupBy("id").agg(F.max_by("token", F.struct("df", "token")).alias("h"), F.first("c").alias("c"), F.first("n").alias("n"))
    sizes = home.groupBy("h").agg(F.count("*").alias("c"), F.sum("n").alias("tokens")).select("h", _blocks(s).alias("blocks"))
    home = stored(home.join(sizes, "h").select("id", "c", "n", F.xxhash64("h", F.pmod(F.xxhash64("id"), "blocks")).alias("g")))
    at = tokens.select("token", "id").join(home, "id")
    union = at.groupBy("token", "g").agg(F.min("n").alias("g_lo"), F.max("n").alias("g_hi"), F.min("c").alias("c_lo"), F.max("c").alias("c_hi"))
    queries = at.select("token", "id", "c", "n", F.col("g").alias("own"))
    near = f"n * {s.den} >= g_lo * {s.num} and g_hi * {s.den} >= n * {s.num} and own <= g and (c_lo <> c or c_hi <> c)"
    met = queries.join(union, "token").filter(near).groupBy("id", "c", "n", "own", "g").agg(F.count("*").alias("shared"))
    need = F.when(F.col("n") * s.num >= 4 * s.den, s.overlap).otherwise(1)
    met = stored(met.filter(F.col("shared") >= need))
    asked = met.filter("own <> g").select("g", F.lit(True).alias("query"), "id", "c")
    members = home.join(met.select("g").distinct(), "g", "left_semi").select("g", F.lit(False).alias("query"), "id", "c")
    return asked.union(members)
