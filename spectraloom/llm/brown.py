"""Language-model scoring with word classes found by exchange clustering.

A token's probability is that of its class after the class before it, times
that of the token in its class. The most frequent words are exchanged one by
one between classes by the words they stand beside; then every other training
word, however rare, joins the class whose neighbours its own resemble most.
Only words that training texts do not have are a class of their own: one symbol, as
likely as a word that was seen once. Counts come from all training texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import discard, release, steps, stored, text_buffer, tidied, word_hashes

#: The token that ends each text, and stands before its first.
END = np.uint64(0x0E0D0E0D0E0D0E0D)


@dataclass(frozen=True)
class Settings:
    """head: most frequent words that scoring tasks hold in memory; the others' counts and classes are joined.
    clustered, contexts: words that are exchanged one by one, and words beside them that are told apart; all others count as one context.
    classes, rounds: classes of all words, passes of the exchange.
    """

    head: int = 1 << 18
    clustered: int = 4096
    contexts: int = 256
    classes: int = 32
    rounds: int = 6


def _tokens(batch: pa.RecordBatch, column: str = "text"):
    """(first row, token hashes with an END behind each text, first token of each row) of some rows at a time."""
    raw, offsets = text_buffer(batch.column(column))
    for a, z in steps(offsets):
        h, at = word_hashes(raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
        rows = z - a
        ends = at[1:] + np.arange(rows)
        out = np.empty(len(h) + rows, np.uint64)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside], out[ends] = h, END
        yield a, out, at[:-1] + np.arange(rows)


def _place(known: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Index of each token in the sorted ``known``, -1 if it is not there."""
    if not len(known):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, at, -1)


def _before(items: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The item before each; that of END at the start of a text."""
    out = np.empty_like(items)
    out[1:] = items[:-1]
    out[starts] = end
    return out


def word_counts(train: DataFrame) -> DataFrame:
    """w (token hash), c of all tokens of the training texts."""

    @tidied
    def work(batches):
        for b in batches:
            parts = [t for _, t, _ in _tokens(b)]
            w, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "c"])

    return train.select("text").mapInArrow(work, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _pair_counts(train: DataFrame, shape: tuple[int, int], cells) -> np.ndarray:
    """Sum over all training texts of the cells that ``cells(tokens, starts)`` yields, in a table of fixed shape.

    Each task adds up its own dense table and sends its non-zero cells once.
    """
    size = shape[0] * shape[1]

    @tidied
    def work(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for _, tokens, starts in _tokens(b):
                for cell in cells(tokens, starts):
                    total += np.bincount(cell, minlength=size)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 1 << 18):
            part = at[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])

    got = train.select("text").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size, np.int64)
    table[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return table.reshape(shape)


def exchange(beside: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each row of ``beside`` (word by context counts).

    Words start in classes dealt by rank; each in turn moves to the class that
    raises the mutual information of classes and contexts most, until a round
    moves none.
    """
    words = len(beside)
    of = np.arange(words) % classes
    x = beside.astype(float)
    table = np.zeros((classes, x.shape[1]))
    np.add.at(table, of, x)
    xlogx = lambda v: v * np.log(np.maximum(v, 1.0))
    whole, sums = xlogx(table).sum(1), table.sum(1)
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            on = np.flatnonzero(x[w])
            if not len(on):
                continue
            v, old, n = x[w, on], of[w], x[w].sum()
            part = table[:, on]
            inside = xlogx(part).sum(1)
            more = xlogx(part + v).sum(1) - inside - (xlogx(sums + n) - xlogx(sums))
            less = xlogx(part[old] - v).sum() - inside[old] - (xlogx(sums[old] - n) - xlogx(sums[old]))
            more[old] = -less
            new = int(np.argmax(more))
            if new != old and more[new] > more[old] + 1e-9:
                table[old, on] -= v
                table[new, on] += v
                sums[old] -= n
                sums[new] += n
                of[w], moved = new, moved + 1
        if not moved:
            break
    return of


def _most_frequent(words: DataFrame, most: int) -> pa.Table:
    """The words (w, c) above the least count that leaves at most ``most``; found from a histogram of counts, not by a sort.

    Counts from 64 on are told apart by eighths of a power of two.
    """
    level = F.when(F.col("c") < 64, F.col("c")).otherwise(F.floor(F.log2(F.col("c")) * 8) + 64).cast("int")
    left, least = most, 1 << 20
    for step, n in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):
        if n > left:
            break
        left, least = left - n, step
    return words.filter(level >= least).toArrow()


def _sides(core: np.ndarray, of: np.ndarray, classes: int, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``core`` or -1, left * width + right) of each token that is a word.

    A side is the class of the neighbour if that is in ``core`` (sorted, with classes ``of``), ``classes`` for an end, one more for other words.
    """
    width, item = classes + 2, _place(core, tokens)
    side = np.where(item >= 0, of[np.maximum(item, 0)], classes + 1) if len(core) else np.full(len(tokens), classes + 1)
    side[tokens == END] = classes
    left, right, word = _before(side, starts, classes), np.roll(side, -1), tokens != END
    return item[word], (left * width + right)[word]


def neighbours(train: DataFrame, core: np.ndarray, of: np.ndarray, classes: int) -> DataFrame:
    """w, pair, n: how often each word stands between two neighbours; words of ``core`` are summed by class (w) and marked."""
    cells = (classes + 2) ** 2

    @tidied
    def work(batches):
        total = np.zeros(classes * cells, np.int64)
        for b in batches:
            words, pairs = [], []
            for _, tokens, starts in _tokens(b):
                item, pair = _sides(core, of, classes, tokens, starts)
                mine = item >= 0
                total += np.bincount(of[item[mine]] * cells + pair[mine], minlength=len(total))
                words.append(tokens[tokens != END][~mine])
                pairs.append(pair[~mine])
            if not words:
                continue
            w, at = np.unique(np.concatenate(words), return_inverse=True)
            code, n = np.unique(at * cells + np.concatenate(pairs), return_counts=True)
            yield from _rows(w.view(np.int64)[code // cells], code % cells, n, False)
        at = np.flatnonzero(total)
        yield from _rows(at // cells, at % cells, total[at], True)

    return train.select("text").mapInArrow(work, "w long, pair int, n long, core boolean")


def _rows(w: np.ndarray, pair: np.ndarray, n: np.ndarray, core: bool):
    for a in range(0, len(w), 1 << 18):
        z = a + (1 << 18)
        yield pa.RecordBatch.from_arrays([pa.array(w[a:z], pa.int64()), pa.array(pair[a:z].astype(np.int32)), pa.array(n[a:z], pa.int64()), pa.array(np.full(len(w[a:z]), core))], ["w", "pair", "n", "core"])


def assigned(met: DataFrame, classes: int) -> DataFrame:
    """w, c, k of the words outside the core in ``neighbours``: count, and the class in which their neighbours are likeliest."""
    width = classes + 2
    table = np.zeros((classes, width, width))
    for r in met.filter("core").groupBy("w", "pair").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        table[r["w"], r["pair"] // width, r["pair"] % width] = r["n"]
    # Whole numbers, so that sums do not depend on the order of rows.
    sides = [np.rint(np.log((t + 0.5) / (t.sum(1, keepdims=True) + 0.5 * width)).T * (1 << 20)).astype(np.int64) for t in (table.sum(2), table.sum(1))]

    @tidied
    def work(batches):
        open_w, open_c, open_fit = None, 0, np.zeros(classes, np.int64)

        def out(w, c, fit):
            return pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(c, pa.int64()), pa.array(fit.argmax(1).astype(np.int32))], ["w", "c", "k"])

        for b in batches:
            if not b.num_rows:
                continue
            w, pair, n = (b.column(c).to_numpy() for c in ("w", "pair", "n"))
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            c = np.add.reduceat(n, first)
            fit = np.add.reduceat(n[:, None] * (sides[0][pair // width] + sides[1][pair % width]), first)
            if w[0] == open_w:
                c[0] += open_c
                fit[0] += open_fit
            elif open_w is not None:
                yield out([open_w], [open_c], open_fit[None])
            # The last word goes on in the next batch, perhaps.
            yield out(w[first[:-1]], c[:-1], fit[:-1])
            open_w, open_c, open_fit = int(w[-1]), int(c[-1]), fit[-1]
        if open_w is not None:
            yield out([open_w], [open_c], open_fit[None])

    dealt = met.filter("not core").select("w", "pair", "n").repartition("w").sortWithinPartitions("w")
    return dealt.mapInArrow(work, "w long, c long, k int")


def _tail(head: np.ndarray, kind: np.ndarray, tokens: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, ...]:
    """Kinds of the tokens (-1: outside the head), places of those, kinds before and behind them."""
    at = _place(head, tokens)
    k = np.where(at >= 0, kind[np.maximum(at, 0)], -1) if len(head) else np.full(len(tokens), -1)
    k = np.where(tokens == END, end, k).astype(np.int64)
    tail = np.flatnonzero(k < 0)
    return k, tail, _before(k, starts, end)[tail], k[np.minimum(tail + 1, len(k) - 1)]


def _transitions(train: DataFrame, table: DataFrame, head: np.ndarray, kind: np.ndarray, once: np.ndarray, classes: int) -> np.ndarray:
    """How often each kind follows each. A word seen once counts as its class and again as an unknown word.

    Where both tokens are in the head they are counted at once; the others meet their classes first.
    """
    rare, end, kinds = classes, classes + 1, classes + 2
    size = kinds * kinds
    sent = train.sparkSession.sparkContext.broadcast((head, kind, once))

    @tidied
    def work(batches):
        head, kind, once = sent.value
        total = np.zeros(size, np.int64)
        names = ["row", "pos", "w", "before", "behind", "cell", "n", "alone_before", "alone_behind"]
        kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_())
        for b in batches:
            row = b.column("row").to_numpy()
            for a, tokens, starts in _tokens(b):
                k, tail, before, behind = _tail(head, kind, tokens, starts, end)
                at = _place(head, tokens)
                alone = (at >= 0) & once[np.maximum(at, 0)] if len(head) else np.zeros(len(tokens), bool)
                prior, prior_alone = _before(k, starts, end), _before(alone, starts, False)
                both = (k >= 0) & (prior >= 0)
                for x, y in ((prior, k), (np.where(prior_alone, rare, -1), k), (prior, np.where(alone, rare, -1)), (np.where(prior_alone, rare, -1), np.where(alone, rare, -1))):
                    on = both & (x >= 0) & (y >= 0)
                    total += np.bincount(x[on] * kinds + y[on], minlength=size)
                if len(tail):
                    of = a + np.searchsorted(starts, tail, "right") - 1
                    next_ = np.minimum(tail + 1, len(k) - 1)
                    zero = np.zeros(len(tail), np.int64)
                    columns = (row[of], tail, tokens[tail].view(np.int64), before, behind, zero - 1, zero, prior_alone[tail], alone[next_])
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds_of, strict=True)], names)
        at = np.flatnonzero(total)
        zero = np.zeros(len(at), np.int64)
        columns = (zero - 1, zero, at * -7046029254386353131, zero, zero, at, total[at], zero > 0, zero > 0)
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds_of, strict=True)], names)

    rows = train.select(F.monotonically_increasing_id().alias("row"), "text")
    parts = rows.mapInArrow(work, "row long, pos long, w long, before int, behind int, cell int, n long, alone_before boolean, alone_behind boolean")
    parts = stored(parts)
    found = parts.filter("cell >= 0").groupBy("cell").agg(F.sum("n").alias("n"))
    met = parts.filter("cell < 0").join(table.select("w", "k", (F.col("c") == 1).alias("alone")), "w")
    order = Window.partitionBy("row").orderBy("pos")
    met = met.withColumn("last", F.lag("k").over(order)).withColumn("last_alone", F.lag("alone").over(order))
    inner = F.col("before") < 0
    met = met.withColumn("x", F.when(inner, F.col("last")).otherwise(F.col("before"))).withColumn("x_alone", F.when(inner, F.col("last_alone")).otherwise(F.col("alone_before")))
    cell = lambda on, x, y: F.when(on, x * kinds + y)
    into = [cell(F.lit(True), F.col("x"), F.col("k")), cell(F.col("x_alone"), F.lit(rare), F.col("k")), cell(F.col("alone"), F.col("x"), F.lit(rare)), cell(F.col("x_alone") & F.col("alone"), F.lit(rare), F.lit(rare))]
    off = F.col("behind") >= 0
    out = [cell(off, F.col("k"), F.col("behind")), cell(off & F.col("alone"), F.lit(rare), F.col("behind")), cell(off & F.col("alone_behind"), F.col("k"), F.lit(rare)), cell(off & F.col("alone") & F.col("alone_behind"), F.lit(rare), F.lit(rare))]
    more = met.select(F.explode(F.array_compact(F.array(*into, *out))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    counted = np.zeros(size, np.int64)
    for r in found.unionByName(more).collect():
        counted[r.cell] += r.n
    discard(parts)
    sent.destroy()
    return counted.reshape(kinds, kinds)


def fit(train: DataFrame, s: Settings) -> tuple[DataFrame, dict]:
    """(table w, c, k of all training words; model) of the training texts (text)."""
    spark = train.sparkSession
    counts = stored(word_counts(train))
    release(spark)
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    words = counts.filter(F.col("w") != int(END.view(np.int64)))
    top = _most_frequent(words, s.head)
    w, c = top.column("w").to_numpy().view(np.uint64), top.column("c").to_numpy()
    rank = np.lexsort((w.view(np.int64), -c))
    w, c = w[rank], c[rank]
    ends = total - int(words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    discard(counts)

    near, many = w[: s.contexts], min(s.clustered, len(w))
    ring = np.sort(near)
    some_order = np.argsort(w[:many])
    some = w[:many][some_order]
    width = len(ring) + 2

    def beside(tokens, starts):
        item = _place(some, tokens)
        context = _place(ring, tokens)
        context = np.where(tokens == END, len(ring), np.where(context < 0, len(ring) + 1, context))
        left = _before(context, starts, len(ring))
        right = np.empty_like(context)
        right[:-1], right[-1:] = context[1:], -1
        right[tokens == END] = -1
        for side, c in ((0, left), (1, right)):
            ok = (item >= 0) & (c >= 0)
            yield item[ok] * (2 * width) + side * width + c[ok]

    by_rank = np.zeros((many, 2 * width), np.int64)
    if many:
        by_rank[some_order] = _pair_counts(train, (many, 2 * width), beside)
    of = exchange(by_rank, s.classes, s.rounds)
    met = stored(neighbours(train, some, of[some_order], s.classes))
    release(spark)
    exchanged = pa.table({"w": w[:many].view(np.int64), "c": c[:many], "k": of.astype(np.int32)})
    table = stored(assigned(met, s.classes).unionByName(spark.createDataFrame(exchanged)))
    discard(met)
    release(spark)

    rare, end, kinds = s.classes, s.classes + 1, s.classes + 2
    top = _most_frequent(table, s.head)
    head, head_c, head_k = top.column("w").to_numpy().view(np.uint64), top.column("c").to_numpy(), top.column("k").to_numpy()
    order = np.argsort(head)
    head, head_c, head_k = head[order], head_c[order], head_k[order]
    moves = _transitions(train, table, head, head_k, head_c == 1, s.classes)
    size = np.ones(kinds)
    for r in table.groupBy("k").agg(F.sum("c").alias("c")).collect():
        size[r.k] = r.c
    base = math.log10(total + 0.5 * (distinct + 1))
    step = np.log10((moves + 0.5) / (moves.sum(1, keepdims=True) + 0.5 * kinds))
    model = {
        "head": head, "kind": head_k.astype(np.int16), "step": step, "rare": rare, "end": end, "train_tokens": int(total), "size": np.log10(size),
        "emit": np.log10(head_c) - np.log10(size[head_k]), "base": np.log10(head_c + 0.5) - base,
        "end_base": math.log10(ends + 0.5) - base, "ends": int(ends), "base_below": float(base),
    }
    return table, model


def score(docs: DataFrame, train: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` holds the rows to learn from. Frequent words are scored where the
    text is read; only the others' hashes are shuffled, to meet their counts and classes.
    A null text is empty: one END. Rows that repeat are scored each; without
    training texts every token is unknown. Other columns are not read.
    """
    table, m = fit(train, settings)
    sent = docs.sparkSession.sparkContext.broadcast(m)
    names = ["row", "doc_id", "w", "pos", "before", "behind", "n_tokens", "known", "base", "score"]

    @tidied
    def work(batches):
        m = sent.value
        head, end = m["head"], m["end"]
        for b in batches:
            ids, row = b.column("doc_id"), b.column("row").to_numpy()
            for a, tokens, starts in _tokens(b):
                at = _place(head, tokens)
                known, is_end = at >= 0, tokens == END
                safe = np.maximum(at, 0)
                k, tail, before, behind = _tail(head, m["kind"], tokens, starts, end)
                base, log = np.zeros(len(tokens)), np.zeros(len(tokens))
                if len(head):
                    base, log = np.where(known, m["base"][safe], 0.0), np.where(known, m["emit"][safe], 0.0)
                base[is_end] = m["end_base"]
                prior = _before(k, starts, end)
                log += np.where((k >= 0) & (prior >= 0), m["step"][prior, k], 0.0)
                n = len(starts)
                of = np.searchsorted(starts, tail, "right") - 1
                length = np.diff(np.append(starts, len(tokens)))
                counted = np.add.reduceat((known | (is_end & (m["ends"] > 0))).astype(np.int64), starts)
                both = np.concatenate([np.arange(n), of]) + a
                pad = lambda x: pa.array(np.concatenate([x, np.zeros(len(tail), x.dtype)]))
                behind_row = lambda x, v: pa.array(np.concatenate([np.full(n, v), x]).astype(np.int64))
                w = np.concatenate([row[a : a + n] * -7046029254386353131, tokens[tail].view(np.int64)])
                columns = [pa.array(row[both]), ids.take(pa.array(both)), pa.array(w), behind_row(tail, -1), behind_row(before, -1), behind_row(behind, -1), pad(length), pad(counted), pad(np.add.reduceat(base, starts)), pad(np.add.reduceat(log, starts))]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(work, "row long, doc_id long, w long, pos long, before long, behind long, n_tokens long, known long, base double, score double")
    lookup = table.select(F.col("w").alias("cw"), "c", F.col("k").alias("ck"))
    tail = F.col("pos") >= 0
    met = parts.join(lookup, (F.col("w") == F.col("cw")) & tail, "left").withColumn("k", F.when(tail, F.coalesce("ck", F.lit(m["rare"]))))
    last = F.when(F.col("before") < 0, F.lag("k").over(Window.partitionBy("row").orderBy("pos"))).otherwise(F.col("before"))
    met = met.withColumn("last", last)
    kinds = m["end"] + 1
    steps_, sizes = (F.array(*(F.lit(float(x)) for x in m[name].ravel())) for name in ("step", "size"))
    step = lambda x, y: F.get(steps_, (x * kinds + y).cast("int"))
    emit = F.when(F.col("c") > 0, F.log10("c") - F.get(sizes, F.col("k").cast("int"))).otherwise(0.0)
    met = met.select(
        "row", "doc_id", "n_tokens",
        F.when(tail, F.when(F.col("c") > 0, 1).otherwise(0)).otherwise(F.col("known")).alias("known"),
        F.when(tail, F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) - F.lit(m["base_below"])).otherwise(F.col("base")).alias("base"),
        F.when(tail, emit + step(F.col("last"), F.col("k")) + F.when(F.col("behind") >= 0, step(F.col("k"), F.col("behind"))).otherwise(0.0)).otherwise(F.col("score")).alias("score"),
    )
    sums = met.groupBy("row", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("known").cast("long").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(m["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
