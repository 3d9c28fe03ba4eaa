"""Removal of byte strings that an earlier document has, with merged Burrows–Wheeler transforms.

Every window of ``width`` bytes has an anchor, the least hashed ``gram`` in it,
so equal windows have equal anchors. Stretches of text whose anchors no other
document has cannot repeat and are left out. The others meet by anchor: the
distinct stretches around an anchor are cut into shards, each shard's transform
is built, and the transforms are merged by refining their interleave one symbol
(two bytes) at a time, which also tells where neighbours begin to differ. After
``width`` bytes the runs without a difference are the repeated windows; the
smallest document of a run is the first to have it.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import _BYTE, _powers, discard, mix, release, scratch_dir, steps, stored, text_buffer, tidied
from spectraloom.memory import ease


@dataclass(frozen=True)
class Settings:
    """width: bytes of a repeated string. gram: bytes of an anchor.

    shard_bytes, merge_bytes: stretches of a shard, and of the shards that are
    merged at a time (whole anchors). group_stretches: an anchor with more
    distinct stretches is settled by window hashes instead, as it would not fit
    a task. pass_stretches, passes: stretches that are settled at a time, so that
    the tables of a few anchors only are on disk beside the stretches, and into
    how many parts all are dealt at most.
    """

    width: int = 50
    gram: int = 22
    shard_bytes: int = 1 << 15
    merge_bytes: int = 1 << 16
    group_stretches: int = 4096
    pass_stretches: int = 1 << 24
    passes: int = 8


_LOW = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0x94D049BB133111EB)
#: Two-byte symbols: UTF-8 has no byte above 0xF7, so 249 digits (0: behind the end) fit 16 bits.
_DIGITS = 249


def anchors(raw: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, first window, last window) of each run of windows with one anchor, by row and position.

    Windows do not cross rows. Positions are in ``raw``.
    """
    none = np.zeros(0, np.int64)
    n, span = len(raw), s.width - s.gram + 1
    if n < s.width:
        return none, none.view(np.uint64), none, none
    up, down = _powers(1 << max(20, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    m = n - s.gram + 1
    # One xor-shift and multiply: the high bits order the grams, and any order leaves the result exact.
    h = total[s.gram :] - total[:m]
    h *= down[:m]
    h ^= h >> np.uint64(32)
    h *= _ODD
    low = h & ~_LOW
    low |= np.arange(m, dtype=np.uint64) & _LOW
    # The least of ``span`` neighbours, from runs that double in length.
    reach, windows = 1, m - span + 1
    while reach < span:
        step = min(reach, span - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    low &= _LOW
    if n > int(_LOW):
        at = np.arange(windows, dtype=np.uint64)
        low = at + ((low - at) & _LOW)
    cut = np.empty(windows, bool)
    cut[0] = True
    np.not_equal(low[1:], low[:-1], out=cut[1:])
    valid = np.ones(windows, bool)
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[max(a, z - s.width + 1) : z] = False
        cut[a : a + 1] = True
    first = np.flatnonzero(cut & valid)
    row = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], windows) - 1, offsets[row + 1] - s.width)
    return row, h[low[first].astype(np.int64)] >> np.uint64(16), first, last


def _runs(batch: pa.RecordBatch, s: Settings):
    """(first row, text bytes, offsets, *anchors) of some rows at a time."""
    raw, offsets = text_buffer(batch.column("text"))
    for a, z in steps(offsets):
        part, at = raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        yield a, part, at, *anchors(part, at, s)


def _with_class(docs: DataFrame) -> DataFrame:
    """doc_id, cls, text: cls is a 64-bit hash of the text; null texts, which have no bytes, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("cls"), "text").filter("text is not null")


def shared_anchors(docs: DataFrame, s: Settings) -> DataFrame:
    """cls, anchors (array<long>) of the texts that have an anchor which a different text has."""

    @tidied
    def work(batches):
        for b in batches:
            cls = b.column("cls").to_numpy()
            for a, _, _, row, h, _, _ in _runs(b, s):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cls[a + row])], ["anchor", "cls"])

    rows = _with_class(docs).select("cls", "text").mapInArrow(work, "anchor long, cls long")
    every = Window.partitionBy("anchor")
    met = rows.withColumn("lo", F.min("cls").over(every)).withColumn("hi", F.max("cls").over(every)).filter("lo < hi")
    return met.groupBy("cls").agg(F.collect_set("anchor").alias("anchors"))


def stretches(docs: DataFrame, shared: DataFrame, s: Settings) -> DataFrame:
    """anchor, doc_id, cls, at, bytes: the text around each shared anchor, from its first window to the end of its last."""

    @tidied
    def work(batches):
        for b in batches:
            ids, cls, wanted = b.column("doc_id"), b.column("cls"), b.column("anchors")
            for a, part, offsets, row, h, first, last in _runs(b, s):
                rows_of = wanted.slice(a, len(offsets) - 1)
                many = np.diff(np.frombuffer(rows_of.buffers()[1], np.int32)[rows_of.offset : rows_of.offset + len(rows_of) + 1])
                mine = mix(np.arange(len(offsets) - 1, dtype=np.uint64) + np.uint64(1))
                sought = rows_of.flatten().to_numpy().view(np.uint64) ^ np.repeat(mine, many)
                on, data = np.flatnonzero(np.isin(h ^ mine[row], sought)), part.tobytes()
                for k in range(0, len(on), 20_000):
                    some = on[k : k + 20_000]
                    texts = [data[x : y + s.width] for x, y in zip(first[some].tolist(), last[some].tolist(), strict=True)]
                    rows = pa.array(a + row[some])
                    yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), ids.take(rows), cls.take(rows), pa.array(first[some] - offsets[row[some]]), pa.array(texts, pa.binary())], ["anchor", "doc_id", "cls", "at", "bytes"])

    met = _with_class(docs).join(shared.hint("shuffle_hash"), "cls").select("doc_id", "cls", "text", "anchors")
    return met.mapInArrow(work, "anchor long, doc_id long, cls long, at long, bytes binary")


def shard_transform(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, symbol before) of the suffixes of a shard in the order of their first ``width`` bytes.

    Two empty suffixes a text come first, in the order of the texts; a suffix at
    position 0 or 1 has no symbol (0) before it.
    """
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths + width)])
    flat = np.zeros(starts[-1], np.uint8)
    for t, x in zip(texts, starts, strict=False):
        flat[x : x + len(t)] = np.frombuffer(t, np.uint8) + 1
    text = np.repeat(np.arange(len(texts)), lengths)
    position = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    where = starts[text] + position
    keys = np.lib.stride_tricks.sliding_window_view(np.append(flat, np.zeros(width, np.uint8)), width)[where]
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{width}").ravel(), kind="stable")
    text, position = text[order], position[order]
    pads = np.repeat(np.arange(len(texts)), 2)
    text = np.concatenate([pads, text])
    position = np.concatenate([np.column_stack([lengths, lengths + 1]).ravel(), position])
    before = starts[text] + position - 2
    symbol = flat[np.maximum(before, 0)].astype(np.int64) * _DIGITS + flat[np.maximum(before + 1, 0)]
    return text, position, np.where(position >= 2, symbol, 0).astype(np.uint16)


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], pads: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each merged suffix, whether it differs from the one before it in the first ``width`` bytes).

    The interleave starts with the shards one behind another. Each round reads
    the symbols before the suffixes in merged order and sorts them stably, which
    gives the interleave ordered by one symbol more; only the shards' numbers
    move, each shard's own order stands. Neighbours differ if their symbols do
    or if what follows them did. Suffixes without a symbol before them sort
    first and fall out; as many empty suffixes stand in front.
    """
    first = np.repeat(np.arange(len(shards)), pads).astype(np.uint8 if len(shards) < 256 else np.uint16)
    rest = np.repeat(np.arange(len(shards)), [len(x[2]) - k for x, k in zip(shards, pads, strict=True)]).astype(first.dtype)
    front, symbols = len(first), np.concatenate([x[2] for x in shards])
    z = np.concatenate([first, rest])
    block, merged, differs = np.zeros(len(z), np.int32), np.empty(len(z), np.uint16), np.zeros(len(z), bool)
    for _ in range(width // 2):
        merged[np.argsort(z, kind="stable")] = symbols
        order = np.argsort(merged, kind="stable")[front:]
        z[front:] = z[order]
        s, b = merged[order], block[order]
        differs[0] = differs[front] = True
        np.not_equal(s[1:], s[:-1], out=differs[front + 1 :])
        differs[front + 1 :] |= b[1:] != b[:-1]
        np.cumsum(differs, out=block)
    return z, differs


def first_documents(texts: list[bytes], docs: np.ndarray, s: Settings) -> np.ndarray:
    """For the windows of each text in turn, the smallest of ``docs`` that has the window."""
    shards, pads, members, at = [], [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= s.shard_bytes):
            size += len(texts[end])
            end += 1
        shards.append(shard_transform(texts[at:end], s.width))
        pads.append(2 * (end - at))
        members.append(at)
        at = end
    z, differs = merge(shards, pads, s.width)
    lengths = np.array([len(t) for t in texts])
    text, position = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    for k, ((t, p, _), m) in enumerate(zip(shards, members, strict=True)):
        mine = z == k
        text[mine], position[mine] = t + m, p
    window = position + s.width <= lengths[text]
    value = np.where(window, docs[text], np.iinfo(np.int64).max)
    begins = np.flatnonzero(differs)
    least = np.repeat(np.minimum.reduceat(value, begins), np.diff(np.append(begins, len(z))))
    base = np.concatenate([[0], np.cumsum(lengths - s.width + 1)])
    out = np.empty(base[-1], np.int64)
    out[base[text[window]] + position[window]] = least[window]
    return out


def _runs_of(sizes: np.ndarray, first: np.ndarray) -> pa.Array:
    """Lists of (a, z, first): for each text, runs of windows with the same first document."""
    base = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.ones(len(first), bool)
    cut[1:] = first[1:] != first[:-1]
    cut[base[:-1]] = True
    at = np.flatnonzero(cut)
    owner = np.searchsorted(base, at, "right") - 1
    ends = np.append(at[1:], len(first))
    fields = [pa.array((at - base[owner]).astype(np.int32)), pa.array((ends - base[owner]).astype(np.int32)), pa.array(first[at])]
    offsets = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["a", "z", "first"]))


def _merged(distinct: DataFrame, s: Settings) -> DataFrame:
    """anchor, key, runs (array of windows a to z and the first document with them) of distinct stretches."""

    @tidied
    def work(batches):
        held: list[tuple] = []
        size = 0

        def close(rows):
            """Runs of whole anchors; a stretch alone with its anchor has nothing to be merged with."""
            anchor = np.array([r[0] for r in rows])
            cuts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            group = np.diff(np.append(cuts, len(rows)))
            alone = np.repeat(group == 1, group)
            sizes = np.array([len(r[2]) - s.width + 1 for r in rows])
            docs = np.array([r[3] for r in rows], np.int64)
            first = np.repeat(docs, sizes)
            if not alone.all():
                first[np.repeat(~alone, sizes)] = first_documents([r[2] for r, one in zip(rows, alone, strict=True) if not one], docs[~alone], s)
            return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), _runs_of(sizes, first)], ["anchor", "key", "runs"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("anchor", "key", "bytes", "first")), strict=True):
                if size >= s.merge_bytes and r[0] != held[-1][0]:
                    yield close(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[2])
        if held:
            yield close(held)

    dealt = distinct.select("anchor", "key", "bytes", "first").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(work, "anchor long, key long, runs array<struct<a: int, z: int, first: long>>")


def _by_hash(distinct: DataFrame, s: Settings) -> DataFrame:
    """The same rows for anchors with too many stretches: each window's hash meets its equals."""
    rows = distinct.select("anchor", "key", "bytes", "first", F.explode(F.expr(f"sequence(0, length(bytes) - {s.width})")).alias("a"))
    rows = rows.select("anchor", "key", "first", "a", F.sha2(F.substring("bytes", F.col("a") + 1, F.lit(s.width)), 256).alias("w"))
    least = rows.groupBy("anchor", "w").agg(F.min("first").alias("least"))
    one = F.struct("a", (F.col("a") + 1).alias("z"), F.col("least").alias("first"))
    return rows.join(least, ["anchor", "w"]).groupBy("anchor", "key").agg(F.collect_list(one).alias("runs"))


def _dealt(found: DataFrame, passes: int) -> list[DataFrame]:
    """``found`` stored in parts by anchor, each a table that can go by itself; every task has a writer for each, so nothing is sorted."""
    if passes == 1:
        return [stored(found)]
    spark, path, writers = found.sparkSession, f"{scratch_dir(found.sparkSession)}/{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, str(passes))
    try:
        part = F.pmod(F.xxhash64("anchor"), F.lit(passes)).cast("int")
        found.withColumn("part", part).write.option("compression", "zstd").partitionBy("part").parquet(path)
    finally:
        spark.conf.set(writers, before)
    ease(spark)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = {f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)}
    parts = []
    for k in range(passes):
        if f"part={k}" in there:
            parts.append(spark.read.schema(found.schema).parquet(f"{path}/part={k}"))
            parts[-1]._scratch_path = f"{path}/part={k}"
    return parts


def _cuts(found: DataFrame, s: Settings) -> DataFrame:
    """doc_id, cls, start, end: byte ranges of the stretches ``found`` that a document of smaller id has; ``found`` is deleted."""
    spark = found.sparkSession
    # What a step has read goes before the next one writes: its table, and the shuffle files behind it.
    distinct = stored(found.groupBy("anchor", "bytes").agg(F.min("doc_id").alias("first")).withColumn("key", F.xxhash64("bytes")))
    release(spark)
    large = stored(distinct.groupBy("anchor").count().filter(F.col("count") > s.group_stretches).select("anchor"))
    if large.isEmpty():
        runs = _merged(distinct, s)
    else:
        runs = _merged(distinct.join(large, "anchor", "left_anti"), s).unionByName(_by_hash(distinct.join(large, "anchor", "left_semi"), s))
    runs = stored(runs)
    discard(distinct, large)
    release(spark)
    places = found.select("anchor", F.xxhash64("bytes").alias("key"), "doc_id", "cls", "at")
    met = places.join(runs, ["anchor", "key"]).select("doc_id", "cls", "at", F.explode("runs").alias("r")).filter("r.first < doc_id")
    cuts = stored(met.select("doc_id", "cls", (F.col("at") + F.col("r.a")).alias("start"), (F.col("at") + F.col("r.z") + (s.width - 1)).alias("end")))
    discard(found, runs)
    release(spark)
    return cuts


def repeated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, cls, cuts (array<struct<start, end>>): byte ranges of each text that a document of smaller id has."""
    s = settings
    shared = stored(shared_anchors(docs, s))
    release(docs.sparkSession)
    many = shared.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    found = _dealt(stretches(docs, shared, s), min(s.passes, 1 + many // s.pass_stretches))
    discard(shared)
    release(docs.sparkSession)
    parts = [_cuts(part, s) for part in found]
    whole = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("cls"), F.md5("text").alias("same"), F.octet_length("text").cast("long").alias("end"))
    copies = whole.join(whole.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "same").filter(f"doc_id > first and end >= {s.width}")
    cuts = functools.reduce(DataFrame.union, parts, copies.select("doc_id", "cls", F.lit(0).cast("long").alias("start"), "end"))
    cuts = stored(cuts.groupBy("doc_id", "cls").agg(F.collect_list(F.struct("start", "end")).alias("cuts")))
    discard(*parts)
    return cuts


def _without(raw: np.ndarray, offsets: np.ndarray, cuts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Maximal spans of the ``cuts`` (list of start and end, or null) of each text, and the bytes left; all texts at once."""
    many = cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    every = cuts.flatten()
    owner = np.repeat(np.arange(len(many)), many)
    # Counted from the first text on, with a byte between texts, so that no span joins those of two texts.
    base = offsets[owner] + owner
    start, end = every.field("start").to_numpy() + base, every.field("end").to_numpy() + base
    order = np.argsort(start, kind="stable")
    start, reach, owner = start[order], np.maximum.accumulate(end[order]), owner[order]
    begins = np.ones(len(start), bool)
    begins[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(begins)
    owner = owner[at]
    start, end = start[at] - owner, reach[np.append(at[1:], len(reach))[: len(at)] - 1] - owner
    of = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(many)))])
    fields = [pa.array(start - offsets[owner]), pa.array(end - offsets[owner])]
    spans = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "end"]))
    gone = np.concatenate([[0], np.cumsum(end - start)])[of]
    # Bytes from the end of one span to the start of the next, across texts.
    pieces, buffer = raw.data, bytearray()
    for x, y in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True):
        buffer += pieces[x:y]
    left = (offsets - gone).astype(np.int32)
    return spans, pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(left), pa.py_buffer(bytes(buffer))])


def remove(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, spans (array<struct<start, end>>, maximal and ascending), kept (binary).

    Each byte goes that lies in a string of ``width`` bytes which also starts in
    a document of smaller doc_id; strings are judged on the texts as they are
    and do not cross texts. A null text has no bytes. Rows of one doc_id do not
    act on one another. Copies of a whole text are cut by their digest. Other
    columns are not read.
    """

    @tidied
    def work(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column("text"))
            spans, kept = _without(raw, offsets, b.column("cuts"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), spans, kept], ["doc_id", "n_bytes", "spans", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("cls"), "text")
    cut = repeated(docs, settings)
    release(docs.sparkSession)
    met = rows.join(cut.hint("shuffle_hash"), ["doc_id", "cls"], "left").select("doc_id", "text", "cuts")
    return met.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
