"""Score cards shard by shard: spectra stream past the ions of some entries, by hash (open search) or by mass (closed).

Matches of single peaks never leave a shard, only cards do, or what a search
keeps of them: histograms of scores and the best few.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.chem import PROTON_E8, UNIT, WATER_E8
from spectraloom.params import SearchParams

#: Entries of a shard at most; their ions are what a task holds. Small indexes make smaller shards, for all cores.
SHARD_ENTRIES, LEAST_ENTRIES = 1 << 15, 1 << 9
#: The same for a mass range of the closed search: each of its spectra goes to all its shards, so they are few.
RANGE_ENTRIES = 1 << 17
#: Scores so near to the best are told apart by the exact score.
_SLACK = 1e-3
_LOG10_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log10(np.arange(1, 4096)))])
_NAMES = ("spectrum_id", "entry_id", "b_cnt", "y_cnt", "b_int", "y_int")
_SCHEMA = ", ".join(f"{n} long" for n in _NAMES)
#: Rows of a batch from a shard.
BATCH_ROWS = 1 << 16
#: Scores are rounded to 6 digits; a step more or less may come of another logarithm.
_ROUNDING = 3e-6


class _Shard:
    """The ions of a shard, sorted by bin."""

    def __init__(self, ids: np.ndarray, bins: np.ndarray, is_y: np.ndarray, z: np.ndarray, top_bin: int):
        self.entries, owner = np.unique(ids, return_inverse=True)
        order = np.argsort(bins, kind="stable")
        self.cell, self.z = (owner + len(self.entries) * is_y)[order].astype(np.int32), z[order]
        self.first = np.searchsorted(bins[order], np.arange(top_bin + 2))

    def cards(self, bins: np.ndarray, intensity: np.ndarray, charge: int, p: SearchParams, best: bool) -> list[np.ndarray]:
        """Entry ids, counts and summed intensities of b and y of the entries that share enough peaks; only those near the best score if ``best``."""
        n, a, end = len(self.entries), self.first[bins - p.df_bins], self.first[bins + p.df_bins + 1]
        spans = list(zip(a.tolist(), end.tolist(), strict=True))
        cell = np.concatenate([self.cell[x:y] for x, y in spans])
        value = np.repeat(intensity.astype(float), end - a)
        if p.match_charge:
            on = np.concatenate([self.z[x:y] for x, y in spans]) <= charge
            cell, value = cell[on], value[on]
        count = np.bincount(cell, minlength=2 * n).reshape(2, n)
        hit = np.flatnonzero(count.sum(0) >= max(1, p.min_shared))
        # Doubles hold the sums exactly: intensities are integers up to ``base``.
        total = np.bincount(cell, value, 2 * n).reshape(2, n)
        if best and len(hit):
            rough = _LOG10_FACTORIAL[np.minimum(count[:, hit], len(_LOG10_FACTORIAL) - 1)].sum(0) + np.log10(total[:, hit] + 1).sum(0)
            rough = np.minimum(rough, 79.0 + 4.0)
            hit = hit[rough >= rough.max() - _SLACK]
        return [self.entries[hit], count[0, hit], count[1, hit], total[0, hit], total[1, hit]]


def open_cards(spectra: DataFrame, peaks: DataFrame, ions: DataFrame, entries: int, p: SearchParams, best: bool = False, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """spectrum_id, entry_id, b_cnt, y_cnt, b_int, y_int of pairs that share at least ``min_shared`` peaks, at any mass.

    ``entries`` is their number; ids may be any. Each spectrum's peaks go once to every
    shard of entries; matches of single peaks never leave the shard, only cards
    that reach the count do, and with ``best`` only those whose score comes near
    the best of the spectrum in the shard, so that a top match costs a few rows.
    """
    cores = spectra.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-entries // shard_entries), min(2 * cores, entries // LEAST_ENTRIES))
    members = ions.select(F.pmod(F.xxhash64("entry_id"), F.lit(shards).cast("long")).alias("g"), F.lit(False).alias("query"), F.col("entry_id").alias("id"), "bin", F.col("is_y").cast("long").alias("v"), F.col("z").cast("int").alias("z"))
    guard = (F.col("bin") > p.df_bins) & (F.col("bin") < p.top_bin - p.df_bins)
    asked = peaks.filter(guard).join(spectra.select("spectrum_id", "charge"), "spectrum_id")
    asked = asked.select(F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("g"), F.lit(True).alias("query"), F.col("spectrum_id").alias("id"), "bin", F.col("intensity").cast("long").alias("v"), F.col("charge").cast("int").alias("z"))
    dealt = members.union(asked).repartitionById(shards, F.col("g").cast("int")).sortWithinPartitions("g", "query", "id")

    def build(ids, bins, v, z):
        return _Shard(ids, bins, v, z, p.top_bin)

    def answer(shard, spectrum, bins, v, z):
        return _of_spectrum(spectrum, shard.cards(bins, v, int(z[0]), p, best))

    return dealt.mapInArrow(lambda batches: _swept(batches, ("bin", "v", "z"), _NAMES, build, answer), _SCHEMA)


def _of_spectrum(spectrum: int, found: list[np.ndarray]) -> list[np.ndarray]:
    return [np.full(len(found[0]), spectrum), *found]


def _swept(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], names: tuple[str, ...], build: Callable, answer: Callable) -> Iterator[pa.RecordBatch]:
    """Rows g, query, id and ``columns`` by g, ions first, then spectra: ``build`` makes a shard, ``answer`` the rows of a spectrum in it."""
    group, held, shard, open_id, open_rows = None, [], None, None, []

    def joined(rows: list[tuple]) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*rows, strict=True)]

    def close() -> list[np.ndarray] | None:
        """Rows of the spectrum whose peaks have come in."""
        nonlocal open_id, open_rows
        if open_id is None or shard is None:
            return None
        out = answer(shard, open_id, *joined(open_rows))
        open_id, open_rows = None, []
        return out

    def batch(made: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in joined(made)], list(names))

    made, rows = [], 0
    for b in batches:
        g, query, ids, *rest = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "query", "id", *columns))
        change = (g[1:] != g[:-1]) | (query[1:] != query[:-1]) | (query[1:] & (ids[1:] != ids[:-1]))
        cuts = np.flatnonzero(change) + 1
        for a, end in zip([0, *cuts], [*cuts, len(g)], strict=True):
            if (g[a] != group or not query[a] or ids[a] != open_id) and (one := close()) is not None:
                made.append(one)
                rows += len(one[0])
                if rows >= BATCH_ROWS:
                    yield batch(made)
                    made, rows = [], 0
            if g[a] != group:
                group, held, shard = g[a], [], None
            if not query[a]:
                held.append((ids[a:end], *(c[a:end] for c in rest)))
            elif held or shard is not None:
                if shard is None:
                    shard, held = build(*joined(held)), []
                open_id = ids[a]
                open_rows.append(tuple(c[a:end] for c in rest))
    if (last := close()) is not None:
        made.append(last)
    if made:
        yield batch(made)


class _Band:
    """The ions of a mass range, sorted by bin; entries are numbered by mass, so that those of a band are neighbours."""

    def __init__(self, ids: np.ndarray, mass: np.ndarray, lists: np.ndarray, offsets: np.ndarray, ladder: bool, p: SearchParams):
        """``lists``: of each entry its ladder, or its ions as ``_packed`` has them."""
        by_mass = np.argsort(mass, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[by_mass] = np.arange(len(ids))
        self.entries, self.mass = ids[by_mass], mass[by_mass]
        cells, bins, charges = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int8)]
        for cell, at, z in self._ladders(number, lists, offsets, p) if ladder else self._ions(number, lists, offsets):
            on = at < p.top_bin
            cells.append(cell[on].astype(np.int32))
            bins.append(at[on].astype(np.int32))
            charges.append(np.full(len(cells[-1]), z, np.int8) if np.isscalar(z) else z[on].astype(np.int8))
        bins = np.concatenate(bins)
        order = np.argsort(bins, kind="stable")
        self.cell, self.z = np.concatenate(cells)[order], np.concatenate(charges)[order] if p.match_charge else None
        self.first = np.searchsorted(bins[order], np.arange(p.top_bin + 2, dtype=np.int32))

    @staticmethod
    def _ladders(number: np.ndarray, sums: np.ndarray, offsets: np.ndarray, p: SearchParams):
        """(cell, bin, charge) of b and y at each charge, as ``ions.fragments`` has them."""
        cuts = np.diff(offsets) - 2
        owner = np.repeat(np.arange(len(number)), cuts)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts) + 1
        end = offsets[1:][owner] - 1
        for is_y, m in ((0, sums[offsets[:-1][owner] + pos]), (1, sums[end] - sums[end - pos] + WATER_E8)):
            cell = 2 * number[owner] + is_y
            for z in range(1, p.max_charge + 1):
                yield cell, (m + z * PROTON_E8) * p.scale // (z * UNIT), z

    @staticmethod
    def _ions(number: np.ndarray, packed: np.ndarray, offsets: np.ndarray):
        kind = packed >> 32
        yield 2 * np.repeat(number, np.diff(offsets)) + (kind & 1), packed & 0xFFFFFFFF, kind >> 1

    def cards(self, bins: np.ndarray, intensity: np.ndarray, charge: int, prec_e8: int, p: SearchParams, least: int) -> list[np.ndarray]:
        """Entry ids, counts and summed intensities of b and y of the entries of the band that share ``least`` peaks."""
        low, high = np.searchsorted(self.mass, prec_e8 - p.dm_e8), np.searchsorted(self.mass, prec_e8 + p.dm_e8, "right")
        a, end = self.first[bins - p.df_bins], self.first[bins + p.df_bins + 1]
        spans = list(zip(a.tolist(), end.tolist(), strict=True))
        cell = np.concatenate([self.cell[x:y] for x, y in spans])
        on = (cell >= 2 * low) & (cell < 2 * high)
        if p.match_charge:
            on &= np.concatenate([self.z[x:y] for x, y in spans]) <= charge
        cell, value = cell[on] - 2 * low, np.repeat(intensity.astype(float), end - a)[on]
        size = 2 * (high - low)
        count = np.bincount(cell, minlength=size).reshape(-1, 2)
        hit = np.flatnonzero(count.sum(1) >= least)
        # Doubles hold the sums exactly: intensities are integers up to ``base``.
        total = np.bincount(cell, value, size).reshape(-1, 2)
        return [self.entries[low + hit], count[hit, 0], count[hit, 1], total[hit, 0], total[hit, 1]]


@functools.lru_cache(4)
def _factorials(size: int) -> np.ndarray:
    """log10(n!) below ``size``, summed from 1 on."""
    return np.concatenate([[0.0], np.cumsum([math.log10(i) for i in range(1, size)])])


def hyperscores(b_cnt: np.ndarray, y_cnt: np.ndarray, b_int: np.ndarray, y_int: np.ndarray) -> np.ndarray:
    """The scores of ``functions.peptide.hyperscore``, rounded to 6 digits."""
    if not len(b_cnt):
        return np.zeros(0)
    known = _factorials(1 << max(8, int(max(b_cnt.max(), y_cnt.max())).bit_length()))
    return np.round(np.minimum(known[b_cnt] + known[y_cnt] + np.log10(b_int + 1) + np.log10(y_int + 1) - 4.0, 79.0), 6)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each list begins (n + 1)."""
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))


def _streamed(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], ladder: list[bool], p: SearchParams, answer: Callable) -> Iterator[pa.RecordBatch]:
    """Rows by g, entries first, then spectra: ``answer(bands, bins, intensity, charge, prec_e8)`` has the rows of a spectrum."""
    group, held, bands = None, [], None

    def build() -> list[_Band]:
        every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        made = []
        for k, is_ladder in enumerate(ladder):
            own = every.filter(pa.array(every.column("z").to_numpy() == k)) if len(ladder) > 1 else every
            made.append(_Band(own.column("id").to_numpy(), own.column("m").to_numpy(), *_lists(own.column("x")), is_ladder, p))
        return made

    def batch(made: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*made, strict=True)], list(names))

    made, rows = [], 0
    for b in batches:
        g, query, ids, m, z = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "query", "id", "m", "z"))
        cuts = np.flatnonzero((g[1:] != g[:-1]) | (query[1:] != query[:-1])) + 1
        for a, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
            if a == end:
                continue
            if g[a] != group:
                group, held, bands = g[a], [], None
            if not query[a]:
                held.append(b.slice(a, end - a))
                continue
            if bands is None and not held:
                continue
            if bands is None:
                bands, held = build(), []
            peaks, at = _lists(b.column("x").slice(a, end - a))
            for i in range(a, end):
                mine = peaks[at[i - a] : at[i - a + 1]]
                one = _of_spectrum(ids[i], answer(bands, mine >> 32, mine & 0xFFFFFFFF, int(z[i]), int(m[i])))
                made.append(one)
                rows += len(one[0])
                if rows >= BATCH_ROWS:
                    yield batch(made)
                    made, rows = [], 0
    if made:
        yield batch(made)


def _packed(ions: DataFrame) -> DataFrame:
    """entry_id, mass_e8, x: ladders as they are; ions of an entry as one list of (2 z + is_y) * 2^32 + bin."""
    if "sums" in ions.columns:
        return ions.select("entry_id", "mass_e8", F.col("sums").alias("x"))
    one = F.expr("shiftleft(cast(2 * z + is_y as bigint), 32) + bin")
    return ions.groupBy("entry_id", "mass_e8").agg(F.collect_list(one).alias("x"))


def _closed(spectra: DataFrame, peaks: DataFrame, parts: list[DataFrame], entries: DataFrame, p: SearchParams, names: tuple[str, ...], answer: Callable, shard_entries: int) -> DataFrame:
    """``answer(bands, bins, intensity, charge, prec_e8)`` of every spectrum and mass range that it touches, a band for each of ``parts``.

    A range is one shard, or several by the hash of the entry where ranges hold many. An
    entry is shuffled as one row, its ladder, and so is a spectrum for a shard; ions are made in the shard.
    """
    spark = spectra.sparkSession
    width = max(2 * p.dm_e8, UNIT)
    by_range = entries.groupBy(F.expr(f"mass_e8 div {width}L")).count()
    shards = max(1, -(-(by_range.agg(F.max("count")).first()[0] or 0) // shard_entries))
    of = lambda k: f"({k}) * {shards}L"
    members = [
        _packed(ions).select((F.expr(of(f"mass_e8 div {width}L")) + F.pmod(F.xxhash64("entry_id"), F.lit(shards).cast("long"))).alias("g"), F.lit(False).alias("query"), F.col("entry_id").alias("id"),
                             F.col("mass_e8").alias("m"), F.lit(k).cast("int").alias("z"), "x")
        for k, ions in enumerate(parts)
    ]
    guard = (F.col("bin") > p.df_bins) & (F.col("bin") < p.top_bin - p.df_bins)
    listed = peaks.filter(guard).groupBy("spectrum_id").agg(F.collect_list(F.expr("shiftleft(cast(bin as bigint), 32) + intensity")).alias("x"))
    asked = listed.join(spectra.select("spectrum_id", "prec_e8", "charge"), "spectrum_id")
    first, last = of(f"greatest(0L, prec_e8 - {p.dm_e8}L) div {width}L"), of(f"(prec_e8 + {p.dm_e8}L) div {width}L")
    asked = asked.select(F.explode(F.expr(f"sequence({first}, {last} + {shards - 1}L)")).alias("g"), F.lit(True).alias("query"), F.col("spectrum_id").alias("id"),
                         F.col("prec_e8").alias("m"), F.col("charge").cast("int").alias("z"), "x")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = functools.reduce(DataFrame.union, [*members, asked]).repartition(tasks, "g").sortWithinPartitions("g", "query")
    ladder = ["sums" in ions.columns for ions in parts]
    return dealt.mapInArrow(lambda batches: _streamed(batches, names, ladder, p, answer), ", ".join(f"{n} long" for n in names))


def closed_cards(spectra: DataFrame, peaks: DataFrame, parts: DataFrame | list[DataFrame], entries: DataFrame, p: SearchParams, shard_entries: int = RANGE_ENTRIES) -> DataFrame:
    """spectrum_id, entry_id, b_cnt, y_cnt, b_int, y_int of pairs that share at least ``min_shared`` peaks, masses within dm.

    The rows of ``score.scorecard(match.fragment_join(...))``, without a shuffle of
    matches: an entry is in one shard, so a card is whole there. ``parts``: ladders or ions of
    ``entries`` (``ions.ladders`` are far less to shuffle), or several tables of them, whose cards are made apart and added up.
    """
    parts = [parts] if isinstance(parts, DataFrame) else parts
    least = max(1, p.min_shared)

    def answer(bands, *spectrum):
        if len(bands) == 1:
            return bands[0].cards(*spectrum, p, least)
        every = [np.concatenate(c) for c in zip(*(b.cards(*spectrum, p, 1) for b in bands), strict=True)]
        ids, at = np.unique(every[0], return_inverse=True)
        sums = [np.bincount(at, c, len(ids)) for c in every[1:]]
        on = sums[0] + sums[1] >= least
        return [ids[on], *(c[on] for c in sums)]

    return _closed(spectra, peaks, parts, entries, p, _NAMES, answer, shard_entries)


def closed_search(spectra: DataFrame, peaks: DataFrame, ions: DataFrame, entries: DataFrame, p: SearchParams, best: int = 1, shard_entries: int = RANGE_ENTRIES) -> DataFrame:
    """What a search needs of all candidates: rows spectrum_id, hbin, n (n > 0) of histograms, and cards (n = 0) of those that may be among the ``best``.

    Candidates are counted where their cards are made. A shard gives a card if fewer
    than ``best`` there score higher, so the best of all are among them; the exact
    score tells them apart. ``histogram_of`` and ``candidates_of`` read the rows.
    """
    least = max(1, p.min_shared)

    def answer(bands, *spectrum):
        found = bands[0].cards(*spectrum, p, least)
        value = hyperscores(found[1], found[2], found[3], found[4])
        found, value = [c[value > 0] for c in found], value[value > 0]
        bins, n = np.unique(np.floor(value * 10 + 0.5).astype(np.int64), return_counts=True)
        near = np.flatnonzero(value >= np.partition(value, -best)[-best] - _ROUNDING) if len(value) > best else np.arange(len(value))
        none, zeros = np.zeros(len(bins), np.int64), np.zeros(len(near), np.int64)
        return [np.concatenate([bins, zeros]), np.concatenate([n, zeros]), *(np.concatenate([none, c[near].astype(np.int64)]) for c in found)]

    return _closed(spectra, peaks, [ions], entries, p, ("spectrum_id", "hbin", "n", *_NAMES[1:]), answer, shard_entries)


def histogram_of(rows: DataFrame) -> DataFrame:
    """spectrum_id, hbin, n of all candidates in the rows of ``closed_search``."""
    return rows.filter("n > 0").groupBy("spectrum_id", F.col("hbin").cast("int").alias("hbin")).agg(F.sum("n").alias("n"))


def candidates_of(rows: DataFrame) -> DataFrame:
    """Cards of the best in the rows of ``closed_search``."""
    return rows.filter("n = 0").select(*_NAMES)
