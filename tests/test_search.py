"""The search on small hand-made inputs: invariants that hold for any data."""

import pytest
from pyspark.sql import functions as F

from spectraloom.chem import MASS_E8, PROTON_E8, WATER_E8
from spectraloom.functions.peptide import register
from spectraloom.operators import ions as ion
from spectraloom.operators import match, mods, peptides, score, spectra
from spectraloom.params import SearchParams, parse_mods
from spectraloom.plans import index, search
from spectraloom.sources import ms2, tables
from spectraloom.streaming.search import exploded, search_stream

P = SearchParams(min_hits=1)
SEQS = ["ACDEFGHIK", "LMNPQRSTVWYK", "GGGGGGK", "EANLER", "EANIER", "SAMPLEK", "PEPTIDEK", "MMSTYAVK", "CCCCCCK", "WWWWWWR"]


@pytest.fixture(scope="module")
def entries(spark):
    return peptides.entries(peptides.peptides(spark.createDataFrame([(s,) for s in SEQS], "seq string"), P)).cache()


def test_clean_and_digest(spark):
    docs = spark.createDataFrame([(1, "ak rp\nkß1k"), (2, None), (3, ""), (4, "kkp")], "doc_id long, text string")
    seqs = {r.doc_id: r.seq for r in peptides.clean(docs).collect()}
    assert seqs == {1: "AKRPKK", 2: None, 3: "", 4: "KKP"}
    pieces = sorted((r.doc_id, r.idx, r.seq) for r in peptides.digest(peptides.clean(docs)).collect())
    assert pieces == [(1, 0, "AK"), (1, 1, "RPK"), (1, 2, "K"), (4, 0, "K"), (4, 1, "KP")]
    runs = sorted(r.seq for r in peptides.missed_cleavages(peptides.clean(docs).filter("doc_id = 1"), 1).collect())
    assert runs == ["AK", "AKRPK", "K", "RPK", "RPKK"]


def test_filters(spark):
    got = peptides.peptides(spark.createDataFrame([("AAAAAA",), ("AAAAAB",), ("GGG",), ("ACDEFGHIK",), ("ACDEFGHIK",)], "seq string"), P).collect()
    assert [r.seq for r in got] == ["ACDEFGHIK"]
    assert got[0].mass_e8 == WATER_E8 + sum(MASS_E8[c] for c in "ACDEFGHIK")
    assert peptides.peptides(spark.createDataFrame([], "seq string"), P).count() == 0


def test_numbering_is_dense_and_ordered(entries):
    rows = entries.orderBy("entry_id").collect()
    assert [r.entry_id for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.len, r.mass_e8, r.seq) for r in rows] == sorted((r.len, r.mass_e8, r.seq) for r in rows)


def test_fragment_counts_and_complements(entries):
    every = ion.fragments(entries, P)
    assert every.count() == sum((r.len - 1) * P.max_charge * 2 for r in entries.collect())
    length = {r.entry_id: (r.len, r.mass_e8) for r in entries.collect()}
    b = {(r.entry_id, r.pos): r.bin for r in every.filter("is_y = 0 and z = 1").collect()}
    y = {(r.entry_id, r.pos): r.bin for r in every.filter("is_y = 1 and z = 1").collect()}
    for (e, pos), x in b.items():
        n, mass = length[e]
        assert abs(x + y[e, n - pos] - (mass + 2 * PROTON_E8) / 1e6) <= 2


def test_variants(spark, entries):
    p = P.with_(mods=parse_mods("M:15.994915:2 STY:79.966331:1"))
    found = mods.variants(entries.filter("seq = 'MMSTYAVK'"), p).collect()
    assert len(found) == (1 + 2 + 1) * (1 + 3) - 1
    base = entries.filter("seq = 'MMSTYAVK'").first().mass_e8
    assert all(r.mass_e8 == base + sum(x.mass_e8 for x in r.mods) for r in found)
    with pytest.raises(Exception, match="variants"):
        mods.variants(entries, p, most_per_peptide=2).count()
    both = mods.with_variants(entries, p)
    assert both.count() == entries.count() + mods.variants(entries, p).count()
    plain = ion.fragments(entries, P, ("seq",)).select("seq", "is_y", "z", "pos", "bin")
    again = ion.fragments(mods.with_variants(entries, P), P, ("seq",)).select("seq", "is_y", "z", "pos", "bin")
    assert plain.exceptAll(again).count() == 0


def _self(entries, every=1):
    ions = ion.matchable(ion.fragments(entries, P), P)
    heads, peaks = spectra.from_fragments(ions, every)
    return heads, spectra.pick(peaks, P), ions


def test_self_search_finds_the_source(entries):
    heads, peaks, ions = _self(entries)
    found = search.candidates(heads, peaks, entries, P, ions)
    best = {r.spectrum_id: r.seq for r in score.top_one(found, heads, entries).collect()}
    seqs = {r.entry_id: r.seq for r in entries.collect()}
    twins = {"EANLER": "EANIER"}
    assert all(twins.get(best[i], best[i]) == twins.get(s, s) for i, s in seqs.items())


def test_open_and_closed_and_parts_agree(entries):
    heads, peaks, ions = _self(entries)
    wide = P.with_(dm=49.0)
    key = ("spectrum_id", "entry_id", "b_cnt", "y_cnt", "b_int", "y_int")
    closed = {tuple(r) for r in score.scorecard(match.fragment_join(heads, peaks, ions, wide)).select(*key).collect()}
    opened = {tuple(r) for r in score.scorecard(match.fragment_join(heads, peaks, ions, wide.with_(dm=51.0))).join(match.precursor_join(heads, entries, wide), ["spectrum_id", "entry_id"]).select(*key).collect()}
    assert closed == opened
    parts = [score.scorecard(match.fragment_join(heads, peaks, ions.filter(F.col("entry_id") % 3 == k), wide)) for k in range(3)]
    assert {tuple(r) for r in score.merged(parts[0].union(parts[1]).union(parts[2])).select(*key).collect()} == closed


def test_charge_gate(entries):
    heads, peaks, ions = _self(entries)
    gated = match.fragment_join(heads, peaks, ions, P.with_(match_charge=True)).count()
    assert 0 < gated < match.fragment_join(heads, peaks, ions, P).count()


def test_pick_forms_agree_and_keep_bounds(spark):
    raw = [("a.ms2", i, i, 2, 700.0, 0.0, [{"mz": 100.0 + k * 1.37, "intensity": float((k * 37 + i) % 91 + 1)} for k in range(n)], {}) for i, n in enumerate([0, 1, 99, 100, 150])]
    df = spark.createDataFrame(raw, ms2.SCHEMA)
    arrays = {r.ordinal: [(p.bin, p.intensity) for p in r.peaks] for r in spectra.picked_arrays(df, P).collect()}
    flat = df.select(F.col("ordinal").alias("spectrum_id"), F.explode("peaks").alias("p")).select("spectrum_id", "p.mz", "p.intensity")
    rows: dict = {}
    for r in spectra.pick(spectra.integer_peaks(flat, P), P).collect():
        rows.setdefault(r.spectrum_id, []).append((r.bin, r.intensity))
    for i, peaks in arrays.items():
        assert sorted(peaks) == sorted(rows.get(i, []))
        assert len(peaks) <= 100 and (not peaks or max(x for _, x in peaks) == P.base) and all(x >= P.min_intensity for _, x in peaks)


MS2 = "H\tmade\tby hand\nS\t7\t7\t500.5\nI\tRTime\t1.5\nI\tNote\tx y\nZ\t3\t1498.2\r\n100.5 10\n200.25 20.5\n\nS\t8\t8\t1\nD\tskip\nZ\t0\nS\t9\t9\t1\nI\tRTime\t-4\n300 1"


def test_ms2_grammar():
    rows = list(ms2.parse(MS2.splitlines(), "f"))
    assert [(r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows] == [(0, 7, 3, 1498.2, 1.5, [(100.5, 10.0), (200.25, 20.5)]), (1, 8, 1, 0.01, 0.0, []), (2, 9, 1, 0.01, 0.0, [(300.0, 1.0)])]
    assert rows[0][7]["Note"] == "x y"
    assert list(ms2.parse(["H only"], "f")) == []
    with pytest.raises(ValueError, match="f:2"):
        list(ms2.parse(["S 1 1 1", "abc def"], "f"))


def test_ms2_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ms2").write_text(MS2)
    (tmp_path / "in" / "skip.txt").write_text("x")
    spark.dataSource.register(ms2.MS2DataSource)
    got = spark.read.format("ms2").load(str(tmp_path / "in"))
    key = lambda df: sorted((r.file, r.ordinal, r.scan, r.charge, r.prec_mass, r.rtime, len(r.peaks)) for r in df.collect())
    assert key(got) == key(ms2.read(spark, str(tmp_path / "in")))
    assert spectra.file_summary(got).first().asDict() == {"file": "a.ms2", "n_spectra": 3, "max_peaks": 2, "n_batches": 1, "first_batch": 0}
    ms2.write(ms2.extract(got, [0, 2]), f"file://{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.ms2"]
    again = spark.read.format("ms2").load(f"file://{tmp_path}/out").orderBy("ordinal").collect()
    assert [[tuple(x) for x in r.peaks] for r in again] == [[(100.5, 10.0), (200.25, 20.5)], [(300.0, 1.0)]]
    more = got.withColumn("file", F.when(F.col("ordinal") == 1, F.lit("b")).when(F.col("ordinal") == 2, F.lit("x/c.ms2")))
    ms2.write(more, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["b.ms2", "c.ms2", "unnamed.ms2"]
    assert key(spark.read.format("ms2").load(str(tmp_path / "out")).drop("file").withColumn("file", F.lit(""))) == key(got.withColumn("file", F.lit("")).withColumn("ordinal", F.lit(0)))
    (tmp_path / "none").mkdir()
    assert spark.read.format("ms2").load(str(tmp_path / "none")).count() == 0
    cached = index.cached_spectra(spark, got, f"file://{tmp_path}/cache", P, ["a.ms2"])
    assert cached.count() == 3
    assert index.cached_spectra(spark, got.filter("false"), f"file://{tmp_path}/cache", P, ["a.ms2"]).count() == 3


def test_stream_and_report(spark, tmp_path, entries):
    heads, peaks, ions = _self(entries)
    by: dict = {}
    for r in peaks.collect():
        by.setdefault(r.spectrum_id, []).append(f"{(r.bin + 0.5) / 100} {r.intensity}")
    mass = {r.entry_id: r.mass_e8 / 1e8 for r in entries.collect()}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ms2").write_text("".join(f"S\t{i}\t{i}\t1\nZ\t2\t{mass[i]}\n" + "\n".join(v) + "\n" for i, v in sorted(by.items())))
    got = []
    q = search_stream(spark, str(tmp_path / "in"), entries, P.with_(expect_max=1e9), lambda df, _: got.extend(df.collect()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert q.exception() is None
    rows = spark.createDataFrame([("f", 1, 1.0, 2, 0.5, "ACK", 3, 9, 1.0, 0.0, "", 2.5, 0.25, 4)], tables.REPORT_SCHEMA)
    tables.write_report(rows, f"file://{tmp_path}/r1")
    tables.write_report(rows, f"file://{tmp_path}/r2")
    tables.merge_reports(spark, [f"file://{tmp_path}/r1", f"file://{tmp_path}/r2"], f"file://{tmp_path}/all")
    assert tables.read_report(spark, f"file://{tmp_path}/all").count() == 2


def test_peptide_files(spark, tmp_path):
    (tmp_path / "7.peps").write_text(">x\nsamplek\r\n\nPEPTIDEK\n")
    assert [r.seq for r in tables.read_peptides(spark, str(tmp_path), 6, 7).collect()] == ["SAMPLEK"]
    (tmp_path / "p.fasta").write_text(">one first\nACD\nEFK\n>two\nGGR\n")
    assert {r.id: r.seq for r in tables.read_fasta(spark, str(tmp_path / "p.fasta")).collect()} == {"one": "ACDEFK", "two": "GGR"}


def test_index_and_estimate(spark, entries):
    spark.sql("DROP TABLE IF EXISTS ion_index")
    stored = index.save(entries, P, "ion_index", 4)
    assert stored.count() == ion.matchable(ion.fragments(entries, P), P).count()
    row = index.estimate(entries, P.with_(mods=parse_mods("M:15.99:2"))).first()
    assert row.peptides == entries.count() and row.spectra == row.peptides + row.variants
    assert index.shuffle_partitions(10**9) == 239
    spark.sql("DROP TABLE ion_index")


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT peptide_mass('ACK') AS m, round(hyperscore(3L, 2L, 100L, 200L), 6) AS h, fragment_bin(10000000000L, 1, 100) AS b, expect_tailfit(array(1, 2, 3, 9), array(50L, 20L, 5L, 1L), 76L, 9) AS e").first()
    assert row.m == WATER_E8 + sum(MASS_E8[c] for c in "ACK") and row.b == 10100
    assert row.e > 0


def test_command_line(spark, tmp_path, entries):
    from spectraloom import cli

    heads, peaks, _ = _self(entries)
    by: dict = {}
    for r in peaks.collect():
        by.setdefault(r.spectrum_id, []).append(f"{(r.bin + 0.5) / 100} {r.intensity}")
    mass = {r.entry_id: r.mass_e8 / 1e8 for r in entries.collect()}
    (tmp_path / "pep").mkdir(), (tmp_path / "ms2").mkdir()
    (tmp_path / "pep" / "all.peps").write_text("\n".join(SEQS))
    (tmp_path / "ms2" / "a.ms2").write_text("".join(f"S\t{i}\t{i}\t1\nZ\t2\t{mass[i]}\n" + "\n".join(v) + "\n" for i, v in sorted(by.items())))
    args = ["--peptides", str(tmp_path / "pep"), "--min-hits", "1", "--dm", "300", "--expect-max", "1e12", "--mods", "M:15.99:1"]
    cli.main(["estimate", *args])
    cli.main(["search", *args, "--spectra", str(tmp_path / "ms2"), "--out", f"file://{tmp_path}/out"])
    rows = tables.read_report(spark, f"file://{tmp_path}/out").collect()
    assert all(r.file == "a.ms2" and r.peptide in SEQS for r in rows)
    assert cli.params_of(cli.parser().parse_args(["estimate", "--peptides", "x", "--policy", "chunk"])).policy.value == "chunk"


def test_partition_policies_invert(spark):
    from spectraloom.operators.distribute import global_id, owner, split_dataset
    from spectraloom.params import Policy

    rows = spark.range(23).withColumnRenamed("id", "k")
    for policy in Policy:
        parts: dict = {}
        for r in rows.select("k", owner(policy, "k", 4, 23).alias("p")).orderBy("k").collect():
            parts.setdefault(r.p, []).append(r.k)
        flat = [(p, i, k) for p, ks in parts.items() for i, k in enumerate(ks)]
        back = spark.createDataFrame(flat, "p int, i long, k long").select("k", global_id(policy, "i", "p", 4, 23).alias("g")).collect()
        assert all(r.k == r.g for r in back) and sorted(k for _, _, k in flat) == list(range(23))
    assert split_dataset(rows, "k", 3).count() == 23


def test_ion_dumps(spark, tmp_path, entries):
    ions = ion.matchable(ion.fragments(entries, P), P)
    tables.write_ions(ions, f"file://{tmp_path}/csv")
    tables.write_ions_libsvm(ions, f"file://{tmp_path}/svm")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == ions.count()
    lines = spark.read.text(f"file://{tmp_path}/svm").collect()
    assert len(lines) == entries.count()
    bins = [int(x.split(":")[0]) for x in lines[0].value.split()[1:]]
    assert bins == sorted(set(bins))


def test_stream_reads_files_that_come_late(spark, tmp_path):
    """A file whose name is before that of one already read."""
    spark.dataSource.register(ms2.MS2DataSource)
    folder = tmp_path / "in"
    folder.mkdir()
    seen: list = []
    for name in ("m.ms2", "a.ms2", None):
        if name:
            (folder / name).write_text(MS2)
        raw = spark.readStream.format("ms2").load(str(folder))
        sink = lambda rows, i: seen.extend(r.file for r in rows.collect())
        raw.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert seen == ["m.ms2"] * 3 + ["a.ms2"] * 3


def test_offsets_are_a_running_sum(spark):
    rows = [(k, n) for k, n in zip(["", "A", "AAA", "AAAA", "AAB", "B", "BA"], range(1, 8), strict=True)]
    got = {r.k: r.first for r in mods.offsets(spark.createDataFrame(rows[::-1], "k string, n long"), "k", "n").collect()}
    assert got == {k: sum(n for j, n in rows if j < k) for k, _ in rows}


def test_protonated_precursors(spark):
    raw = spark.createDataFrame([("a.ms2", 0, 1, 2, 700.5, 0.0, [{"mz": 100.0, "intensity": 5.0}], {})], ms2.SCHEMA)
    plain, mh = (exploded(spectra.picked_arrays(spectra.with_defaults(raw), q), q)[0].first().prec_e8 for q in (P, P.with_(precursor_is_mh=True)))
    assert plain == 70_050_000_000 and plain - mh == PROTON_E8
