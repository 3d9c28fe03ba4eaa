"""The engine's queries over the driver tables, each with DuckDB SQL for the same rows.

Proteins are the letters of ``documents.text``; every 20th peptide gives a
spectrum; ``lineitem`` gives wild spectra, ``events`` value series.
"""

from __future__ import annotations

import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.chem import LETTERS, MASS_E8, PROTON_E8, UNIT, WATER_E8
from spectraloom.memory import ease
from spectraloom.operators import cards, distribute, expect, match, mods, peptides, score, series, spectra, vectors
from spectraloom.operators import ions as ion
from spectraloom.params import ModSpec, Policy, SearchParams, parse_mods
from spectraloom.plans import index, search
from spectraloom.sources import ms2, tables

P = SearchParams()
MODS = SearchParams(mods=parse_mods("M:15.994915:2 STY:79.966331:1"))
_PARTS = 7

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, dealt to all cores if its files have fewer splits than there are cores (a table of that size is small)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table == "documents" and df.rdd.getNumPartitions() < cores else df


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of spark.checkpoint.dir; a local one only where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/spectraloom-engine"
    return f"{root}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _stored(df: DataFrame) -> DataFrame:
    path = _scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    ease(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pieces(spark, sf_dir):
    return peptides.digest(peptides.clean(_read(spark, sf_dir, "documents")))


def _peps(spark, sf_dir):
    return peptides.peptides(_pieces(spark, sf_dir), P)


def _entries(spark, sf_dir):
    return peptides.from_proteins(_read(spark, sf_dir, "documents"), P)


def _ions(spark, sf_dir):
    return ion.matchable(ion.fragments(_entries(spark, sf_dir), P), P)


def _self(spark, sf_dir):
    """(spectra, picked peaks, entries, ladders); what several branches read is stored, so that no plan holds another's."""
    entries = _stored(peptides.entries(_stored(_peps(spark, sf_dir))))
    some = ion.matchable(ion.fragments(entries.filter("entry_id % 20 = 0"), P), P)
    heads, peaks = spectra.from_fragments(some)
    return _stored(heads), spectra.pick(peaks, P), entries, ion.ladders(entries, P)


def _cards(spark, sf_dir, p=P.with_(min_shared=1)):
    heads, peaks, entries, ladders = _self(spark, sf_dir)
    return cards.closed_cards(heads, peaks, ladders, entries, p)


def _scored(spark, sf_dir, best=1):
    """(spectra, entries, histogram of all candidates, candidates that may be among the best)."""
    heads, peaks, entries, ladders = _self(spark, sf_dir)
    rows = _stored(cards.closed_search(heads, peaks, ladders, entries, P, best))
    return heads, entries, cards.histogram_of(rows), score.candidates(cards.candidates_of(rows), P)


def _best(spark, sf_dir):
    heads, entries, hist, found = _scored(spark, sf_dir)
    hist = _stored(hist)
    best = score.top_one(found, heads, entries, hist).filter(F.col("num_hits") >= P.min_hits)
    return heads, entries, hist, _stored(best)


def _wild(spark, sf_dir):
    """Peaks of orders: spectrum_id, mz, intensity."""
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spectrum_id"), (F.col("l_extendedprice") / 40).alias("mz"), F.col("l_quantity").alias("intensity"))


# --- SQL of the shared parts ---------------------------------------------------

_MASS = "CASE c " + " ".join(f"WHEN '{a}' THEN {m}" for a, m in MASS_E8.items()) + " ELSE -2000000000000 END"
_LIST = f"list_transform(string_split(seq, ''), lambda c: {_MASS})"
_SQL = {
    "proteins": "SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents",
    "cut": r"SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(seq, '([KR])', '\1_', 'g'), '_P', 'P', 'g'), '_'), lambda x: x <> '') AS p FROM proteins",
    "pieces": "SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS idx, unnest(p) AS seq FROM cut",
    "peps": f"""SELECT * FROM (SELECT seq, CAST(length(seq) AS INTEGER) AS len, CAST(list_sum({_LIST}) + {WATER_E8} AS BIGINT) AS mass_e8
                FROM (SELECT DISTINCT seq FROM pieces WHERE length(seq) BETWEEN 6 AND 40 AND regexp_full_match(seq, '[{LETTERS}]+')))
                WHERE mass_e8 BETWEEN {P.min_mass_e8} AND {P.max_mass_e8}""",
    "entries": "SELECT row_number() OVER (ORDER BY len, mass_e8, seq) AS entry_id, seq, len, mass_e8 FROM peps",
    "masses": f"SELECT entry_id, mass_e8, len, {_LIST} AS m FROM entries",
    "cuts": "SELECT entry_id, mass_e8, len, m, unnest(range(1, len)) AS pos FROM masses",
    "frags": f"""SELECT entry_id, mass_e8, pos, 0 AS is_y, CAST(list_sum(m[1:pos]) AS BIGINT) AS f FROM cuts
                 UNION ALL SELECT entry_id, mass_e8, pos, 1, CAST(list_sum(m[len - pos + 1:len]) + {WATER_E8} AS BIGINT) FROM cuts""",
    "ions": f"""SELECT entry_id, mass_e8, is_y, z, CAST(pos AS INTEGER) AS pos, CAST(((f + z * {PROTON_E8}) * 100) // (z * {UNIT}) AS INTEGER) AS bin
                FROM frags, (VALUES (1), (2), (3)) AS zs(z) WHERE ((f + z * {PROTON_E8}) * 100) // (z * {UNIT}) < {P.top_bin}""",
    "raw": "SELECT DISTINCT entry_id AS spectrum_id, bin, (1000 + (CAST(bin AS BIGINT) * 7919) % 99000) * 100 AS intensity FROM ions WHERE entry_id % 20 = 0",
    "heads": "SELECT entry_id AS spectrum_id, any_value(mass_e8) AS prec_e8 FROM ions WHERE entry_id % 20 = 0 GROUP BY 1",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, bin) AS k, max(intensity) OVER (PARTITION BY spectrum_id) AS top FROM raw",
    "picked": f"SELECT spectrum_id, bin, (intensity * {P.base}) // top AS intensity FROM ranked WHERE k <= 100 AND (intensity * {P.base}) // top >= {P.min_intensity}",
    "probes": f"SELECT spectrum_id, prec_e8, intensity, unnest(range(bin - 2, bin + 3)) AS bin FROM picked JOIN heads USING (spectrum_id) WHERE bin > 2 AND bin < {P.top_bin - 2}",
    "matches": f"SELECT spectrum_id, entry_id, is_y, intensity, z FROM probes q JOIN ions i ON q.bin = i.bin AND abs(prec_e8 - mass_e8) <= {P.dm_e8}",
    "cards": """SELECT spectrum_id, entry_id, CAST(sum(1 - is_y) AS BIGINT) AS b_cnt, CAST(sum(is_y) AS BIGINT) AS y_cnt,
                CAST(sum((1 - is_y) * intensity) AS BIGINT) AS b_int, CAST(sum(is_y * intensity) AS BIGINT) AS y_int FROM matches GROUP BY ALL""",
    "scored": """SELECT *, b_cnt + y_cnt AS shared, round(least(79.0, coalesce(list_sum(list_transform(range(1, b_cnt + 1), lambda x: log10(x))), 0)
                 + coalesce(list_sum(list_transform(range(1, y_cnt + 1), lambda x: log10(x))), 0) + log10(b_int + 1) + log10(y_int + 1) - 4), 6) AS hyperscore FROM cards""",
    "found": "SELECT * FROM scored WHERE shared >= 4 AND hyperscore > 0",
    "hist": "SELECT spectrum_id, CAST(floor(hyperscore * 10 + 0.5) AS INTEGER) AS hbin, count(*) AS n FROM found GROUP BY ALL",
    "order_": """SELECT f.*, e.seq, e.mass_e8, h.prec_e8, count(*) OVER (PARTITION BY spectrum_id) AS num_hits, CAST(row_number() OVER (PARTITION BY spectrum_id
                ORDER BY hyperscore DESC, shared DESC, abs(prec_e8 - e.mass_e8), seq, entry_id) AS INTEGER) AS rank FROM found f JOIN heads h USING (spectrum_id) JOIN entries e USING (entry_id)""",
    "best": f"SELECT * FROM order_ WHERE rank = 1 AND num_hits >= {P.min_hits}",
    "tops": "SELECT spectrum_id, CAST(floor(hyperscore * 10 + 0.5) AS INTEGER) AS top, num_hits AS hits FROM best WHERE floor(hyperscore * 10 + 0.5) > 0",
    "span0": """SELECT spectrum_id, top, hits, coalesce(min(CASE WHEN hbin < top THEN hbin END), 0) AS lo, coalesce(max(CASE WHEN hbin < top THEN hbin END), top - 1) AS hi
                FROM tops JOIN hist USING (spectrum_id) WHERE hbin <= top GROUP BY spectrum_id, top, hits""",
    "bins": "SELECT spectrum_id, top, hits, lo, unnest(range(lo, CASE WHEN hi = lo THEN lo + 1 ELSE hi END + 1)) AS bin FROM span0",
    "curve": """SELECT spectrum_id, top, hits, bin, bin - lo AS i, CASE WHEN s > 1 THEN 0.999 ELSE s END AS s FROM (SELECT b.*,
                1 - sum(coalesce(n, 0)) OVER (PARTITION BY b.spectrum_id ORDER BY b.bin) / hits AS s FROM bins b LEFT JOIN hist h ON b.spectrum_id = h.spectrum_id AND b.bin = h.hbin)""",
    "logs": """SELECT *, log10(CASE WHEN s <= 0 THEN coalesce(max_by(s, CASE WHEN s >= 0.0001 THEN i END) OVER (PARTITION BY spectrum_id), max_by(s, i) OVER (PARTITION BY spectrum_id)) ELSE s END) AS l,
               max(i) OVER (PARTITION BY spectrum_id) AS last FROM curve""",
    "ends": "SELECT *, min_by(l, i) OVER (PARTITION BY spectrum_id) AS l0, max_by(l, i) OVER (PARTITION BY spectrum_id) - min_by(l, i) OVER (PARTITION BY spectrum_id) AS height FROM logs",
    "marks0": """SELECT *, CASE WHEN last >= 2 THEN coalesce(min(CASE WHEN l <= l0 + 0.22 * height THEN i END) OVER (PARTITION BY spectrum_id), 0) - 1 ELSE 0 END AS a,
                 CASE WHEN last > 2 THEN coalesce(max(CASE WHEN l >= l0 + 0.87 * height THEN i END) OVER (PARTITION BY spectrum_id), last) ELSE last END AS z FROM ends""",
    "marks": "SELECT *, greatest(0, CASE WHEN last > 2 AND a >= z THEN z - 1 ELSE a END) AS mark FROM marks0",
    "fit": """SELECT spectrum_id, top, hits, CASE WHEN count(*) = 1 THEN 0.0 ELSE regr_slope(l, bin) END AS slope, CASE WHEN count(*) = 1 THEN avg(l) ELSE regr_intercept(l, bin) END AS intercept
              FROM marks WHERE i BETWEEN mark AND z GROUP BY ALL""",
    "expects": "SELECT spectrum_id, hits * pow(10.0, slope * top + intercept) AS expect FROM fit",
}


def _sql(select: str) -> str:
    """``select`` with the shared parts that it needs, directly or not."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(_SQL[name])

    visit(select)
    parts = ", ".join(f"{n} AS ({_SQL[n]})" for n in _SQL if n in needed)
    return f"WITH {parts} {select}" if parts else select


# --- peptides -------------------------------------------------------------------


@query(_sql("SELECT * FROM proteins"))
def peptide_clean(spark, sf_dir):
    return peptides.clean(_read(spark, sf_dir, "documents"))


@query(_sql("SELECT * FROM pieces"))
def peptide_digest(spark, sf_dir):
    return _pieces(spark, sf_dir)


@query(_sql("""SELECT doc_id, CAST(i AS INTEGER) AS idx, CAST(mc AS INTEGER) AS missed, array_to_string(p[i + 1:i + mc + 1], '') AS seq
               FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM cut), range(0, 3) AS r(mc)
               WHERE i + mc < len(p) AND length(array_to_string(p[i + 1:i + mc + 1], '')) BETWEEN 6 AND 40"""))
def peptide_missed_cleavage(spark, sf_dir):
    return peptides.missed_cleavages(peptides.clean(_read(spark, sf_dir, "documents")), 2, min_length=6, max_length=40)


@query(_sql("SELECT DISTINCT seq FROM pieces WHERE length(seq) BETWEEN 6 AND 40"))
def peptide_distinct(spark, sf_dir):
    return _pieces(spark, sf_dir).select("seq").filter(F.length("seq").between(6, 40)).distinct()


@query(_sql("SELECT seq, translate(seq, 'KL', 'LK') AS collation FROM peps"))
def peptide_collation(spark, sf_dir):
    return peptides.collated(_peps(spark, sf_dir))


@query(_sql(f"SELECT seq, CAST(list_sum({_LIST}) + {WATER_E8} AS BIGINT) AS mass_e8 FROM (SELECT DISTINCT seq FROM pieces WHERE length(seq) <= 60)"))
def peptide_mass(spark, sf_dir):
    from spectraloom.functions.peptide import peptide_mass as mass

    return _pieces(spark, sf_dir).select("seq").filter(F.length("seq") <= 60).distinct().select("seq", mass(F.col("seq")).alias("mass_e8"))


@query(_sql("SELECT * FROM entries"))
def peptide_mass_filter(spark, sf_dir):
    return _entries(spark, sf_dir)


@query(_sql("SELECT len, count(*) AS n, min(mass_e8) AS lightest, max(mass_e8) AS heaviest FROM peps GROUP BY len"))
def peptide_by_length(spark, sf_dir):
    return _peps(spark, sf_dir).groupBy("len").agg(F.count("*").alias("n"), F.min("mass_e8").alias("lightest"), F.max("mass_e8").alias("heaviest"))


@query(_sql("SELECT right(seq, 1) AS terminus, count(*) AS n FROM peps WHERE right(seq, 1) IN ('K', 'R') GROUP BY 1"))
def peptide_terminus(spark, sf_dir):
    found = _peps(spark, sf_dir)
    both = peptides.by_terminus(found, "K").unionByName(peptides.by_terminus(found, "R"))
    return both.groupBy(F.right("seq", F.lit(1)).alias("terminus")).agg(F.count("*").alias("n"))


# --- fragments ------------------------------------------------------------------


@query(_sql("SELECT * FROM ions"))
def fragment_ions(spark, sf_dir):
    return _ions(spark, sf_dir)


@query(_sql("SELECT len, count(*) AS n_ions FROM ions JOIN entries USING (entry_id) GROUP BY len"))
def fragment_ion_counts(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    ions = ion.matchable(ion.fragments(entries, P, ("entry_id", "len")), P)
    return ions.groupBy("len").agg(F.count("*").alias("n_ions"))


@query(_sql("SELECT bin, count(*) AS n FROM ions GROUP BY bin"))
def ion_bin_histogram(spark, sf_dir):
    return ion.bin_histogram(_ions(spark, sf_dir))


@query(_sql("SELECT bin, n, CAST(coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT bin, count(*) AS n FROM ions GROUP BY bin)"))
def ion_bin_offsets(spark, sf_dir):
    return ion.bin_offsets(_ions(spark, sf_dir))


@query(_sql("SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM (SELECT bin, count(*) AS n FROM ions GROUP BY bin)"))
def ion_occupancy(spark, sf_dir):
    return ion.occupancy(_ions(spark, sf_dir)).select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(_sql("SELECT len, pos, count(*) AS n_ions, count(DISTINCT bin) AS n_bins FROM ions JOIN entries USING (entry_id) WHERE is_y = 0 AND z = 1 GROUP BY ALL"))
def position_uniqueness(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return ion.position_uniqueness(ion.matchable(ion.fragments(entries, P), P), entries)


@query(_sql("""SELECT len, max(n) AS most, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n >= 10) AS frequent
               FROM (SELECT len, bin, count(*) AS n FROM ions JOIN entries USING (entry_id) GROUP BY ALL) GROUP BY len"""))
def feature_frequency(spark, sf_dir):
    ions = ion.matchable(ion.fragments(_entries(spark, sf_dir), P, ("entry_id", "len")), P)
    by = ions.groupBy("len", "bin").agg(F.count("*").alias("n"))
    return by.groupBy("len").agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count_if(F.col("n") >= 10).alias("frequent"))


# --- modifications --------------------------------------------------------------

_M, _S = (m.mass_e8 for m in MODS.mods)
_NSITES = "len(regexp_extract_all(seq, '[M]')) AS m, len(regexp_extract_all(seq, '[STY]')) AS s"
_COUNT = f"SELECT seq, CAST((1 + m + m * (m - 1) // 2) * (1 + s) - 1 AS BIGINT) AS n FROM (SELECT seq, {_NSITES} FROM peps)"
_PLACED = f"""WITH sites AS (SELECT seq, mass_e8, seq[i] AS c, i FROM (SELECT seq, mass_e8, unnest(range(1, len + 1)) AS i FROM peps)),
    a AS (SELECT seq, mass_e8, []::BIGINT[] AS l, 0::BIGINT AS add_ FROM peps UNION ALL SELECT seq, mass_e8, [i * 10], {_M} FROM sites WHERE c = 'M'
          UNION ALL SELECT x.seq, x.mass_e8, [x.i * 10, y.i * 10], {2 * _M} FROM sites x JOIN sites y ON x.seq = y.seq AND x.i < y.i WHERE x.c = 'M' AND y.c = 'M'),
    b AS (SELECT seq, []::BIGINT[] AS l, 0::BIGINT AS add_ FROM peps UNION ALL SELECT seq, [i * 10 + 1], {_S} FROM sites WHERE c IN ('S', 'T', 'Y')),
    v AS (SELECT a.seq, a.mass_e8 + a.add_ + b.add_ AS mass_e8, list_sort(a.l || b.l) AS l FROM a JOIN b ON a.seq = b.seq WHERE len(a.l) + len(b.l) > 0),
    kept AS (SELECT seq, CAST(mass_e8 AS BIGINT) AS mass_e8, array_to_string(list_transform(l, lambda x: CAST(x // 10 AS VARCHAR) || ':' || CAST(x % 10 AS VARCHAR)), ';') AS mods, l FROM v
             WHERE mass_e8 BETWEEN {P.min_mass_e8} AND {P.max_mass_e8})"""  # fmt: skip


def _with_parts(sql: str, parts: str) -> str:
    """``sql`` (WITH …) after the shared parts that ``parts`` names."""
    return _sql(f"SELECT 1 FROM {parts}").removesuffix(f" SELECT 1 FROM {parts}") + ", " + sql.strip().removeprefix("WITH ")


def _mod_text(column="mods"):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["pos"].cast("string"), x["mod"].cast("string"))), ";")


@query(_sql(_COUNT))
def mod_count(spark, sf_dir):
    return _peps(spark, sf_dir).select("seq", mods.variant_count(F.col("seq"), MODS).alias("n"))


@query(_with_parts(_PLACED + " SELECT seq, mods, mass_e8 FROM kept", "peps"))
def mod_enumerate(spark, sf_dir):
    return mods.variants(_peps(spark, sf_dir), MODS).select("seq", _mod_text().alias("mods"), "mass_e8")


@query(_sql(f"SELECT seq, i AS pos, mass_e8 + {_M} AS mass_e8 FROM (SELECT seq, mass_e8, unnest(range(1, len + 1)) AS i FROM peps) WHERE seq[i] = 'M' AND mass_e8 + {_M} <= {P.max_mass_e8}"))
def mod_enumerate_single(spark, sf_dir):
    one = SearchParams(mods=(ModSpec("M", _M, 1),))
    return mods.variants(_peps(spark, sf_dir), one).select("seq", F.get("mods", F.lit(0))["pos"].cast("long").alias("pos"), "mass_e8")


@query(_with_parts(_PLACED + " SELECT seq, count(*) AS n, min(mass_e8) AS lightest, max(mass_e8) AS heaviest FROM kept GROUP BY seq", "peps"))
def mod_variant_mass(spark, sf_dir):
    return mods.variants(_peps(spark, sf_dir), MODS).groupBy("seq").agg(F.count("*").alias("n"), F.min("mass_e8").alias("lightest"), F.max("mass_e8").alias("heaviest"))


_VARIANT_IONS = (
    _PLACED
    + f""", m AS (SELECT seq, mods, mass_e8, list_transform(range(1, length(seq) + 1), lambda i: (CASE seq[i] {' '.join(f"WHEN '{a}' THEN {x}" for a, x in MASS_E8.items())} END)
    + CASE WHEN list_contains(l, i * 10) THEN {_M} WHEN list_contains(l, i * 10 + 1) THEN {_S} ELSE 0 END) AS w FROM kept),
    c AS (SELECT seq, mods, mass_e8, w, unnest(range(1, length(seq))) AS pos FROM m),
    f AS (SELECT seq, mods, mass_e8, 0 AS is_y, pos, list_sum(w[1:pos]) AS x FROM c UNION ALL SELECT seq, mods, mass_e8, 1, pos, list_sum(w[length(seq) - pos + 1:length(seq)]) + {WATER_E8} FROM c)
    SELECT seq, mods, mass_e8, is_y, z, CAST(pos AS INTEGER) AS pos, CAST(((x + z * {PROTON_E8}) * 100) // (z * {UNIT}) AS INTEGER) AS bin FROM f, (VALUES (1), (2), (3)) AS zs(z)"""
)


@query(_with_parts(_VARIANT_IONS, "peps"))
def mod_variant_ions(spark, sf_dir):
    every = mods.variants(_peps(spark, sf_dir), MODS)
    made = ion.fragments(every.withColumn("key", _mod_text()), P, ("seq", "key"))
    return made.withColumnRenamed("key", "mods")


@query(_sql(f"SELECT seq, n, CAST(coalesce(sum(n) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM ({_COUNT})"))
def mod_offsets(spark, sf_dir):
    return mods.offsets(mod_count(spark, sf_dir), "seq", "n")


# --- spectra --------------------------------------------------------------------

_WILD = """WITH raw AS (SELECT l_orderkey AS spectrum_id, CAST(floor(l_extendedprice / 40 * 100) AS INTEGER) AS bin, CAST(floor(l_quantity * 100) AS BIGINT) AS intensity FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, bin) AS k, max(intensity) OVER (PARTITION BY spectrum_id) AS top FROM raw)"""


@query(_WILD.split(",\n")[0] + " SELECT * FROM raw")
def peaks_binned(spark, sf_dir):
    return spectra.integer_peaks(_wild(spark, sf_dir), P)


@query(_WILD + f" SELECT spectrum_id, bin, (intensity * {P.base}) // top AS intensity FROM r WHERE k <= 3 AND (intensity * {P.base}) // top >= {P.min_intensity}")
def peaks_topn(spark, sf_dir):
    return spectra.pick(spectra.integer_peaks(_wild(spark, sf_dir), P), P.with_(top_peaks=3))


@query(_WILD + f" SELECT spectrum_id, bin, (intensity * {P.base}) // top AS intensity FROM r WHERE k <= 100 AND (intensity * {P.base}) // top >= {P.min_intensity}")
def peaks_normalise(spark, sf_dir):
    return spectra.pick(spectra.integer_peaks(_wild(spark, sf_dir), P), P)


@query("SELECT l_orderkey AS spectrum_id, count(*) AS n_peaks, max(l_quantity) AS max_intensity, sum(l_quantity) AS sum_intensity FROM lineitem GROUP BY 1")
def spectrum_summary(spark, sf_dir):
    return spectra.summary(_wild(spark, sf_dir))


@query("""SELECT f AS file, n AS n_batches, CAST(coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_batch
          FROM (SELECT l_orderkey % 16 AS f, CAST(ceil(count(DISTINCT l_orderkey) / 100) AS BIGINT) AS n FROM lineitem GROUP BY 1)""")
def batch_numbering(spark, sf_dir):
    by = _read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 16).alias("file")).agg(F.ceil(F.countDistinct("l_orderkey") / 100).alias("n_batches"))
    return spectra.batches(by, "file")


# --- joins and scores -----------------------------------------------------------


@query(_sql(f"SELECT h.spectrum_id, e.entry_id FROM heads h JOIN entries e ON e.mass_e8 BETWEEN prec_e8 - {P.dm_e8} AND prec_e8 + {P.dm_e8}"))
def precursor_band_join(spark, sf_dir):
    heads, _, entries, _ = _self(spark, sf_dir)
    return match.precursor_join(heads, entries, P)


@query(_sql("SELECT spectrum_id, entry_id, count(*) AS n, CAST(sum(intensity) AS BIGINT) AS total FROM matches GROUP BY ALL"))
def fragment_bin_join(spark, sf_dir):
    return _cards(spark, sf_dir).select("spectrum_id", "entry_id", F.expr("b_cnt + y_cnt").alias("n"), F.expr("b_int + y_int").alias("total"))


@query(_sql("SELECT spectrum_id, entry_id, count(*) AS n FROM matches WHERE z <= 2 GROUP BY ALL"))
def charge_gated_join(spark, sf_dir):
    return _cards(spark, sf_dir, P.with_(match_charge=True, min_shared=1)).select("spectrum_id", "entry_id", F.expr("b_cnt + y_cnt").alias("n"))


@query(_sql("SELECT * FROM cards"))
def scorecard(spark, sf_dir):
    return _cards(spark, sf_dir)


@query(_sql("SELECT spectrum_id, entry_id, hyperscore FROM scored WHERE hyperscore > 0 AND shared >= 1"))
def hyperscore(spark, sf_dir):
    return score.candidates(_cards(spark, sf_dir), P.with_(min_shared=1)).select("spectrum_id", "entry_id", "hyperscore")


@query(_sql("SELECT * FROM found"))
def candidate_filter(spark, sf_dir):
    return score.candidates(_cards(spark, sf_dir, P), P)


@query(_sql("SELECT * FROM hist"))
def score_histogram(spark, sf_dir):
    return _scored(spark, sf_dir)[2]


@query(_sql("SELECT spectrum_id, entry_id, seq, shared, hyperscore, num_hits FROM order_ WHERE rank = 1"))
def top_psm(spark, sf_dir):
    heads, entries, hist, found = _scored(spark, sf_dir)
    return score.top_one(found, heads, entries, hist).select("spectrum_id", "entry_id", "seq", "shared", "hyperscore", "num_hits")


@query(_sql("SELECT spectrum_id, rank, entry_id, hyperscore FROM order_ WHERE rank <= 5"))
def topk_psm(spark, sf_dir):
    heads, entries, _, found = _scored(spark, sf_dir, 5)
    return score.top_k(found, heads, entries, 5).select("spectrum_id", "rank", "entry_id", "hyperscore")


@query(_sql("SELECT * FROM cards"))
def partial_merge(spark, sf_dir):
    heads, peaks, entries, ladders = _self(spark, sf_dir)
    return cards.closed_cards(heads, peaks, [ladders.filter(F.col("entry_id") % 4 == k) for k in range(4)], entries, P.with_(min_shared=1))


# --- expect values --------------------------------------------------------------


@query(_sql("SELECT spectrum_id, CAST(bin AS INTEGER) AS bin, round(s, 6) AS s FROM curve"))
def survival_function(spark, sf_dir):
    _, _, hist, best = _best(spark, sf_dir)
    return expect.survival(hist, best).select("spectrum_id", "bin", F.round("s", 6).alias("s"))


@query(_sql("SELECT spectrum_id, round(slope, 4) AS slope, round(intercept, 4) AS intercept FROM fit"))
def tailfit_params(spark, sf_dir):
    _, _, hist, best = _best(spark, sf_dir)
    return expect.tail_parameters(expect.survival(hist, best)).select("spectrum_id", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(_sql("SELECT spectrum_id, round(log10(expect), 4) AS log_expect FROM expects WHERE NOT isnan(expect)"))
def expect_tailfit(spark, sf_dir):
    _, _, hist, best = _best(spark, sf_dir)
    return expect.tail_expect(hist, best).filter(~F.isnan("expect")).select("spectrum_id", F.round(F.log10("expect"), 4).alias("log_expect"))


_REPORT = f"""SELECT '' AS file, spectrum_id + 1 AS scan_num, round(prec_e8 / 1e8, 6) AS prec_mass, 2 AS charge, spectrum_id / 10 AS retention_time, seq AS peptide, shared AS matched_ions,
    CAST((length(seq) - 1) * {2 * P.max_charge} AS BIGINT) AS total_ions, round(mass_e8 / 1e8, 6) AS calc_pep_mass, round((prec_e8 - mass_e8) / 1e8, 6) AS mass_diff, '' AS mod_info,
    hyperscore, round(log10(expect), 4) AS log_expect, num_hits FROM best JOIN expects USING (spectrum_id) WHERE NOT isnan(expect) AND expect < {P.expect_max}"""


@query(_sql(_REPORT))
def psm_report(spark, sf_dir):
    heads, peaks, entries, ladders = _self(spark, sf_dir)
    rows = search.report(search.search(heads, peaks, entries, P, ladders, _stored), heads, P)
    return rows.withColumn("log_expect", F.round(F.log10("expectscore"), 4)).drop("expectscore")


@query()
def expect_gumbel(spark, sf_dir):
    _, _, hist, best = _best(spark, sf_dir)
    return expect.gumbel_expect(hist, best)


@query(_sql("SELECT spectrum_id, entry_id, seq, hyperscore FROM order_ WHERE rank = 1").replace(f"AND abs(prec_e8 - mass_e8) <= {P.dm_e8}", ""))
def open_search(spark, sf_dir):
    p = P.with_(dm=-1.0)
    heads, peaks, entries, _ = _self(spark, sf_dir)
    near = cards.open_cards(heads, peaks, ion.matchable(ion.fragments(entries, p), p), entries.count(), p, best=True)
    return score.top_k(_stored(score.candidates(near, p)), heads, entries, 1).select("spectrum_id", "entry_id", "seq", "hyperscore")


# --- series ---------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, value, lag(value, 2) OVER w AS a, lag(value, 1) OVER w AS b, lead(value, 1) OVER w AS c, lead(value, 2) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
          SELECT user_id, event_id, round(coalesce((-3 * a + 12 * b + 17 * value + 12 * c - 3 * d) / 35, value), 6) AS smooth, round((-2 * a - b + c + 2 * d) / 10, 6) AS slope FROM e""")
def savgol_smooth(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    rows = series.derivative_inner(series.savgol_inner(rows, "user_id", ["ts", "event_id"], "value"), "user_id", ["ts", "event_id"], "value")
    return rows.select("user_id", "event_id", F.round("smooth", 6).alias("smooth"), F.round("slope", 6).alias("slope"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
          h(user_id, k, level, trend) AS (SELECT user_id, k, value, 0.0::DOUBLE FROM o WHERE k = 1
            UNION ALL SELECT o.user_id, o.k, 0.5 * o.value + 0.5 * (level + trend), 0.3 * ((0.5 * o.value + 0.5 * (level + trend)) - level) + 0.7 * trend FROM h JOIN o ON o.user_id = h.user_id AND o.k = h.k + 1)
          SELECT user_id, k AS n, round(level, 6) AS level, round(trend, 6) AS trend, round(level + trend, 6) AS forecast FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def holt_forecast(spark, sf_dir):
    found = series.holt(_read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return found.select("user_id", "n", *(F.round(c, 6).alias(c) for c in ("level", "trend", "forecast")))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
          SELECT vec_id, round(list_sum(e), 4) AS total, round(list_dot_product(e, e), 4) AS dot, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS argmax,
          CAST(coalesce(list_position(list_transform(e, lambda x: x >= 0.1), true), 0) - 1 AS BIGINT) AS first_hit FROM v""")
def vector_reductions(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(vectors.total("e"), 4).alias("total"), F.round(vectors.dot("e", "e"), 4).alias("dot"), vectors.argmax("e").alias("argmax"), vectors.first_at_least("e", 0.1).alias("first_hit"))


# --- distribution and utilities -------------------------------------------------


@query(_sql(f"SELECT entry_id, CAST((entry_id - 1) % {_PARTS} AS INTEGER) AS part FROM entries"))
def distribute_cyclic(spark, sf_dir):
    return distribute.deal(_entries(spark, sf_dir), Policy.CYCLIC, "(entry_id - 1)", _PARTS).select("entry_id", "part")


@query(_sql(f"SELECT entry_id, CAST((entry_id - 1) // (((SELECT count(*) FROM entries) + {_PARTS - 1}) // {_PARTS}) AS INTEGER) AS part FROM entries"))
def distribute_chunk(spark, sf_dir):
    entries = _stored(_entries(spark, sf_dir))
    return distribute.deal(entries, Policy.CHUNK, "(entry_id - 1)", _PARTS, entries.count()).select("entry_id", "part")


@query(_sql(f"SELECT entry_id, CAST(CASE WHEN ((entry_id - 1) // {_PARTS}) % 2 = 0 THEN (entry_id - 1) % {_PARTS} ELSE {_PARTS - 1} - (entry_id - 1) % {_PARTS} END AS INTEGER) AS part FROM entries"))
def distribute_zigzag(spark, sf_dir):
    return distribute.deal(_entries(spark, sf_dir), Policy.ZIGZAG, "(entry_id - 1)", _PARTS).select("entry_id", "part")


@query(_sql(f"SELECT CAST((entry_id - 1) % {_PARTS} AS INTEGER) AS part, count(*) AS n FROM entries GROUP BY 1"))
def partition_sizes(spark, sf_dir):
    n = _entries(spark, sf_dir).count()
    return spark.createDataFrame(list(enumerate(distribute.sizes(_PARTS, n))), "part int, n long")


@query(_sql(f"""SELECT count(*) AS peptides, CAST(sum(n) AS BIGINT) AS variants, CAST(sum((len - 1) * {2 * P.max_charge} * (n + 1)) AS BIGINT) AS ions, CAST(count(*) + sum(n) AS BIGINT) AS spectra,
          round((sum((len - 1) * {2 * P.max_charge} * (n + 1)) * 4 + {P.max_mass} * 100 * 4) / 1048576, 6) AS index_mb FROM (SELECT seq, len, n FROM ({_COUNT}) JOIN peps USING (seq))"""))
def index_estimate(spark, sf_dir):
    return index.estimate(_peps(spark, sf_dir), MODS).withColumn("index_mb", F.round("index_mb", 6))


@query(_sql("SELECT seq, len FROM peps"))
def union_partials(spark, sf_dir):
    found = _stored(_peps(spark, sf_dir).select("seq", "len"))
    return functools.reduce(DataFrame.unionByName, [found.filter(F.col("len") % 3 == k) for k in range(3)])


@query("SELECT l_orderkey AS ordinal, count(*) AS n_peaks FROM lineitem WHERE l_orderkey IN (1, 2, 3, 5, 8, 13, 21) GROUP BY 1")
def spectrum_extract(spark, sf_dir):
    raw = _wild(spark, sf_dir).groupBy(F.col("spectrum_id").alias("ordinal")).agg(F.count("*").alias("n_peaks"))
    return ms2.extract(raw, [1, 2, 3, 5, 8, 13, 21])


@query(_sql("SELECT seq, len, mass_e8 FROM peps QUALIFY row_number() OVER (PARTITION BY len ORDER BY (mass_e8 * 31 + 1) % 1000003, seq) <= 3"))
def sample_per_length(spark, sf_dir):
    return peptides.sample_per_length(_peps(spark, sf_dir), 3)


def _raw_wild(spark, sf_dir):
    """Wild spectra in the schema of the MS2 source; the id gives file and ordinal."""
    peaks = F.sort_array(F.collect_list(F.struct(F.round("mz", 4).alias("mz"), "intensity"))).alias("peaks")
    rows = _wild(spark, sf_dir).groupBy("spectrum_id").agg(peaks)
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spectrum_id"), F.round(500 + F.col("o_totalprice") % 4500, 4).alias("prec_mass"))
    rows = rows.join(orders, "spectrum_id")
    return rows.select(F.concat(F.lit("part"), F.col("spectrum_id") % 4, F.lit(".ms2")).alias("file"), F.col("spectrum_id").alias("ordinal"), F.col("spectrum_id").cast("int").alias("scan"), F.lit(2).alias("charge"), "prec_mass", F.lit(0.5).alias("rtime"), "peaks")


@query("SELECT l_orderkey AS scan, 2 AS charge, count(*) AS n_peaks, round(sum(l_quantity), 2) AS intensity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def ms2_roundtrip(spark, sf_dir):
    path = _scratch(spark)
    ms2.write(_raw_wild(spark, sf_dir), path)
    spark.dataSource.register(ms2.MS2DataSource)
    found = spark.read.format("ms2").load(path)
    intensity = F.round(F.aggregate("peaks", F.lit(0.0), lambda s, x: s + x["intensity"]), 2)
    return found.select(F.col("scan").cast("long").alias("scan"), "charge", F.size("peaks").cast("long").alias("n_peaks"), intensity.alias("intensity"))


@query("SELECT f AS file, count(*) AS n_spectra, CAST(max(n) AS INTEGER) AS max_peaks FROM (SELECT 'part' || (l_orderkey % 4) || '.ms2' AS f, l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1")
def file_summary(spark, sf_dir):
    return spectra.file_summary(_raw_wild(spark, sf_dir)).select("file", "n_spectra", "max_peaks")


@query("SELECT count(*) AS n, CAST(sum(n_peaks) AS BIGINT) AS peaks FROM (SELECT l_orderkey, count(*) AS n_peaks FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)")
def spectra_cache(spark, sf_dir):
    picked = spectra.picked_arrays(spectra.with_defaults(_raw_wild(spark, sf_dir)), P)
    return _stored(picked).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("peaks")), F.lit(0)).cast("long").alias("peaks"))


@query(_sql("SELECT seq FROM peps"))
def peptide_parts(spark, sf_dir):
    path = _scratch(spark)
    tables.write_peptides(_peps(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("seq"))


@query(_sql("SELECT spectrum_id + 1 AS scan_num, seq AS peptide, hyperscore, num_hits FROM best JOIN expects USING (spectrum_id) WHERE NOT isnan(expect) AND expect < 20"))
def report_roundtrip(spark, sf_dir):
    heads, peaks, entries, ladders = _self(spark, sf_dir)
    path = _scratch(spark)
    tables.write_report(search.report(search.search(heads, peaks, entries, P, ladders, _stored), heads, P), path)
    return tables.read_report(spark, path).select("scan_num", "peptide", "hyperscore", "num_hits")


def clear_scratch(spark: SparkSession) -> None:
    """Delete the local scratch folder of tests."""
    shutil.rmtree(f"{tempfile.gettempdir()}/spectraloom-engine", ignore_errors=True)

