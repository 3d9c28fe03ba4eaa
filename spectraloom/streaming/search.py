"""Searching spectra as their files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spectraloom.chem import PROTON_E8
from spectraloom.operators.spectra import picked_arrays, with_defaults
from spectraloom.params import SearchParams
from spectraloom.plans.search import report, search
from spectraloom.sources.ms2 import MS2DataSource


def exploded(picked: DataFrame, p: SearchParams) -> tuple[DataFrame, DataFrame]:
    """(spectra, peaks) of picked rows; a spectrum's id comes from its file and ordinal.

    With ``precursor_is_mh`` the masses of the files hold one proton, which is taken off.
    """
    proton = PROTON_E8 if p.precursor_is_mh else 0
    rows = picked.withColumn("spectrum_id", F.xxhash64("file", "ordinal")).withColumn("prec_e8", F.round(F.col("prec_mass") * 1e8).cast("long") - proton)
    peaks = rows.select("spectrum_id", F.explode("peaks").alias("p")).select("spectrum_id", "p.bin", "p.intensity")
    return rows.select("spectrum_id", "prec_e8", "charge", "rtime", "file", "ordinal"), peaks


def search_stream(spark: SparkSession, folder: str, entries: DataFrame, p: SearchParams, sink: Callable[[DataFrame, int], None], checkpoint: str, ions: DataFrame | None = None) -> StreamingQuery:
    """A query that searches each batch of new files and gives its report rows to ``sink(rows, batch_id)``.

    Spectra are independent, so no state is kept between batches.
    """
    spark.dataSource.register(MS2DataSource)
    raw = spark.readStream.format("ms2").load(folder)

    def batch(rows: DataFrame, batch_id: int) -> None:
        spectra, peaks = exploded(picked_arrays(with_defaults(rows), p), p)
        found = search(spectra, peaks, entries, p, ions)
        sink(report(found, spectra, p), batch_id)

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
