"""Command line: ``python -m spectraloom.cli search|estimate|merge …`` (submit it with spark-submit on a cluster)."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from spectraloom.operators.mods import mod_info, with_variants
from spectraloom.operators.peptides import entries, legal, peptides
from spectraloom.operators.spectra import picked_arrays, with_defaults
from spectraloom.params import Policy, SearchParams, parse_mods
from spectraloom.plans import index
from spectraloom.plans.search import report, search
from spectraloom.sources import ms2, tables
from spectraloom.streaming.search import exploded


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spectraloom")
    jobs = top.add_subparsers(dest="job", required=True)
    for job in ("search", "estimate"):
        p = jobs.add_parser(job)
        p.add_argument("--peptides", required=True, help="folder of .peps parts")
        p.add_argument("--params", help="file of key=value lines")
        if job == "search":
            p.add_argument("--spectra", required=True, help="folder of .ms2 files")
            p.add_argument("--out", required=True, help="folder of the report")
        for f in fields(SearchParams):
            name = "--" + f.name.replace("_", "-")
            if isinstance(f.default, bool):
                p.add_argument(name, action="store_true", default=None)
            elif f.name in ("mods", "policy"):
                p.add_argument(name)
            else:
                p.add_argument(name, type=type(f.default))
    m = jobs.add_parser("merge")
    m.add_argument("reports", nargs="+")
    m.add_argument("--out", required=True)
    return top


def params_of(args: argparse.Namespace) -> SearchParams:
    """The file's parameters, changed by the options that are given."""
    p = SearchParams.from_file(args.params) if args.params else SearchParams()
    given = {f.name: v for f in fields(SearchParams) if (v := getattr(args, f.name, None)) is not None}
    if "mods" in given:
        given["mods"] = parse_mods(given["mods"], p.scale if given.get("quantise_mod_mass", p.quantise_mod_mass) else None)
    if "policy" in given:
        given["policy"] = Policy(given["policy"].lower())
    return p.with_(**given)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("spectraloom").getOrCreate()
    if args.job == "merge":
        tables.merge_reports(spark, args.reports, args.out)
        return
    p = params_of(args)
    found = peptides(tables.read_peptides(spark, args.peptides, p.min_length, p.max_length).filter(legal("seq")), p)
    if args.job == "estimate":
        index.estimate(found, p).show(truncate=False)
        return
    plain = entries(found)
    if p.mods:
        from pyspark.sql import functions as F

        both = with_variants(found, p)
        plain = both.withColumn("entry_id", F.xxhash64("seq", "mods"))
    spectra, peaks = exploded(picked_arrays(with_defaults(ms2.read(spark, args.spectra)), p), p)
    info = plain.select("entry_id", mod_info("mods").alias("mod_info")) if p.mods else None
    tables.write_report(report(search(spectra, peaks, plain, p), spectra, p, info), args.out)


if __name__ == "__main__":
    main()
