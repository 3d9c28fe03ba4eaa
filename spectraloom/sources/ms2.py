"""MS2 text spectra as a Spark data source (batch and stream) and a text writer.

    spark.dataSource.register(MS2DataSource)
    spark.read.format("ms2").load("dir")

H and D lines are skipped, S begins a spectrum, ``I RTime`` and Z give its
retention time, charge and mass, any other line is a peak. A file is one
partition: spectra span lines. Paths are opened through Arrow's file systems
(local, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, ordinal long, scan int, charge int, prec_mass double, rtime double, peaks array<struct<mz: double, intensity: double>>, info map<string, string>"


def parse(lines, file: str) -> Iterator[tuple]:
    """Rows of ``SCHEMA``; a missing charge, mass or retention time is its default, a bad number an error naming the line."""
    now, ordinal = None, -1
    for number, line in enumerate(lines, 1):
        line = line.strip()
        if not line or line[0] in "HD":
            continue
        try:
            fields = line.split()
            if line[0] == "S":
                if now:
                    yield tuple(now)
                ordinal += 1
                now = [file, ordinal, int(fields[1]) if len(fields) > 1 else 0, 1, 0.01, 0.0, [], {}]
            elif now is None:
                continue
            elif line[0] == "Z":
                now[3] = max(1, int(float(fields[1]))) if len(fields) > 1 else 1
                now[4] = float(fields[2]) if len(fields) > 2 else 0.01
            elif line[0] == "I":
                if len(fields) > 2:
                    now[7][fields[1]] = " ".join(fields[2:])
                    if fields[1] == "RTime":
                        now[5] = max(0.0, float(fields[2]))
            else:
                now[6].append((float(fields[0]), float(fields[1]) if len(fields) > 1 else 0.01))
        except ValueError as bad:
            raise ValueError(f"{file}:{number}: {bad}") from None
    if now:
        yield tuple(now)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _files(path: str) -> list[str]:
    """The ``.ms2`` files of a folder in name order, or the file itself; none if the path does not exist."""
    system, inside = _system(path)
    found = system.get_file_info(inside)
    if found.type == fs.FileType.Directory:
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(inside)) if f.is_file and f.extension == "ms2")
    return [found.path] if found.is_file else []


class _File(InputPartition):
    """A file of the file system of ``root``; without a ``path`` no rows."""

    def __init__(self, root: str, path: str | None):
        self.root, self.path = root, path


def _rows(partition: _File) -> Iterator[tuple]:
    if partition.path is not None:
        system, _ = _system(partition.root)
        with system.open_input_stream(partition.path) as raw:
            yield from parse(io.TextIOWrapper(io.BufferedReader(raw), "utf-8"), os.path.basename(partition.path))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        # Spark needs one partition even of a folder without files.
        return [_File(self.path, f) for f in _files(self.path)] or [_File(self.path, None)]

    def read(self, partition):
        return _rows(partition)


class _StreamReader(DataSourceStreamReader):
    """New files of a folder, each read once by a task of its own, whatever their names and times.

    The offset holds the names of all files seen, so that a file that arrives
    late is new however it is called; it grows with the files of the folder.
    """

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {"seen": []}

    def latestOffset(self):
        return {"seen": _files(self.path)}

    def partitions(self, start, end):
        old = set(start["seen"])
        return [_File(self.path, f) for f in end["seen"] if f not in old] or [_File(self.path, None)]

    def read(self, partition):
        return _rows(partition)


class MS2DataSource(DataSource):
    @classmethod
    def name(cls):
        return "ms2"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _StreamReader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The same rows through Spark's own file listing and text reader, for paths that only Spark opens."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.ms2").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")

    def work(frames):
        import pandas as pd

        names = [c.split(" ")[0] for c in ("file", "ordinal", "scan", "charge", "prec_mass", "rtime", "peaks", "info")]
        for frame in frames:
            for file, value in frame.itertuples(index=False):
                rows = [r[:6] + ([{"mz": a, "intensity": b} for a, b in r[6]], r[7]) for r in parse(value.splitlines(), file)]
                yield pd.DataFrame(rows, columns=names)

    return whole.mapInPandas(work, SCHEMA)


def text_blocks(raw: DataFrame) -> DataFrame:
    """file, ordinal, value: each spectrum as MS2 lines."""
    peaks = F.array_join(F.transform("peaks", lambda x: F.concat_ws(" ", x["mz"].cast("string"), x["intensity"].cast("string"))), "\n")
    head = F.concat(F.lit("S\t"), F.col("scan"), F.lit("\t"), F.col("scan"), F.lit("\t"), F.col("prec_mass"), F.lit("\nI\tRTime\t"), F.col("rtime"), F.lit("\nZ\t"), F.col("charge"), F.lit("\t"), F.col("prec_mass"))
    return raw.select("file", "ordinal", F.concat_ws("\n", head, F.when(F.size("peaks") > 0, peaks)).alias("value"))


def write(raw: DataFrame, path: str) -> None:
    """One ``.ms2`` file in the folder for each ``file`` of ``raw``, its spectra in order; ``.ms2`` files there before go.

    A file is written by one task under a name of its own and renamed when it
    is whole, so that a task that is run again finds its earlier files whole or
    not at all. Without a name spectra go to ``unnamed.ms2``.
    """
    system, folder = _system(path)
    system.create_dir(folder)
    for old in _files(path):
        system.delete_file(old)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _system(path)
        now, out, part = None, None, f"{folder}/_{uuid.uuid4().hex}"

        def close() -> None:
            if out is not None:
                out.close()
                if system.get_file_info(f"{folder}/{now}").is_file:
                    system.delete_file(part)
                else:
                    system.move(part, f"{folder}/{now}")

        for b in batches:
            for file, value in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                if file != now:
                    close()
                    now, out = file, system.open_output_stream(part)
                out.write(value.encode() + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["file"])

    bare = F.element_at(F.split(F.coalesce("file", F.lit("unnamed.ms2")), "/"), -1)
    named = text_blocks(raw).withColumn("file", F.when(bare.endswith(".ms2"), bare).otherwise(F.concat(bare, F.lit(".ms2"))))
    named.repartition("file").sortWithinPartitions("file", "ordinal").select("file", "value").mapInArrow(work, "file string").count()


def extract(raw: DataFrame, ordinals: list[int]) -> DataFrame:
    """Spectra of the given ordinals."""
    return raw.filter(F.col("ordinal").isin(ordinals))
