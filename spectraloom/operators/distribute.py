"""Dealing rows to a number of partitions by id, and dataset splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.params import Policy


def owner(policy: Policy, key: str, parts: int, total: int | None = None) -> Column:
    """Partition (from 0) of a 0-based id; ``total`` rows are needed for chunks."""
    if policy is Policy.CYCLIC:
        return F.expr(f"cast(pmod({key}, {parts}) as int)")
    if policy is Policy.CHUNK:
        if not total:
            raise ValueError("chunks need the number of rows")
        return F.expr(f"cast({key} div {-(-total // parts)} as int)")
    return F.expr(f"cast(CASE WHEN ({key} div {parts}) % 2 = 0 THEN pmod({key}, {parts}) ELSE {parts - 1} - pmod({key}, {parts}) END as int)")


def global_id(policy: Policy, local: str, part: str, parts: int, total: int | None = None) -> Column:
    """The id that is the ``local``-th (from 0) of its partition: the inverse of ``owner``."""
    if policy is Policy.CYCLIC:
        return F.expr(f"{local} * {parts} + {part}")
    if policy is Policy.CHUNK:
        if not total:
            raise ValueError("chunks need the number of rows")
        return F.expr(f"{part} * {-(-total // parts)} + {local}")
    return F.expr(f"{local} * {parts} + CASE WHEN {local} % 2 = 0 THEN {part} ELSE {parts - 1} - {part} END")


def deal(df: DataFrame, policy: Policy, key: str, parts: int, total: int | None = None) -> DataFrame:
    """``df`` with part, physically partitioned by it."""
    return df.withColumn("part", owner(policy, key, parts, total)).repartition(parts, "part")


def sizes(parts: int, total: int) -> list[int]:
    """Rows of each partition: equal shares, the remainder one each to the first."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def split_dataset(df: DataFrame, key: str, parts: int, seed: int = 0) -> DataFrame:
    """``df`` with part: a seeded, even and repeatable scatter; the union of the parts is ``df``."""
    return df.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(parts)).cast("int"))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``df`` in a seeded random order of ``key``."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)
