"""The query of variants' fragments runs over peptides of every length."""

from pyspark.sql import functions as F

from spectraloom import queries

DATA = "/root/testdata/sf0.001"


def test_variant_ions_of_whole_table(spark):
    n = F.length("seq")
    want = {(r.seq, r.n) for r in queries.mod_enumerate(spark, DATA).groupBy("seq").agg((F.count("*") * (F.max(n) - 1)).alias("n")).collect()}
    got = queries.mod_variant_ions(spark, DATA).filter("is_y = 0 and z = 1").groupBy("seq").agg(F.count("*").alias("n")).collect()
    assert {(r.seq, r.n) for r in got} == want and max(len(r.seq) for r in got) > 8
