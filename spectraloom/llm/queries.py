"""Queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import bpe, brown, hilbert, jaccard, kdtree, langid, lines, mixing, suffixes, toxicity
from spectraloom.llm.common import bucket_of, read


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))[0]


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(bucket_of("doc_id", 4) != 2))
    return langid.identify(docs, model).withColumn("held_out", bucket_of("doc_id", 4) == 2)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.deduplicate(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scores = brown.score(docs, docs.filter(bucket_of("doc_id", 5) != 1))
    return scores.withColumn("held_out", bucket_of("doc_id", 5) == 1)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.search(read(spark, sf_dir, "embeddings"), every=20)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = mixing.mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(read(spark, sf_dir, "embeddings"), every=100)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(bucket_of("doc_id", 5) != 0))
    return toxicity.score(docs, model).withColumn("held_out", bucket_of("doc_id", 5) == 0)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_brown_scores": op5_brown_scores,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_source_mix": op7_source_mix,
    "op8_hilbert_neighbours": op8_hilbert_neighbours,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_toxicity": op10_toxicity,
}
_WORDS = f"regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x20\x09-\x0D]+')"
_SHINGLES = """CASE WHEN len(l) >= 5 THEN list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')))
    WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END"""
_LEVEL = "(sum(size) OVER () * 1.5 - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0))"

#: DuckDB SQL for the exact operators that it can express.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": f"""WITH RECURSIVE words AS (SELECT doc_id, coalesce({_WORDS}, []) AS l FROM documents), s AS (SELECT doc_id, {_SHINGLES} AS x FROM words),
        e AS (SELECT doc_id, unnest(x) AS t FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        k AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.x) + len(y.x) - c)), both_ AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
        r(id, least_) AS (SELECT doc_id, doc_id FROM s UNION SELECT b, least_ FROM r JOIN both_ ON a = id WHERE least_ < b),
        c AS (SELECT id, min(least_) AS component_id FROM r GROUP BY id)
        SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles, component_id, CASE WHEN len(x) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(x)) END AS class_id FROM s JOIN c ON id = doc_id""",
    "op4_suffix_dedup": """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, len(h) // 2 AS n FROM t),
        w AS (SELECT doc_id, p, h[2 * p + 1:2 * p + 100] AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM n)),
        g AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS f FROM w) WHERE f < doc_id),
        i AS (SELECT doc_id, p, sum(CASE WHEN p <= q + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -999) AS q FROM g)),
        c AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY ALL),
        o AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM c GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(len(a) + 1), lambda j: substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE z[j] END) + 1,
        2 * ((CASE WHEN j = len(a) THEN n ELSE a[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE z[j] END)))), '') END)) AS kept_sha256 FROM n LEFT JOIN o USING (doc_id)""",
    "op6_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op7_source_mix": f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
        b AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM b),
        w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][src % 3 + 1] AS w, size * 2.0::DOUBLE AS cap FROM o),
        l AS (SELECT *, {_LEVEL} AS level FROM w WINDOW f AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, src, size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level <= cap / w) * w, cap)) AS target FROM l),
        u AS (SELECT *, sum(target) OVER (ORDER BY src) AS up, sum(target) OVER () AS total FROM t), r AS (SELECT *, (up - target) / total AS low, up / total AS high, CAST({mixing.BLOCK_TOKENS} AS BIGINT) AS block FROM u),
        slots AS (SELECT x - floor(x) AS x FROM (SELECT (i >> 20) * {mixing._GOLDEN_HIGH!r}::DOUBLE + (i & 1048575) * {mixing._GOLDEN!r}::DOUBLE + 0.5 AS x FROM (SELECT unnest(range(CAST(ceil(total / block) AS BIGINT))) AS i FROM (SELECT DISTINCT total, block FROM r)))),
        n AS (SELECT src, block * count(x) AS n FROM r LEFT JOIN slots ON x >= low AND x < high GROUP BY src, block),
        p AS (SELECT d.*, r.src, r.size AS source_size, target, coalesce(sum(d.size) OVER (PARTITION BY r.src ORDER BY md5('7:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source, source_size, round(target, 6) AS target,
        CAST(greatest(0, least(size, n - start_)) + greatest(0, least(size, n - start_ - source_size)) AS BIGINT) AS taken FROM p JOIN n USING (src)""",
}
