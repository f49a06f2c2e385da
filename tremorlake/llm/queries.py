"""Registered queries of the training-data operators, and their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import corpus_pipeline
from tremorlake.llm import (
    clustering, decontam, exact_dedup, langid, line_dedup, lm_score, negatives, packing, quality, secrets, sharding,
    simhash, suffix_dedup)
from tremorlake.llm.common import documents, id_fold
from tremorlake.llm.vectors import embeddings


def sha256_text(col) -> F.Column:
    return F.sha2(col.cast("binary"), 256)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), packing.tokenizer_path(), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, max_bits=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir), shards=8, whole_texts=False)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_score.stupid_backoff(documents(spark, sf_dir), order=3, min_count=2, backoff=0.4)
    per_word = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return rows.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"),
                       F.round(per_word, 9).alias("log_score_per_word"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = decontam.contamination(documents(spark, sf_dir), items, window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       sha256_text(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"),
                       (n_hit > 0).alias("contaminated"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.learn(docs.filter(id_fold(4) != 2))
    rows = langid.identify(docs, model, ["doc_id"])
    return rows.select("doc_id", (id_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.suffix_dedup(documents(spark, sf_dir), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels.filter(id_fold(5) != 0), cut=0.3)
    rows = quality.score(docs, model, ["doc_id"])
    return rows.select("doc_id", (id_fold(5) == 0).alias("held_out"), "score",
                       (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped",
                       sha256_text(F.coalesce(F.col("text"), F.lit(""))).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0, label)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(documents(spark, sf_dir), "doc_id", "text")
    of = lambda kinds: F.filter("findings", lambda s: s["rule"].isin(*kinds))
    count = lambda kind: F.size(of([kind])).cast("long")
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE],
                       sha256_text(joined(of(secrets.BASE))).alias("base_sha256"), joined("findings").alias("spans"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(embeddings(spark, sf_dir), k=8, rounds=10, dims=64, scale=1024, seed=3)
    parts = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    total = F.coalesce(F.sum("inertia").over(Window.partitionBy(F.lit(0))), F.lit(0))  # one row a centroid
    clusters = found.clusters.select("cluster", F.col("inertia").alias("cluster_inertia"),
                                     total.cast("long").alias("inertia"), sha256_text(parts).alias("centroid_sha256"))
    return found.vectors.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
own AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY 1),
j AS (SELECT l.doc_id, pos, line, coalesce(owner <> l.doc_id, false) AS lost FROM l LEFT JOIN own ON l.k = own.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP11_SQL = """
WITH x AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         unnest(range(len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL),
ok AS (SELECT vec_id, label FROM x GROUP BY ALL HAVING count(*) FILTER (WHERE e IS NULL OR NOT isfinite(e)) = 0),
v AS MATERIALIZED (SELECT vec_id, label, p, CAST(floor(256*e) AS BIGINT) AS x FROM x SEMI JOIN ok USING (vec_id)),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(sum(a.x*r.x) AS BIGINT) AS score
  FROM v a JOIN v r ON a.p = r.p AND a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
  GROUP BY a.vec_id, r.vec_id, a.label, r.label),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (
  SELECT pos.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos JOIN s ON pos.anchor_id = s.anchor_id AND NOT same AND 80*positive_score <= 100*score
       AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM neg WHERE rank <= 5
"""


def clustering_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Each round as two tables: ``a``, the least distance * k + number of every vector, and ``c``, the centroids."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT vec_id, min(d*{k} + c) AS m FROM (
    SELECT vec_id, c, CAST(sum((x - y)*(x - y)) AS BIGINT) AS d FROM v JOIN c{r} USING (p) GROUP BY vec_id, c)
  GROUP BY vec_id)"""
    means = """c{q} AS MATERIALIZED (
  SELECT c{r}.c, c{r}.p, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{r} LEFT JOIN (
    SELECT m % {k} AS c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY 1, 2) t
  ON c{r}.c = t.c AND c{r}.p = t.p)"""
    steps = [f"""x AS (SELECT vec_id, unnest(range({dims})) AS p, CAST(unnest(embedding) AS DOUBLE) AS e
  FROM embeddings WHERE len(embedding) = {dims})""",
             f"""ok AS (SELECT vec_id, sha256('{seed}:' || vec_id) AS h FROM x GROUP BY vec_id
  HAVING count(*) FILTER (WHERE e IS NULL OR NOT isfinite(e)) = 0)""",
             f"v AS MATERIALIZED (SELECT vec_id, p, CAST(floor({scale}*e) AS BIGINT) AS x FROM x SEMI JOIN ok USING (vec_id))",
             f"""c0 AS MATERIALIZED (SELECT c, p, x AS y FROM v JOIN (
  SELECT vec_id, row_number() OVER (ORDER BY h) - 1 AS c FROM ok ORDER BY h LIMIT {k}) USING (vec_id))"""]
    for r in range(rounds):
        steps += [nearest.format(r=r, k=k), means.format(r=r, q=r + 1, k=k)]
    steps.append(nearest.format(r=rounds, k=k))
    return "WITH " + ",\n".join(steps) + f""",
t AS (SELECT vec_id, m % {k} AS c, m // {k} AS d FROM a{rounds}),
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS own FROM t GROUP BY c),
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(t.c AS INTEGER) AS cluster, d AS distance, own AS cluster_inertia,
       (SELECT CAST(sum(own) AS BIGINT) FROM i) AS inertia, h AS centroid_sha256
FROM t JOIN i ON t.c = i.c JOIN h ON t.c = h.c"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_stupid_backoff": op5_stupid_backoff,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secret_scan": op12_secret_scan,
    "op13_clustering": op13_clustering,
}
ORACLE = ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {
    "op4_exact_dedup": OP4_SQL, "op6_decontamination": OP6_SQL, "op10_line_dedup": OP10_SQL,
    "op11_hard_negatives": OP11_SQL, "op13_clustering": clustering_sql()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
