"""The queries of this subpackage by name: each operator over its whole table, digests only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.centroids import CENTROIDS, DIMS, ROUNDS, SCALE, SEED, cluster_vectors
from sessionloom.llm.decontaminate import contaminated, find_contamination, n_hit
from sessionloom.llm.exact_dedup import exact_groups
from sessionloom.llm.line_dedup import dedup_lines
from sessionloom.llm.packing import pack_documents
from sessionloom.llm.period_runs import periodic_runs, planted
from sessionloom.llm.pivot_index import embedding_groups
from sessionloom.llm.quality import graded, score_quality, selected
from sessionloom.llm.secret_scan import RULES, rendered, scan_secrets
from sessionloom.llm.shards import uniform_shards
from sessionloom.llm.simhash import simhash_groups
from sessionloom.llm.substring_dedup import substring_dedup
from sessionloom.llm.suffix_index import dedup_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without windows of 13 words that start in an earlier document."""
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_result(groups: DataFrame) -> DataFrame:
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return op2_result(simhash_groups(table(spark, sf_dir, "documents")))


def op3_result(found: DataFrame) -> DataFrame:
    hits = n_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), hits).alias("contaminated"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    return op3_result(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op5_result(groups: DataFrame) -> DataFrame:
    return groups.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op5_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate groups of all vectors."""
    return op5_result(embedding_groups(table(spark, sf_dir, "embeddings")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts, in uniformly random order."""
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    return uniform_shards(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without line chunks that occur earlier."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and the decision for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, graded(table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", "expected_grade", F.get("tail", 0).alias("p_not_toxic"), F.get("tail", 1).alias("p_good"),
        selected(F.col("tail")).alias("kept"),
    )


def op9_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without strings of 50 bytes that start in an earlier document."""
    found = dedup_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _n_spans(order: int) -> Column:
    """How many spans come from the rule with this number."""
    return F.size(F.filter("found", lambda s: s["order"] == order)).cast("long")


def op10_result(found: DataFrame) -> DataFrame:
    spans = rendered(F.col("found"))
    counts = [_n_spans(order).alias(f"n_{r.kind}") for order, r in enumerate(RULES)]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans")
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return op10_result(scan_secrets(table(spark, sf_dir, "documents")))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds, and how far it lies from the centroid."""
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256")
    )


def _greater(best: Column, run: Column) -> Column:
    """Of two runs the one with the greater length / period; the first if they are equal."""
    ahead = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.when(ahead, run).otherwise(best)


def op12_result(found: DataFrame) -> DataFrame:
    kind = dict(found.dtypes)["runs"].removeprefix("array<")[:-1]
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    best = F.aggregate("runs", F.lit(None).cast(kind), _greater)
    return found.select("doc_id", "n_runs", best.alias("best"), lines.alias("lines"), "kept_text").select(
        "doc_id",
        "n_runs",
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document."""
    return op12_result(periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), change=planted))


def op13_result(groups: DataFrame) -> DataFrame:
    return groups.withColumnRenamed("id", "doc_id")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays, for every document."""
    return op13_result(exact_groups(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in [
        op1_substring_dedup, op2_simhash, op3_decontaminate, op4_packing, op5_pivot_index, op6_sharding, op7_line_dedup,
        op8_quality, op9_suffix_index, op10_secret_scan, op11_centroids, op12_period_runs, op13_exact_dedup,
    ]
}


def _secret_sql() -> str:
    """Places are sums of the lengths of what lies between matches and of the matches."""
    parts = []
    for order, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
    SELECT row, '{rule.kind}' AS kind, {order} AS ord, string_split_regex(t, '{pattern}') AS gaps,
      regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {rule.group}) AS checked,
      {rule.least} AS least FROM d""")
    union = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({union}),
p AS (
  SELECT row, kind, ord, least, gaps, hits, checked, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (
  SELECT row, kind, ord, length(hits[i]) AS n,
    coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)::BIGINT
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS b
  FROM p WHERE length(checked[i]) >= least),
g AS (
  SELECT row, string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, ord) AS spans, {counts} FROM s GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)},
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)"""


EXACT_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
p AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, row))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM p"""


def _centroid_sql() -> str:
    """Rounds written out: distances of all vectors to all centroids, then exact floors of the means."""
    ctes = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS cluster, q FROM v
  QUALIFY cluster < {CENTROIDS})"""]
    for r in range(ROUNDS + 1):
        ctes.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v.q) AS q, min(struct_pack(distance := distance, cluster := cluster)) AS best
  FROM v, c{r} AS c, LATERAL (
    SELECT list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance)
  GROUP BY row)""")
        if r < ROUNDS:
            ctes.append(f"""
s{r} AS (
  SELECT best.cluster AS cluster, i, sum(q[i])::BIGINT AS s, count(*) AS n
  FROM a{r}, range(1, {DIMS + 1}) AS t(i) GROUP BY ALL),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    last = f"a{ROUNDS}"
    return f"""
WITH {",".join(ctes)}
SELECT vec_id, best.cluster::INTEGER AS cluster, best.distance AS distance,
  (sum(best.distance) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
  (sum(best.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM {last} JOIN c{ROUNDS} AS c ON c.cluster = {last}.best.cluster"""


ORACLE: dict[str, str] = {
    "op10_secret_scan": _secret_sql(), "op11_centroids": _centroid_sql(), "op13_exact_dedup": EXACT_SQL,
}
