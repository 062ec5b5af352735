"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm.decontamination import contamination_report
from flowquarry.llm.exact_dedup import exact_groups
from flowquarry.llm.fingerprints import fingerprint_stability
from flowquarry.llm.hard_negatives import hard_negatives
from flowquarry.llm.jaccard_join import near_duplicates
from flowquarry.llm.line_dedup import drop_boilerplate
from flowquarry.llm.mixing import fit_domains, mixing_rates, plan_mixture, quality_domains
from flowquarry.llm.periodic_runs import periodic_runs
from flowquarry.llm.registry import ORACLE, QUERIES, query, table
from flowquarry.llm.suffix_dedup import repeated_passages
from flowquarry.llm.token_counts import token_counts
from flowquarry.llm.token_store import store_digest
from flowquarry.llm.toxicity import fit_toxicity, toxicity
from flowquarry.llm.warc import archive_round_trip

__all__ = ["ORACLE", "QUERIES"]

DOMAIN_WEIGHTS = {"en": 0.50, "de": 0.15, "fr": 0.15, "es": 0.15, "low": 0.05}


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).drop("text")


OP2_SQL = r"""
WITH clean AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM clean GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM clean JOIN groups USING (text_sha256)"""


@query("op2_exact_dedup", OP2_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = fit_domains(docs, quality_domains(docs, table(spark, sf_dir, "labels")), F.col("domain"), list(DOMAIN_WEIGHTS))
    plan = plan_mixture(docs, model, DOMAIN_WEIGHTS)
    return mixing_rates(docs, plan).drop("text", "lang")


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_token_store")
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_digest(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
boilerplate AS (
  SELECT trim(line) AS line FROM lines WHERE trim(line) <> ''
  GROUP BY trim(line) HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 10),
marked AS (SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN boilerplate b ON trim(l.line) = b.line)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op6_line_dedup", OP6_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


OP8_SQL = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
last AS (SELECT payload, max(page_id) AS response FROM sized GROUP BY payload),
coded AS (
  SELECT payload, response, list_transform(range(8), lambda i: CAST('0x' || substr(sha1(payload), CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS v FROM last)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM sized JOIN coded USING (payload)"""


@query("op8_warc", OP8_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("starts", "ends")


@query("op11_fingerprints")
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_stability(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", own), F.col("vec_id") % 100 == 0)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with about every tenth text made periodic from a word on, both drawn by the crc32 of doc_id."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    code = F.crc32(F.col("doc_id").cast("string"))
    drawn = docs.select("doc_id", "text", (code % 10 == 0).alias("chosen"), F.floor(code / 10).alias("g"))
    drawn = drawn.withColumn("words", F.when(F.col("chosen"), words)).withColumn("n", F.size("words"))
    drawn = drawn.withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    drawn = drawn.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    return drawn.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # longest first, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
