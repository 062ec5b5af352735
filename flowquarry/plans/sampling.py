"""Class counts, quotas, samples and client shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import sampling
from flowquarry.operators.columns import split_by_label
from flowquarry.operators.positions import attach
from flowquarry.plans.adapters import flows
from flowquarry.plans.registry import FLOWS, hash_order, query, rounded, with_sql
from flowquarry.plans.studies import head_sample as head_sample_study

SEED = 79
TARGET = 3000
ORDER = hash_order(SEED, "row_key")

ATTACKS = f"""attack AS (SELECT * FROM flows WHERE label <> 'BENIGN'),
quota AS (SELECT greatest(1, {TARGET} // count(DISTINCT source)) AS quota FROM attack),
marks AS (SELECT label, count(*) AS n, any_value(quota) AS quota, count(*) < any_value(quota) * 0.8 AS is_rare
          FROM attack, quota GROUP BY label),
marked AS (SELECT attack.*, is_rare, quota FROM attack JOIN marks USING (label)),
space AS (SELECT source, greatest(any_value(quota) - count(*) FILTER (is_rare), 0) AS space FROM marked GROUP BY source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {ORDER}, row_key) AS rn FROM marked WHERE NOT is_rare),
attack_sample AS (SELECT row_key, source, label FROM marked WHERE is_rare
                  UNION ALL SELECT row_key, ranked.source, label FROM ranked JOIN space USING (source) WHERE rn <= space)"""
BENIGN_SAMPLE = f"""benign AS (SELECT * FROM flows WHERE label = 'BENIGN'),
benign_ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {ORDER}, row_key) AS rn FROM benign),
benign_sample AS (SELECT row_key, source, label FROM benign_ranked
                  WHERE rn <= greatest(1, {TARGET} // (SELECT count(DISTINCT source) FROM benign)))"""


@query("label_counts", with_sql([FLOWS], "SELECT label, count(*) AS n FROM flows GROUP BY label"))
def label_counts(spark, sf_dir):
    return sampling.label_counts(flows(spark, sf_dir))


@query("label_distribution", with_sql([FLOWS], """
SELECT label, count(*) AS total, count(DISTINCT source) AS files FROM flows GROUP BY label"""))
def label_distribution(spark, sf_dir):
    return sampling.label_distribution(flows(spark, sf_dir))


@query("class_audit", with_sql([FLOWS], """
SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM flows) * 100, 2) AS percent FROM flows GROUP BY label"""))
def class_audit(spark, sf_dir):
    return sampling.class_audit(flows(spark, sf_dir))


@query("class_weights", with_sql([FLOWS], """
SELECT label, count(*) AS n, round((SELECT count(*) / count(DISTINCT label) FROM flows) / count(*), 9) AS weight
FROM flows GROUP BY label"""))
def class_weights(spark, sf_dir):
    return rounded(sampling.class_weights(flows(spark, sf_dir)), 9, "weight")


@query("rare_labels", with_sql([FLOWS, ATTACKS], "SELECT label, n, CAST(quota AS INTEGER) AS quota, is_rare FROM marks"))
def rare_labels(spark, sf_dir):
    _, attack = split_by_label(flows(spark, sf_dir), "label")
    return sampling.rare_labels(attack, TARGET)


@query("attack_sample", with_sql([FLOWS, ATTACKS], "SELECT * FROM attack_sample"))
def attack_sample(spark, sf_dir):
    _, attack = split_by_label(flows(spark, sf_dir), "label")
    return sampling.sample_attacks(attack, TARGET, SEED, "row_key").select("row_key", "source", "label")


@query("benign_sample", with_sql([FLOWS, BENIGN_SAMPLE], "SELECT * FROM benign_sample"))
def benign_sample(spark, sf_dir):
    benign, _ = split_by_label(flows(spark, sf_dir), "label")
    return sampling.sample_benign(benign, TARGET, SEED, "row_key").select("row_key", "source", "label")


@query("security_balance", with_sql([FLOWS, ATTACKS, BENIGN_SAMPLE], """
SELECT * FROM attack_sample UNION ALL SELECT * FROM benign_sample"""))
def security_balance(spark, sf_dir):
    return sampling.balance(flows(spark, sf_dir), 2 * TARGET, 0.5, SEED).select("row_key", "source", "label")


@query("uniform_scan", with_sql([FLOWS], f"""
SELECT source, row_key FROM flows
QUALIFY row_number() OVER (PARTITION BY source ORDER BY {ORDER}, row_key) <= 40"""))
def uniform_scan(spark, sf_dir):
    return sampling.sample_uniform(flows(spark, sf_dir), 40, SEED, "row_key").select("source", "row_key")


REQUIRED = 500


@query("oversample_minority", with_sql([FLOWS], f"""
, counts AS (SELECT label, count(*) AS n FROM flows GROUP BY label HAVING count(*) < {REQUIRED}),
placed AS (SELECT row_key, label, row_number() OVER (PARTITION BY label ORDER BY {ORDER}, row_key) - 1 AS pos
           FROM flows JOIN counts USING (label)),
draws AS (SELECT label, n, unnest(range({REQUIRED} - n)) AS draw FROM counts),
picks AS (SELECT label, draw,
            CAST('0x' || substr({hash_order(SEED, "label", "draw")}, 1, 8) AS BIGINT) % n AS pos FROM draws)
SELECT row_key, label, 0 AS copy FROM flows
UNION ALL SELECT row_key, label, CAST(draw + 1 AS INTEGER) FROM placed JOIN picks USING (label, pos)""".lstrip("\n")))
def oversample_minority(spark, sf_dir):
    return sampling.oversample(flows(spark, sf_dir), REQUIRED, SEED, "row_key").select("row_key", "label", "copy")


LABEL_QUOTAS = """quotas AS (SELECT label, count(*) AS total, count(DISTINCT source) AS files,
  greatest(1, least(900 // count(DISTINCT source), count(*) // count(DISTINCT source))) AS quota FROM flows GROUP BY label)"""


@query("label_quotas", with_sql([FLOWS, LABEL_QUOTAS], "SELECT * FROM quotas"))
def label_quotas(spark, sf_dir):
    return sampling.label_quotas(flows(spark, sf_dir), 900)


@query("uniform_label_sample", with_sql([FLOWS, LABEL_QUOTAS], f"""
SELECT row_key, source, label FROM (
  SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY {ORDER}, row_key) AS rn FROM flows)
JOIN quotas USING (label) WHERE rn <= quota"""))
def uniform_label_sample(spark, sf_dir):
    return sampling.sample_labels(flows(spark, sf_dir), 900, SEED, "row_key").select("row_key", "source", "label")


@query("head_sample", with_sql([FLOWS], """
SELECT row_key, source, label <> 'BENIGN' AS is_attack FROM flows
WHERE source IN (SELECT DISTINCT source FROM flows ORDER BY source LIMIT 2)
QUALIFY row_number() OVER (PARTITION BY source, label <> 'BENIGN' ORDER BY ts, row_key) <= 25"""))
def head_sample(spark, sf_dir):
    return head_sample_study(flows(spark, sf_dir), 100, 2, ["ts", "row_key"]).select("row_key", "source", "is_attack")


@query("seeded_shuffle", with_sql([FLOWS], f"""
SELECT row_key, row_number() OVER (ORDER BY {ORDER}, row_key) - 1 AS shuffle_pos FROM flows"""))
def seeded_shuffle(spark, sf_dir):
    return sampling.shuffled(flows(spark, sf_dir), SEED, "row_key").select("row_key", "shuffle_pos")


@query("clients_iid", with_sql([FLOWS], f"""
SELECT row_key, CAST(ntile(7) OVER (ORDER BY {ORDER}, row_key) - 1 AS INTEGER) AS client FROM flows"""))
def clients_iid(spark, sf_dir):
    return sampling.client_parts(flows(spark, sf_dir), 7, SEED, "row_key").select("row_key", "client")


@query("clients_non_iid", with_sql([FLOWS], f"""
SELECT row_key, label, CAST(ntile(7) OVER (ORDER BY label, {ORDER}, row_key) - 1 AS INTEGER) AS client FROM flows"""))
def clients_non_iid(spark, sf_dir):
    return sampling.client_parts(flows(spark, sf_dir), 7, SEED, "row_key", "label").select("row_key", "label", "client")


@query("union_of_classes", with_sql([FLOWS], """
SELECT label, count(*) AS n, count(DISTINCT row_key) AS keys FROM flows GROUP BY label"""))
def union_of_classes(spark, sf_dir):
    benign, attack = split_by_label(flows(spark, sf_dir), "label")
    return benign.unionByName(attack).groupBy("label").agg(
        F.count("*").alias("n"), F.count_distinct("row_key").alias("keys"))


@query("rare_membership", with_sql([FLOWS, ATTACKS], """
SELECT row_key, label, label IN (SELECT label FROM marks WHERE is_rare) AS is_rare FROM attack"""))
def rare_membership(spark, sf_dir):
    _, attack = split_by_label(flows(spark, sf_dir), "label")
    marks = sampling.rare_labels(attack, TARGET).select("label", "is_rare")
    return attach(attack, marks, ["label"]).select("row_key", "label", "is_rare")
