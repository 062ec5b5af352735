"""Label ids, folds, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import preparation, windows
from flowquarry.plans.adapters import EVENT_FEATURES, flows, vectors
from flowquarry.plans.registry import FLOWS, VECTORS, hash_order, query, rounded, with_sql
from flowquarry.plans.windows import windows_cte

SEED = 79
K = 5
ORDER = hash_order(SEED, "row_key")
DIMENSION = "dimension AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id, label FROM (SELECT DISTINCT label FROM flows))"
FOLDED = f"""folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY label_id ORDER BY {hash_order(SEED, "id")}, id) - 1) % {K} AS INTEGER) AS fold FROM coords_ids),
held AS (SELECT unnest(range({K})) AS fold),
scalers AS (SELECT CAST(h.fold AS INTEGER) AS fold, CAST(c.pos AS INTEGER) AS feature, count(*) AS n, avg(v) AS mean,
              CASE WHEN var_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END AS sd
            FROM held h, folded f, coords c WHERE f.id = c.id AND f.fold <> h.fold GROUP BY h.fold, c.pos)"""
IDS = "coords_ids AS (SELECT id, label_id FROM vectors)"


@query("label_dimension", with_sql([FLOWS, DIMENSION], "SELECT * FROM dimension"))
def label_dimension(spark, sf_dir):
    return preparation.label_dimension(flows(spark, sf_dir))


@query("label_encode", with_sql([FLOWS, DIMENSION], """
SELECT row_key, label, label_id FROM flows JOIN dimension USING (label)"""))
def label_encode(spark, sf_dir):
    df = flows(spark, sf_dir)
    return preparation.encode_labels(df, preparation.label_dimension(df)).select("row_key", "label", "label_id")


@query("stratified_folds", with_sql([FLOWS], f"""
SELECT row_key, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {ORDER}, row_key) - 1) % {K} AS INTEGER) AS fold FROM flows"""))
def stratified_folds(spark, sf_dir):
    folded = preparation.assign_folds(flows(spark, sf_dir), K, SEED, "row_key", stratified=True)
    return folded.select("row_key", "label", "fold")


@query("plain_folds", with_sql([FLOWS], f"""
SELECT row_key, CAST((row_number() OVER (ORDER BY {ORDER}, row_key) - 1) % {K} AS INTEGER) AS fold FROM flows"""))
def plain_folds(spark, sf_dir):
    return preparation.assign_folds(flows(spark, sf_dir), K, SEED, "row_key", stratified=False).select("row_key", "fold")


@query("automatic_folds", with_sql([FLOWS], f"""
, smallest AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM flows GROUP BY label)),
placed AS (SELECT row_key, row_number() OVER (PARTITION BY label ORDER BY {ORDER}, row_key) - 1 AS by_label,
             row_number() OVER (ORDER BY {ORDER}, row_key) - 1 AS by_all FROM flows)
SELECT k, row_key, CAST(CASE WHEN n >= k THEN by_label ELSE by_all END % k AS INTEGER) AS fold
FROM placed, smallest, (SELECT CAST(unnest([2, 100000]) AS INTEGER) AS k)""".lstrip("\n")))
def automatic_folds(spark, sf_dir):
    """Class by class where every class has a row for each fold, over all rows where one has fewer."""
    df = flows(spark, sf_dir)
    found = [preparation.assign_folds(df, k, SEED, "row_key").select(F.lit(k).alias("k"), "row_key", "fold") for k in (2, 100_000)]
    return found[0].unionByName(found[1])


@query("train_val_split", with_sql([FLOWS], f"""
SELECT row_key, label, rn <= floor(n * 0.2::DOUBLE + 0.5) AS is_validation FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORDER}, row_key) AS rn,
         count(*) OVER (PARTITION BY label) AS n FROM flows)"""))
def train_val_split(spark, sf_dir):
    split = preparation.split_train_validation(flows(spark, sf_dir), 0.2, SEED, "row_key", stratified=True)
    return split.select("row_key", "label", "is_validation")


@query("fold_scaling", with_sql([VECTORS, IDS, FOLDED], """
SELECT fold, feature, n, round(mean, 9) AS mean, round(sd, 9) AS sd FROM scalers"""))
def fold_scaling(spark, sf_dir):
    folded = preparation.assign_folds(vectors(spark, sf_dir), K, SEED, "id", "label_id", stratified=True)
    return rounded(preparation.fold_scalers(folded, "x", K), 9, "mean", "sd")


@query("scaled_vectors", with_sql([VECTORS, IDS, FOLDED], """
SELECT f.id, f.fold, CAST(c.pos AS INTEGER) AS feature, round((c.v - s.mean) / s.sd, 6) AS z
FROM folded f JOIN coords c USING (id) JOIN scalers s ON s.fold = f.fold AND s.feature = c.pos"""))
def scaled_vectors(spark, sf_dir):
    folded = preparation.assign_folds(vectors(spark, sf_dir), K, SEED, "id", "label_id", stratified=True)
    scaled = preparation.scale_array(folded, preparation.fold_scalers(folded, "x", K), "x", by=["fold"])
    return rounded(scaled.select("id", "fold", F.posexplode("scaled").alias("feature", "z")), 6, "z")


@query("train_only_scaling", with_sql([FLOWS], f"""
, split AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORDER}, row_key)
              <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5) AS is_validation FROM flows),
fitted AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM split WHERE NOT is_validation)
SELECT row_key, is_validation, round((value - mv) / sv, 6) AS z_value, round((k - mk) / sk, 6) AS z_k FROM split, fitted"""))
def train_only_scaling(spark, sf_dir):
    split = preparation.split_train_validation(flows(spark, sf_dir), 0.2, SEED, "row_key", stratified=True)
    rows = split.select("row_key", "is_validation", F.array("value", "k").alias("x"))
    scaled = preparation.scale_array(rows, preparation.train_scaler(rows.filter("NOT is_validation"), "x"), "x")
    return rounded(scaled.select(
        "row_key", "is_validation", F.get("scaled", F.lit(0)).alias("z_value"), F.get("scaled", F.lit(1)).alias("z_k")),
        6, "z_value", "z_k")


def _event_windows(spark, sf_dir):
    return windows.count_windows(flows(spark, sf_dir), ["ts", "row_key"], EVENT_FEATURES, "label")


WINDOW_LONG = """long AS (SELECT window_id, step_no, unnest([0, 1, 2]) AS f, unnest([value, CAST(user_id AS DOUBLE), k]) AS v FROM cut)"""


@query("normalization_stats", with_sql([FLOWS, windows_cte(10, 5), WINDOW_LONG], """
SELECT CAST(step_no * 3 + f AS INTEGER) AS feature, round(avg(v), 6) AS mean, round(var_pop(v), 4) AS variance
FROM long GROUP BY 1"""))
def normalization_stats(spark, sf_dir):
    flat = windows.flatten_windows(_event_windows(spark, sf_dir))
    stats = preparation.train_scaler(flat, "flat").select("feature", "mean", "variance")
    return rounded(rounded(stats, 6, "mean"), 4, "variance")


@query("window_scaling", with_sql([FLOWS, windows_cte(10, 5), WINDOW_LONG], """
, fitted AS (SELECT f, avg(v) AS mean, stddev_pop(v) AS sd FROM long GROUP BY f)
SELECT window_id, step_no, CAST(f AS INTEGER) AS feature, round((v - mean) / sd, 6) AS z FROM long JOIN fitted USING (f)"""))
def window_scaling(spark, sf_dir):
    w = _event_windows(spark, sf_dir)
    scaled = preparation.scale_windows(w, preparation.window_scaler(w, "x"), "x")
    steps = scaled.select("window_id", F.posexplode("scaled").alias("step_no", "step"))
    long = steps.select("window_id", F.col("step_no").cast("long").alias("step_no"), F.posexplode("step").alias("feature", "z"))
    return rounded(long, 6, "z")


@query("block_folds", with_sql([FLOWS, windows_cte(10, 5)], """
SELECT window_id, CAST(CASE WHEN window_id % 20 >= 19 THEN -1 ELSE (window_id // 20) % 5 END AS INTEGER) AS fold
FROM cut WHERE step_no = 0"""))
def block_folds(spark, sf_dir):
    return preparation.assign_block_folds(_event_windows(spark, sf_dir), 5, 20, 1).select("window_id", "fold")
