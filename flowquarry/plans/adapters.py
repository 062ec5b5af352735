"""The given tables as flow, prediction and client tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.config import BENIGN

EVENT_FEATURES = ("value", "user_id", "k")
LINE_FEATURES = (
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_partkey", "l_suppkey")
EMBEDDING_SIZE = 64
CLASSES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_label() -> F.Column:
    """BENIGN for views, a rare label for errors of high value, else the event type."""
    return (
        F.when(F.col("event_type") == "view", BENIGN)
        .when((F.col("event_type") == "error") & (F.col("value") > 200), "rare")
        .otherwise(F.col("event_type")))


def event_columns(events: DataFrame) -> DataFrame:
    """Flow columns of the events; works on the table and on a stream of it."""
    def octet(column: str, divisor: int):
        return F.expr(f"cast(({column} div {divisor}) % 256 as string)")

    src = F.concat_ws(".", F.lit("10"), octet("user_id", 65536), octet("user_id", 256), octet("user_id", 1))
    dst = F.concat_ws(".", F.lit("192"), F.lit("168"), octet("event_id", 256), octet("event_id", 1))
    return events.select(
        F.col("event_id").alias("row_key"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("source"),
        src.alias("src_ip"), dst.alias("dst_ip"), "value", "user_id",
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
        "event_type", event_label().alias("label"),
    ).withColumn("is_attack", F.col("label") != BENIGN)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flows; a day is a source."""
    return event_columns(table(spark, sf_dir, "events"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as wide numeric flows, return flag N as benign."""
    label = F.when(F.col("l_returnflag") == "N", BENIGN).otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").withColumns({
        "label": label, "is_attack": F.col("l_returnflag") != "N",
        "source": F.date_format("l_shipdate", "yyyy-MM")})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label_id) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").alias("label_id"))


def embedding_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Embeddings with one column per coordinate."""
    names = [f"e{i:02d}" for i in range(EMBEDDING_SIZE)]
    cols = [F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return vectors(spark, sf_dir).select("id", "label_id", *cols), names


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y_true, proba, y_pred): softmax of minus the mean squared distance to each class mean, over all coordinates."""
    rows = vectors(spark, sf_dir)
    means = rows.select("label_id", F.posexplode("x").alias("pos", "v")).groupBy("label_id", "pos").agg(F.round(F.avg("v"), 9).alias("m"))
    centres = [  # classes x coordinates numbers
        [r["m"] for r in group["centre"]] for group in
        means.groupBy("label_id").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("centre")).orderBy("label_id").collect()]
    squares = [F.zip_with("x", F.array(*[F.lit(m) for m in c]), lambda v, m: (v - m) * (v - m)) for c in centres]
    distances = F.array(*[F.round(F.aggregate(s, F.lit(0.0), lambda total, v: total + v) / EMBEDDING_SIZE, 9) for s in squares])
    powers = rows.withColumn("_d", distances).withColumn("_p", F.transform("_d", lambda d: F.exp(-d)))
    summed = F.aggregate("_p", F.lit(0.0), lambda acc, v: acc + v)
    return powers.withColumn("_s", summed).select(
        "id", F.col("label_id").alias("y_true"), F.transform("_p", lambda v: F.round(v / F.col("_s"), 9)).alias("proba"),
        (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("y_pred"))


def client_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(round, client, pos, w0, w1): class means of the embeddings as updates from zero."""
    long = vectors(spark, sf_dir).select(F.col("label_id").alias("client"), F.posexplode("x").alias("pos", "v"))
    return long.groupBy("client", "pos").agg(F.avg("v").alias("w1")).select(
        F.lit(1).alias("round"), "client", "pos", F.lit(0.0).alias("w0"), "w1")


def scenario_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scenario results and per-round overheads measured from the events: type = scenario, day = round.

    Durations and volumes are mean values in thousandths, rounded so that they do not depend on the order of sums.
    """
    letter = (
        F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "error", "B")
        .when(F.col("event_type") == "purchase", "C").when(F.col("event_type") == "signup", "D").otherwise("E"))
    base = flows(spark, sf_dir).withColumn("scenario", letter)
    use_he = F.col("scenario").isin("C", "E")
    use_dp = F.col("scenario").isin("D", "E")
    per_day = base.groupBy("scenario", "source").agg(
        F.round(F.avg("value"), 6).alias("duration_s"), F.round(F.avg("k"), 6).alias("k"), F.count("*").alias("n"))
    overheads = per_day.select(
        "scenario", F.col("source").alias("round"), "duration_s", use_he.alias("he_available"),
        F.when(use_he, F.col("k") / 3).alias("mb"),
        F.when(use_he, F.when((F.col("scenario") == "E") & (F.col("n") % 2 == 0), "encrypt").otherwise("estimate")).alias("mode"),
        F.when(use_he, F.col("duration_s") / 10).alias("enc_s"), F.when(use_he, F.col("k") / 100).alias("agg_s"),
        F.lit(None).cast("double").alias("dec_s"))
    results = base.groupBy("scenario").agg(
        F.lit("success").alias("status"),
        F.round(F.avg((F.col("k") < 60).cast("int")), 6).alias("final_accuracy"),
        F.round(F.avg((F.col("k") < 80).cast("int")), 6).alias("_validation"),
        F.round(F.avg("value") * 10, 6).alias("total_time"), F.round(F.avg("value") * 8, 6).alias("training_time"),
        F.countDistinct("source").alias("rounds"), F.countDistinct("user_id").alias("num_clients"))
    validation = F.when(F.col("scenario") == "A", F.col("_validation")).when(F.col("scenario") == "B", 0.0)
    return results.withColumns({
        "validation_accuracy": validation, "use_dp": use_dp, "use_he": use_he,
        "local_epochs": F.lit(2), "batch_size": F.lit(64),
        "noise_multiplier": F.when(use_dp, 0.8), "delta": F.when(use_dp, 1e-5),
        "error": F.when(F.col("num_clients") < 1, "no clients")}).drop("_validation"), overheads
