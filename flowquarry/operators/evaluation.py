"""Metrics of a predictions table (id, y_true, proba, y_pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.operators.ranks import before_cells, cell_cuts, running_in_cells
from flowquarry.session import settle


def argmax(proba: str = "proba") -> Column:
    """Index of the first largest probability."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def with_predicted_class(df: DataFrame, proba: str = "proba") -> DataFrame:
    return df.withColumn("y_pred", argmax(proba))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"))


def confusion_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(pred: DataFrame, classes: int) -> DataFrame:
    """All classes x classes cells, empty ones as 0; class ids are fixed, whatever the data holds."""
    spark = pred.sparkSession
    grid = spark.range(classes).select(
        F.col("id").cast("int").alias("y_true"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("y_pred"))
    return grid.join(confusion_counts(pred), ["y_true", "y_pred"], "left").fillna(0, ["n"])


def per_class_scores(pred: DataFrame, classes: int) -> DataFrame:
    """Precision, recall, F1, support and accuracy per class, 0 where undefined."""
    cells = F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit")))
    sums = confusion_matrix(pred, classes).select(F.inline(cells)).groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("predicted").alias("_predicted"), F.sum("hit").alias("_hit"))
    hit, support, predicted = F.col("_hit"), F.col("support"), F.col("_predicted")
    return sums.select(
        "class", _ratio(hit, predicted).alias("precision"), _ratio(hit, support).alias("recall"),
        _ratio(hit * 2, support + predicted).alias("f1"), "support")


def benign_id(dimension: DataFrame, benign: str) -> int:
    """Class id of the benign label, 0 when the label does not occur."""
    row = dimension.filter(F.col("label") == benign).select("label_id").first()
    return int(row[0]) if row else 0


def binary_counts(pred: DataFrame, benign: int = 0) -> DataFrame:
    attack, flagged = F.col("y_true") != benign, F.col("y_pred") != benign
    return pred.agg(
        F.count_if(~attack & ~flagged).alias("tn"), F.count_if(~attack & flagged).alias("fp"),
        F.count_if(attack & ~flagged).alias("fn"), F.count_if(attack & flagged).alias("tp"))


def detection_rates(counts: DataFrame) -> DataFrame:
    """Detection rate, false-alarm rate and precision for attacks, 0 where there is nothing to rate."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "detection_rate": _ratio(tp, tp + fn), "false_alarm_rate": _ratio(fp, fp + tn),
        "attack_precision": _ratio(tp, tp + fp)})


def attack_type_rates(pred: DataFrame, benign: int = 0) -> DataFrame:
    """Per attack class that occurs: rows, rows given exactly that class, and the share."""
    return pred.filter(F.col("y_true") != benign).groupBy("y_true").agg(
        F.count("*").alias("samples"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("detected")
    ).withColumn("detection_rate", F.col("detected") / F.col("samples"))


def class_accuracy(pred: DataFrame, classes: int) -> DataFrame:
    """Accuracy per class id, 0 for a class without rows."""
    hits = pred.groupBy("y_true").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"))
    ids = pred.sparkSession.range(classes).select(F.col("id").cast("int").alias("y_true"))
    return ids.join(hits, "y_true", "left").fillna(0.0, ["accuracy"])


def score_ranks(pred: DataFrame) -> DataFrame:
    """(class, score, pos, neg, all_pos, all_neg, ..): one-vs-rest counts with running counts, from the highest score down, inside a cell of scores."""
    long = pred.select("y_true", F.posexplode("proba").alias("class", "score")).withColumn("_down", -F.col("score"))
    hit = F.col("y_true") == F.col("class")
    cuts = cell_cuts(long, ["class"], "_down", {"all_pos": F.count_if(hit), "all_neg": F.count_if(~hit)})
    counted = long.groupBy("class", "_down").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    both = cuts.filter("all_pos > 0 AND all_neg > 0")
    return running_in_cells(counted, both, ["class"], "_down", ["pos", "neg"]).withColumn("score", -F.col("_down")).drop("_down")


def _score_cells(ranks: DataFrame, *aggs: Column) -> DataFrame:
    cells = ranks.groupBy("class", "all_pos", "all_neg", "_cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *aggs)
    return before_cells(cells, ["class"], ["pos", "neg"])


def roc_points(ranks: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct score; classes without both sides are left out."""
    ranks = settle(ranks, "score-ranks")
    before = _score_cells(ranks).select("class", "_cell", "before_pos", "before_neg")
    return ranks.join(F.broadcast(before), ["class", "_cell"]).select(  # at most 256 rows a class
        "class", "score", ((F.col("before_neg") + F.col("in_neg")) / F.col("all_neg")).alias("fpr"),
        ((F.col("before_pos") + F.col("in_pos")) / F.col("all_pos")).alias("tpr"))


def roc_auc(ranks: DataFrame) -> DataFrame:
    """Area under each curve by trapezoids; tied scores form one step."""
    large = lambda c: F.col(c).cast("decimal(19,0)")
    step = large("neg") * (large("in_pos") * 2 - large("pos"))
    area = F.col("_area").cast("double") + 2.0 * F.col("before_pos") * F.col("neg")
    return _score_cells(ranks, F.sum(step).alias("_area")).groupBy("class", "all_pos", "all_neg").agg(F.sum(area).alias("_area")).select(
        "class", (F.col("_area") / (F.col("all_pos").cast("double") * F.col("all_neg") * 2)).alias("auc"))


def calibration_bins(pred: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, accuracy, confidence) for equal bins (lo, hi] of the largest probability."""
    scored = pred.select(
        F.array_max("proba").alias("conf"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit"))
    return scored.withColumn("bin", F.ceil(F.col("conf") * bins).cast("int")).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("conf").alias("confidence"))


def calibration_error(pred: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error; a confidence of exactly 0 is in no bin but counts in the total."""
    gap = F.when(F.col("bin") > 0, F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")).otherwise(0.0)
    return calibration_bins(pred, bins).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def class_cross_entropy(pred: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of -ln(p of the true class, clipped to 1e-12..1) per true class (and e.g. fold, stage)."""
    p = F.get("proba", F.col("y_true"))
    loss = -F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0)))
    return pred.groupBy(*by, "y_true").agg(F.avg(loss).alias("cross_entropy"))


def mean_over_folds(losses: DataFrame, by: tuple[str, ...] = ("y_true",)) -> DataFrame:
    """Average per class over the folds where the class occurs."""
    return losses.groupBy(*by).agg(F.avg("cross_entropy").alias("cross_entropy"), F.count("cross_entropy").alias("folds"))


def loss_curve(losses: DataFrame, classes: int, stages: int) -> DataFrame:
    """(y_true, stage, cross_entropy) for every class and stage 1..stages; NULL where nothing was measured."""
    spark: SparkSession = losses.sparkSession
    grid = spark.range(classes).select(
        F.col("id").cast("int").alias("y_true"), F.explode(F.sequence(F.lit(1), F.lit(stages))).alias("stage"))
    return grid.join(losses, ["y_true", "stage"], "left")


def _numbers(keys: Column, values: Column, when: Column) -> Column:
    """Aggregate: map of the keys and values of the rows for which ``when`` holds."""
    return F.map_from_entries(F.collect_list(F.when(when, F.struct(keys, values))))


def report(pred: DataFrame, dimension: DataFrame, benign: str, bins: int = 10) -> DataFrame:
    """One row with the basic metrics, the intrusion-detection metrics and the confusion matrix.

    One scan: rows are counted by grouping sets over class, predicted class and confidence bin, and everything else
    follows from these few counts.
    """
    names = [r["label"] for r in dimension.orderBy("label_id").collect()]
    classes, safe = len(names), benign_id(dimension, benign)
    scored = pred.select(
        "y_true", "y_pred", F.ceil(F.array_max("proba") * bins).cast("int").alias("bin"), F.array_max("proba").alias("conf"),
        (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit"))
    axes = ("y_true", "y_pred", "bin")
    sets = scored.groupingSets([["y_true", "y_pred"], ["y_true"], ["y_pred"], ["bin"], []], *axes).agg(
        F.grouping_id().alias("set"), F.count("*").alias("n"), F.sum("hit").alias("hit"), F.sum("conf").alias("conf"))
    of = {name: F.col("set") == code for name, code in (("pair", 0b001), ("true", 0b011), ("pred", 0b101), ("bin", 0b110), ("all", 0b111))}
    gap = F.when(of["bin"] & (F.col("bin") > 0), F.abs(F.col("hit") - F.col("conf"))).otherwise(0.0)
    found = sets.agg(
        F.max(F.when(of["all"], F.col("n"))).alias("rows"), F.max(F.when(of["all"], F.col("hit"))).alias("hits"), F.sum(gap).alias("gap"),
        _numbers(F.col("y_true") * classes + F.col("y_pred"), F.col("n"), of["pair"]).alias("pairs"),
        _numbers(F.col("y_true"), F.col("n"), of["true"]).alias("actual"), _numbers(F.col("y_pred"), F.col("n"), of["pred"]).alias("given"))
    ids = F.sequence(F.lit(0), F.lit(classes - 1))
    count = lambda numbers, k: F.coalesce(F.try_element_at(numbers, k), F.lit(0).cast("long"))
    cell = lambda i, j: count(F.col("pairs"), i * classes + j)
    found = found.withColumns({
        "confusion": F.transform(ids, lambda i: F.transform(ids, lambda j: cell(i, j))),
        "support": F.transform(ids, lambda i: count(F.col("actual"), i)), "predicted": F.transform(ids, lambda i: count(F.col("given"), i))})
    hit, support, predicted = (lambda i: cell(i, i)), (lambda i: F.get("support", i)), (lambda i: F.get("predicted", i))
    found = found.withColumn("tn", hit(F.lit(safe))).withColumns({
        "fp": support(F.lit(safe)) - F.col("tn"), "fn": predicted(F.lit(safe)) - F.col("tn")})
    found = detection_rates(found.withColumn("tp", F.col("rows") - F.col("tn") - F.col("fp") - F.col("fn")))
    texts = F.array(*[F.lit(n) for n in names])
    types = F.transform(F.filter(ids, lambda i: (i != safe) & (support(i) > 0)), lambda i: F.struct(
        F.get(texts, i).alias("label"), support(i).alias("samples"), hit(i).alias("detected"), (hit(i) / support(i)).alias("detection_rate")))
    return found.select(
        (F.col("hits") / F.col("rows")).alias("accuracy"),
        F.struct(
            F.transform(ids, lambda i: _ratio(hit(i), predicted(i))).alias("precision"),
            F.transform(ids, lambda i: _ratio(hit(i), support(i))).alias("recall"),
            F.transform(ids, lambda i: _ratio(hit(i) * 2, support(i) + predicted(i))).alias("f1"), "support").alias("per_class"),
        F.struct("tn", "fp", "fn", "tp").alias("binary_confusion"),
        "detection_rate", "false_alarm_rate", "attack_precision",
        F.sort_array(types).alias("attack_types"), "confusion",
        (F.col("gap") / F.col("rows")).alias("calibration_error"), texts.alias("class_names"))
