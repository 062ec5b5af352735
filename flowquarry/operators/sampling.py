"""Class counts, quotas and reproducible samples.

Every sample takes the first rows of a seeded hash order of the row key, so it
does not change with partitioning, retries or the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.config import BENIGN
from flowquarry.operators.columns import quoted
from flowquarry.operators.positions import attach, bottom_rows, first_by_hash, hash_positions, order_hash
from flowquarry.session import settle


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(quoted(label).alias("label")).agg(F.count("*").alias("n"))


def label_distribution(df: DataFrame, label: str = "label", source: str = "source") -> DataFrame:
    """Rows and number of sources per label, from the small (label, source) counts."""
    per_source = df.groupBy(quoted(label).alias("label"), quoted(source).alias("source")).agg(F.count("*").alias("n"))
    return per_source.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("files"))


def class_audit(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage (2 decimals) per class, largest first."""
    counts = label_counts(df, label)
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("label", "n", F.round(F.col("n") / total * 100, 2).alias("percent")).orderBy(
        F.desc("n"), "label")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight rows / (classes * rows of the class)."""
    counts = label_counts(df, label)
    everything = Window.partitionBy()
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return counts.select("label", "n", weight.alias("weight"))


def per_file_quota(target: int, files: int) -> int:
    return max(1, target // files)


def _source_counts(attack: DataFrame, label: str, source: str) -> DataFrame:
    counts = attack.groupBy(quoted(label).alias("label"), quoted(source).alias("source")).agg(F.count("*").alias("n"))
    return settle(counts, "attack-counts")


def _mark_rare(per_source: DataFrame, target: int) -> DataFrame:
    quota = per_file_quota(target, max(1, per_source.select("source").distinct().count()))
    return per_source.groupBy("label").agg(F.sum("n").alias("n")).select(
        "label", "n", F.lit(quota).alias("quota"), (F.col("n") < quota * 0.8).alias("is_rare"))


def rare_labels(attack: DataFrame, target: int, label: str = "label", source: str = "source") -> DataFrame:
    """Counts per attack label with the per-source quota and ``is_rare``: fewer rows than 80 % of that quota."""
    return _mark_rare(_source_counts(attack, label, source), target)


def _take(
    flows: DataFrame, is_benign: Column, benign_target: int, attack_target: int, seed: int, key: str, label: str, source: str
) -> DataFrame:
    """Sampled rows with ``_kind``: benign ones and those of common attack labels by quotas per source, all of rare labels.

    One scan counts (label, source), everything else about the sample follows from these counts, and one scan takes the rows.
    """
    rows = flows.withColumns({"_on": F.struct(quoted(label).alias("label"), quoted(source).alias("source")), "_order": order_hash(seed, key)})
    counts = settle(rows.groupBy("_on").agg(F.first(is_benign).alias("benign"), F.count("*").alias("n")), "label-source-counts")
    files = counts.agg(*[F.count_distinct(F.when(own, F.struct(F.col("_on.source")))).alias(c) for c, own in (
        ("benign", F.col("benign")), ("attack", ~F.col("benign")))]).first()
    quota = per_file_quota(attack_target, max(1, files["attack"]))
    of_label = Window.partitionBy("_on.label")
    kind = F.when(F.col("benign"), "benign").when(F.sum("n").over(of_label) < quota * 0.8, "rare").otherwise("common")
    of_source = Window.partitionBy("_on.source")
    marked = counts.withColumn("_kind", kind)
    marked = marked.withColumn("_rare", F.coalesce(F.sum(F.when(F.col("_kind") == "rare", F.col("n"))).over(of_source), F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("_on.source", "_kind"))
    limit = F.when(F.col("_kind") == "benign", F.lit(per_file_quota(benign_target, max(1, files["benign"])))).when(
        F.col("_kind") == "rare", total).otherwise(F.greatest(F.lit(quota) - F.col("_rare"), F.lit(0)))
    limits = marked.select("_on", F.struct(F.col("_on.source"), "_kind").alias("_group"), total.alias("n"), limit.cast("long").alias("quota"))
    taken = bottom_rows(rows, limits, ["_order", key], "_on", "_group")
    return taken.withColumn("_kind", F.col("_group._kind")).drop("_on", "_order", "_group")


def sample_attacks(
    attack: DataFrame, target: int, seed: int, key: str, label: str = "label", source: str = "source"
) -> DataFrame:
    """All rows of rare labels; the rest of each source's quota from common labels; full duplicates dropped."""
    return _take(attack, F.lit(False), 0, target, seed, key, label, source).drop("_kind").dropDuplicates()


def sample_uniform(
    df: DataFrame, quota: int, seed: int, key: str, groups: Sequence[str] = ("source",)
) -> DataFrame:
    """At most ``quota`` rows of each group; what a small group cannot fill is not moved to others."""
    ordered = df.withColumn("_order", order_hash(seed, key))
    return first_by_hash(ordered, list(groups), ["_order", key], quota).drop("_order")


def sample_benign(df: DataFrame, target: int, seed: int, key: str, source: str = "source") -> DataFrame:
    """An even quota of rows from every source."""
    return _take(df.withColumn("_benign", F.lit(True)), F.lit(True), target, 0, seed, key, "_benign", source).drop("_kind", "_benign")


def balance(
    flows: DataFrame,
    size: int,
    benign_ratio: float,
    seed: int,
    key: str = "row_key",
    label: str = "label",
    source: str = "source",
) -> DataFrame:
    """Benign share ``benign_ratio`` of ``size`` rows, the rest attacks with rare labels kept."""
    benign_needed = int(size * benign_ratio)
    labelled = flows.filter(quoted(label).isNotNull())
    taken = _take(labelled, quoted(label) == BENIGN, benign_needed, size - benign_needed, seed, key, label, source)
    kinds = taken.agg(F.count_if(F.col("_kind") == "benign"), F.count_if(F.col("_kind") != "benign")).first()
    if not all(kinds):
        raise ValueError("both benign and attack rows are needed")
    benign, attack = taken.filter("_kind = 'benign'").drop("_kind"), taken.filter("_kind <> 'benign'").drop("_kind")
    return benign.unionByName(attack.dropDuplicates())


def shuffled(df: DataFrame, seed: int, key: str, pos: str = "shuffle_pos") -> DataFrame:
    """Position of each row in a seeded shuffle; sort by it where an order is consumed."""
    ordered = df.withColumn("_order", order_hash(seed, key))
    return hash_positions(ordered, [], ["_order", key], pos).drop("_order")


def oversample(df: DataFrame, required: int, seed: int, key: str, label: str = "label") -> DataFrame:
    """Classes with fewer than ``required`` rows get that many, by draws with replacement.

    Only rows of such classes are numbered and copied; draw j of a class takes the row at position md5(seed|label|j) mod n.
    """
    counts = label_counts(df, label).filter(F.col("n") < required).withColumnRenamed("label", label)
    small = settle(attach(df, counts, [label]).withColumn("_order", order_hash(seed, key)), "small-classes")
    numbered = hash_positions(small, [label], ["_order", key], "_pos")
    drawn = order_hash(seed, label, F.col("_draw").cast("string"))
    draws = counts.select(label, "n", F.explode(F.sequence(F.lit(0), F.lit(required) - F.col("n") - 1)).alias("_draw"))
    draws = draws.select(
        label, "_draw", F.pmod(F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long"), F.col("n")).alias("_pos"))
    copies = numbered.join(draws, [label, "_pos"]).select(*[quoted(c) for c in df.columns], (F.col("_draw") + 1).cast("int").alias("copy"))
    return df.withColumn("copy", F.lit(0)).unionByName(copies)


def label_quotas(df: DataFrame, cap: int, label: str = "label", source: str = "source") -> DataFrame:
    """Rows to draw per label and source: max(1, min(cap // sources, rows // sources))."""
    d = label_distribution(df, label, source)
    quota = F.greatest(F.lit(1), F.least(F.expr(f"{cap} div files"), F.expr("total div files")))
    return d.withColumn("quota", quota.cast("long"))


def sample_labels(
    df: DataFrame, cap: int, seed: int, key: str, label: str = "label", source: str = "source"
) -> DataFrame:
    """The quota of :func:`label_quotas` from every (source, label), all rows where there are fewer."""
    rows = df.withColumns({"_on": F.struct(quoted(label).alias("label"), quoted(source).alias("source")), "_order": order_hash(seed, key)})
    of_label = Window.partitionBy("_on.label")
    files, total = F.count("*").over(of_label), F.sum("n").over(of_label)
    counts = rows.groupBy("_on").agg(F.count("*").alias("n")).withColumns({"_files": files, "_total": total})
    quota = F.greatest(F.lit(1), F.least(F.expr(f"{cap} div _files"), F.expr("_total div _files")))
    return bottom_rows(rows, counts.select("_on", "n", quota.cast("long").alias("quota")), ["_order", key], "_on").drop("_on", "_order")


def head_rows(df: DataFrame, n: int, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of each group in a given order (a deterministic head).

    Tasks cut each group to ``n`` rows before the shuffle, so only these move; ``order`` must be unique per group.
    """
    first = Window.partitionBy(*[quoted(g) for g in groups]).orderBy(*[quoted(c) for c in order])
    return df.withColumn("_pos", F.row_number().over(first)).filter(F.col("_pos") <= n).drop("_pos")


def client_parts(
    df: DataFrame, clients: int, seed: int, key: str, label: str | None = None, out: str = "client"
) -> DataFrame:
    """Near-equal parts for ``clients``: of a seeded shuffle, or of the label order when ``label`` is given."""
    ordered = df.withColumn("_order", order_hash(seed, key))
    if label is None:
        placed = hash_positions(ordered, [], ["_order", key], "_pos", "_all")
    else:
        per_label = hash_positions(ordered, [label], ["_order", key], "_in_label")
        earlier = Window.partitionBy().orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
        starts = label_counts(df, label).select(
            F.col("label").alias(label),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"),
            F.sum("n").over(Window.partitionBy()).alias("_all"))
        placed = attach(per_label, starts, [label]).withColumn("_pos", F.col("_start") + F.col("_in_label"))
        placed = placed.drop("_start", "_in_label")
    small, larger = F.expr(f"_all div {clients}"), F.col("_all") % clients
    boundary = larger * (small + 1)
    client = F.when(F.col("_pos") < boundary, F.floor(F.col("_pos") / (small + 1))).otherwise(
        larger + F.floor((F.col("_pos") - boundary) / F.greatest(small, F.lit(1))))
    return placed.withColumn(out, client.cast("int")).drop("_order", "_pos", "_all")
