"""Benchmark passages in training text, found by spaced seeds; column expressions only.

A mask such as ``1101011`` laid on consecutive words hashes the words under its ones and
ignores those under its zeros, so a seed survives a substituted word there. Documents and
benchmark items meet by equal seeds. A hit fixes how the item lies on the document; the
words that lie on each other are then compared, and an item counts as found if some
``window`` consecutive words of it (all, if it is shorter) agree in at least ``share``.

The masks depend on how many words are compared: under every choice of as many substituted
words as ``share`` allows, one of them fits somewhere into what is left. So the search loses
nothing; items of up to three words allow no substitution and are joined as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.session import settle

Masks = tuple[tuple[int, tuple[str, ...]], ...]

# (compared words from, masks), found by trying all choices of substituted words for WINDOW and SHARE
MASKS = (
    (1, ("1",)),
    (2, ("11",)),
    (3, ("111",)),
    (4, ("111", "1101", "1011")),
    (6, ("11011", "1111", "1100011")),
    (9, ("11101", "100111")),
    (14, ("111011", "1110000101", "1001111")),
)
WINDOW = 16
SHARE = 0.75
BROADCAST_SEEDS = 2_000_000  # seeds of the benchmark that are broadcast (about 50 MB); more of them are joined by a shuffle


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for NULL."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed_at(mask: str):
    def seed(i: Column) -> Column:
        words = [F.get("_codes", i + k) for k, bit in enumerate(mask) if bit == "1"]
        return F.struct(i.alias("pos"), F.xxhash64(F.lit(mask), *words).alias("seed"))

    return seed


def _seed_rows(df: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """A row (.., pos, seed) per mask and place of a table with ``_words``; a text shorter than a mask has none of it."""
    coded = df.withColumn("_codes", F.transform("_words", lambda w: F.xxhash64(w))).select(*keep, "_codes")
    arrays = []
    for mask in masks:
        last = F.size("_codes") - len(mask)
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        arrays.append(F.transform(places, _seed_at(mask)))
    return coded.select(*keep, F.inline(F.concat(*arrays)))


def _item_seeds(items: DataFrame, masks: Masks) -> tuple[DataFrame, tuple[str, ...]]:
    """Seeds of all items by the masks for their length, and the masks that any item uses."""
    sized = items.withColumn("_length", F.size("_words")).withColumn("_class", sum([(F.size("_words") >= n).cast("int") for n, _ in masks], F.lit(0)))
    used = [r[0] for r in sized.filter("_class > 0").select("_class").distinct().collect()]  # classes of MASKS
    parts = [_seed_rows(sized.filter(F.col("_class") == c), ["_item_no", "_length"], masks[c - 1][1]) for c in sorted(used)]
    seeds = reduce(DataFrame.unionByName, parts) if parts else _seed_rows(sized.limit(0), ["_item_no", "_length"], ("1",))
    return settle(seeds.withColumnRenamed("pos", "_item_pos"), "item-seeds"), tuple(dict.fromkeys(m for c in sorted(used) for m in masks[c - 1][1]))


def _document_key(text: str, key: str) -> list[Column]:
    # Rows that share key and text share their verdict, so no further row identity is needed.
    return [F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_digest")]


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
    item_text: str = "text", item_key: str = "item_id",
    masks: Masks = MASKS, window: int = WINDOW, share: float = SHARE,
) -> DataFrame:
    """(_key, _digest, item, n_equal, n_window) of every document and benchmark item found in it.

    Items without words are found nowhere. A NULL item key is a key like any other; of items with the same key each text
    counts. NULL and empty documents hold no item; rows that repeat key and text have one verdict; very long documents are
    read whole, and only the stretches under a hit are compared. Columns other than those named are not read. Empty
    tables give no rows. ``masks`` is complete for the given window and share; others need their own.
    """
    items = settle(
        benchmark.select(F.col(f"`{item_key}`").alias("_item"), words_of(F.col(f"`{item_text}`")).alias("_words"))
        .withColumn("_item_no", F.monotonically_increasing_id()), "items")
    item_seeds, used = _item_seeds(items, masks)
    few = item_seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    table = docs.select(*_document_key(text, key), F.col(f"`{text}`").cast("string").alias("_text"))
    doc_seeds = _seed_rows(table.withColumn("_words", words_of(F.col("_text"))), ["_key", "_digest"], used or ("1",))
    hits = settle(
        doc_seeds.join(F.broadcast(item_seeds) if few else item_seeds, "seed")
        .select("_key", "_digest", "_item_no", "_length", (F.col("pos") - F.col("_item_pos")).alias("_shift"))
        # of an item that has to be there as a whole one place is enough
        .groupBy("_key", "_digest", "_item_no", "_length", F.when(F.col("_length") > 3, F.col("_shift")).alias("_each")).agg(F.min("_shift").alias("_shift"))
        .groupBy("_key", "_digest").agg(F.collect_list(F.struct("_item_no", "_length", "_shift")).alias("_hits")), "hits")
    # each document's words once, then only the stretch that lies under an item
    same = (F.col("a._key").eqNullSafe(F.col("b._key"))) & (F.col("a._digest") == F.col("b._digest"))
    stretches = (
        table.alias("a").join(hits.alias("b"), same)
        .select("a._key", "a._digest", words_of(F.col("a._text")).alias("_words"), "_hits")
        .select("_key", "_digest", F.inline(F.transform("_hits", lambda h: F.struct(
            h["_item_no"].alias("_item_no"), F.greatest(-h["_shift"], F.lit(0)).alias("_from"),
            F.slice("_words", F.greatest(h["_shift"], F.lit(0)) + 1,
                    F.greatest(h["_length"] + F.least(h["_shift"], F.lit(0)), F.lit(0))).alias("_stretch"))))))
    equal = F.zip_with(
        "_stretch", F.slice("_words", F.col("_from") + 1, F.size("_stretch")),
        lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    compared = stretches.join(items, "_item_no").select(
        "_key", "_digest", F.col("_item").alias("item"), equal.alias("_equal"),
        F.least(F.size("_words"), F.lit(window)).alias("n_window"))
    starts = F.when(F.size("_equal") >= F.col("n_window"), F.sequence(F.lit(1), F.size("_equal") - F.col("n_window") + 1))
    best = F.array_max(F.transform(starts, lambda k: F.aggregate(
        F.slice("_equal", k, F.col("n_window")), F.lit(0), lambda total, e: total + e)))
    found = compared.withColumn("n_equal", best).filter(F.col("n_equal") >= F.ceil(F.lit(share) * F.col("n_window")))
    return found.groupBy("_key", "_digest", "item").agg(F.max(F.struct("n_equal", "n_window")).alias("b")).select(
        "_key", "_digest", "item", "b.n_equal", "b.n_window")


def contamination_report(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """A row per document: key, contaminated, n_items, item_id (best match), n_equal and n_window words of it.

    Every row of ``docs`` is returned, NULL keys and texts and repeated rows too; of equally good items the smallest key counts.
    """
    found = contamination(docs, benchmark, text, key, **settings)
    best = F.min(F.struct((-F.col("n_equal") / F.col("n_window")).alias("part"), (-F.col("n_equal")).alias("least"), "item", "n_equal", "n_window")).alias("best")
    verdicts = found.groupBy("_key", "_digest").agg(F.count("*").alias("n_items"), best)
    rows = docs.select(*_document_key(text, key))
    same = (F.col("a._key").eqNullSafe(F.col("b._key"))) & (F.col("a._digest") == F.col("b._digest"))
    return rows.alias("a").join(verdicts.alias("b"), same, "left").select(
        F.col("a._key").alias(key), F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best.item").alias("item_id"),
        F.col("best.n_equal").alias("n_equal"), F.col("best.n_window").alias("n_window"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """``docs`` without the rows in which a benchmark item was found; all columns stay as they are.

    Rows with NULL or empty texts stay, as do repeated rows without an item; an empty table stays empty.
    """
    found = contamination(docs, benchmark, text, key, **settings).select("_key", "_digest").distinct()
    same = F.col(f"a.`{key}`").eqNullSafe(F.col("b._key")) & (F.xxhash64(F.col(f"a.`{text}`")) == F.col("b._digest"))
    return docs.alias("a").join(found.alias("b"), same, "left_anti")
