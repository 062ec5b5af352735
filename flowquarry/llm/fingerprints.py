"""Document fingerprints by I-Match over randomised lexicon subsets; column expressions only.

The lexicon is the terms whose inverse document frequency lies in a band: commoner terms say little, rarer ones are
typing errors and the like. A fingerprint is a list of hashes. Each is that of a text's sorted distinct terms in one
random subset of the lexicon, so it survives every change outside its subset. Subsets come in levels, each a quarter
as dense as the one before; a text uses the three levels at which a subset holds about one to four of its terms, a
quarter of that, and a sixteenth. Two texts are as alike as the share of equal hashes among the subsets that hold a
term of either, on the levels that both use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.decontamination import words_of
from flowquarry.operators.positions import attach, ordered_positions, salted_join
from flowquarry.session import settle

RAREST = 1 / 2_000  # share of the documents that hold a term of the lexicon, at least ..
COMMONEST = 0.4  # .. and at most; a text that a third of all rows repeat keeps its terms
LEAST_DOCUMENTS = 2
LEAST_KNOWN = 8  # a text with fewer terms in the lexicon uses all of its terms
SUBSETS = 16  # of a level
LEVELS = 3  # of a text
FILL = 4  # terms of a text in one subset of its first level, at most on average
BROADCAST_TERMS = 2_000_000  # of the lexicon, about 100 MB; a larger one is joined by a shuffle with salted terms
BUCKET_BYTES = 32 << 20


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named: array functions do not share their arguments."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def term_codes(text: Column) -> Column:
    """Sorted 62-bit hashes of the distinct terms of a text; of a text without words, the hash of the text."""
    some = bound(words_of(text), lambda words: F.when(F.size(words) > 0, words).otherwise(F.array(F.coalesce(text, F.lit("")))))
    return F.array_sort(F.array_distinct(F.transform(some, lambda w: F.shiftrightunsigned(F.xxhash64(w), 2))))


def lexicon(texts: DataFrame, text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """(term) of the terms whose document frequency lies in the band, written; counted in the map tasks first."""
    rows = texts.count()
    counts = texts.select(F.explode(term_codes(F.col(f"`{text}`"))).alias("term")).groupBy("term").count()
    in_band = F.col("count").between(max(LEAST_DOCUMENTS, rarest * rows), commonest * rows)
    return settle(counts.filter(in_band).select("term"), "lexicon")


def fingerprint(codes: Column) -> Column:
    """struct(level, hashes) of an array of 2 * term code + (1 if the term is in the lexicon).

    ``hashes`` has a text of 8 digits for each of LEVELS * SUBSETS subsets, empty where a subset holds no term.
    """
    def of_terms(terms: Column) -> Column:
        size = F.greatest(F.size(terms), F.lit(1))
        level = F.greatest(F.lit(0), F.ceil(F.log(size / F.lit(float(FILL * SUBSETS))) / F.log(F.lit(4.0)))).cast("int")
        return bound(F.struct(level.alias("level"), terms.alias("terms")), _hashes)

    known = bound(F.filter(codes, lambda c: c.bitwiseAND(1) == 1), lambda k: F.when(F.size(k) >= LEAST_KNOWN, k).otherwise(codes))
    return bound(F.array_sort(F.transform(known, lambda c: F.shiftright(c, 1))), of_terms)


def _hashes(found: Column) -> Column:
    level = found["level"]
    first = F.filter(found["terms"], lambda t: t.bitwiseAND(_mask(level)) == 0)  # about FILL * SUBSETS of them
    hashes = bound(first, lambda kept: F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda j: _level(F.filter(kept, lambda t: t.bitwiseAND(_mask(level + j)) == 0), level + j))))
    return F.struct(level.alias("level"), hashes.alias("hashes"))


def _mask(level: Column) -> Column:
    return F.call_function("shiftleft", F.expr("1L"), level * 2) - 1


def _level(terms: Column, level: Column) -> Column:
    # which subset a term falls into differs from level to level
    dealt = F.transform(terms, lambda t: F.struct(F.xxhash64(t, level).bitwiseAND(SUBSETS - 1).alias("subset"), t.alias("term")))

    def digits(own: Column) -> Column:
        code = F.lower(F.substring(F.lpad(F.hex(F.xxhash64(F.transform(own, lambda d: d["term"]))), 16, "0"), 1, 8))
        return F.when(F.size(own) > 0, code).otherwise("")

    return bound(dealt, lambda pairs: F.transform(
        F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: bound(F.filter(pairs, lambda d: d["subset"] == k), digits)))


def written(found: Column) -> Column:
    """A fingerprint as text: its level, then the hashes."""
    return F.concat_ws(" ", found["level"].cast("string"), F.transform(found["hashes"], lambda h: F.when(h == "", "-").otherwise(h)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: equal hashes among the subsets with a term of either text, on the levels that both use."""
    apart = b["level"] - a["level"]
    length = F.greatest(F.lit(SUBSETS) * (F.lit(LEVELS) - F.abs(apart)), F.lit(0))
    ours = F.slice(a["hashes"], F.least(F.lit(SUBSETS) * F.greatest(apart, F.lit(0)), F.lit(SUBSETS * LEVELS)) + 1, length)
    theirs = F.slice(b["hashes"], F.least(F.lit(SUBSETS) * F.greatest(-apart, F.lit(0)), F.lit(SUBSETS * LEVELS)) + 1, length)
    pairs = F.filter(F.arrays_zip(ours.alias("x"), theirs.alias("y")), lambda p: (p["x"] != "") | (p["y"] != ""))
    share = F.size(F.filter(pairs, lambda p: p["x"] == p["y"])) / F.greatest(F.size(pairs), F.lit(1))
    return F.when(a == b, 1.0).otherwise(share).cast("double")


def known_terms(rows: DataFrame, names: DataFrame, arrays: tuple[str, ...]) -> DataFrame:
    """``rows`` with the term codes in each of ``arrays`` as 2 * code + (1 if in the lexicon); other columns tell rows apart.

    Up to BROADCAST_TERMS the lexicon is broadcast, and rows that are dealt by some of their columns stay where they are.
    """
    keys = [F.col(c) for c in rows.columns if c not in arrays]

    def coded(number: int, name: str) -> Column:
        return F.transform(name, lambda t: F.struct(t.alias("term"), F.lit(number).alias("array")))

    single = rows.select(*keys, F.explode_outer(F.concat(*[coded(i, c) for i, c in enumerate(arrays)])).alias("t")).select(*keys, "t.term", "t.array")
    known = names.withColumn("known", F.lit(1))
    few = names.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    met = single.join(F.broadcast(known), "term", "left") if few else salted_join(single, known, ["term"], "left")
    code = F.col("term") * 2 + F.coalesce("known", F.lit(0))
    return met.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("array") == i, code)).alias(c) for i, c in enumerate(arrays)])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", names: DataFrame | None = None) -> DataFrame:
    """(key, fingerprint) for every row of ``docs``, under the lexicon ``names`` or that of ``docs``.

    A NULL text counts as empty, a NULL key is a key like others. Rows that repeat key and text get equal results.
    Texts are read whole, each in the task that holds it. Other columns are not read, whatever their names; an empty
    table gives no rows.
    """
    names = lexicon(docs, text) if names is None else names
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.monotonically_increasing_id().alias("_row"), term_codes(value).alias("_terms"))
    found = known_terms(rows, names, ("_terms",)).select("_key", fingerprint(F.col("_terms")).alias("_found"))
    return found.select(F.col("_key").alias(key), written(F.col("_found")).alias("fingerprint"))


def _in_order(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows dealt to buckets (_cell, _part) of the order by descending key, each with the row after its last (_ghost).

    Rows of one key go by a hash of their text, then by the text; NULL keys come last. Cells cut the range of keys
    evenly, a cell of more than BUCKET_BYTES is cut again by its own range, or by the hash if it has one key only.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), value.alias("_text"), F.xxhash64(value).alias("_hash"))
    size = F.sum(F.octet_length("_text").cast("long"))
    all_rows = rows.agg(F.min("_key").cast("double").alias("lo"), F.max("_key").cast("double").alias("hi"), size.alias("bytes")).first()
    cells = max(-(-int(all_rows["bytes"] or 0) // BUCKET_BYTES), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lo, hi = all_rows["lo"] or 0.0, all_rows["hi"] or 0.0
    cell = F.floor((F.lit(hi) - F.col("_key").cast("double")) / F.lit((hi - lo + 1) / cells)).cast("long")
    rows = rows.withColumn("_cell", F.coalesce(cell, F.lit(cells + 1).cast("long")))
    stats = rows.groupBy("_cell").agg(
        F.min("_key").cast("double").alias("_lo"), F.max("_key").cast("double").alias("_hi"),
        F.ceil(size / BUCKET_BYTES).alias("_parts"))
    of_range = (F.col("_hi") - F.col("_key").cast("double")) / (F.col("_hi") - F.col("_lo") + 1)
    of_hash = (F.shiftright("_hash", 32) + F.lit(1 << 31)) / F.lit(float(1 << 32))
    part = F.when(F.col("_parts") < 2, 0).when(F.col("_hi") > F.col("_lo"), F.floor(of_range * F.col("_parts"))).otherwise(
        F.floor(of_hash * F.col("_parts")))
    rows = attach(rows, stats, ["_cell"]).withColumn("_part", part.cast("long")).drop("_lo", "_hi", "_parts")
    # the first row of every bucket follows the last row of the bucket before
    place = F.struct(F.col("_key").isNull().alias("none"), F.bitwise_not("_key").alias("turned"), F.col("_hash").alias("hash"))
    firsts = rows.groupBy("_cell", "_part").agg(F.min(place).alias("_place"))
    firsts = settle(ordered_positions(firsts, ["_cell", "_part"], pos="_pos"), "buckets")
    buckets = firsts.count()
    texts = attach(rows.withColumn("_place", place), firsts, ["_cell", "_part", "_place"]).groupBy("_pos").agg(
        F.min(F.struct("_key", "_text", "_hash")).alias("_row"))
    before = firsts.select("_cell", "_part", F.expr(f"pmod(_pos + 1, {max(buckets, 1)})").alias("_pos"))
    ghosts = texts.join(before, "_pos").select("_row.*", "_cell", "_part", F.lit(True).alias("_ghost"))
    return rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts)


def fingerprint_stability(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is that of the next smaller key, after the last one the first. The edited text has its last
    floor(n_chars / 3) characters replaced by the first as many (or all) of the next document; near_edited and
    near_next are the likeness of a document's fingerprint to that of its edited text and of the next document.

    A NULL text counts as empty. NULL keys come last; rows of one key follow each other by a hash of their text, repeated
    rows are each other's next. A single document is its own next. Texts are read whole, each in the task that holds
    it, and moved once. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    names = lexicon(docs, text)
    order = Window.partitionBy("_cell", "_part").orderBy("_ghost", F.col("_key").desc_nulls_last(), "_hash", "_text")
    rows = _in_order(docs, text, key).withColumns({"_next": F.lead("_text").over(order), "_row": F.row_number().over(order)})
    length = F.char_length("_text")
    third = F.floor(length / 3).cast("int")
    edited = F.when(~F.col("_ghost"), F.concat(F.substring("_text", F.lit(1), length - third), F.substring("_next", F.lit(1), third)))
    rows = rows.select("_cell", "_part", "_row", "_ghost", "_key", length.cast("long").alias("n_chars"), "_text", edited.alias("_edited"))
    rows = rows.select(
        "_cell", "_part", "_row", "_ghost", "_key", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        term_codes(F.col("_text")).alias("_own"), term_codes(F.col("_edited")).alias("_changed"))
    found = known_terms(rows, names, ("_own", "_changed"))
    found = found.withColumns({"_own": fingerprint(F.col("_own")), "_changed": fingerprint(F.col("_changed"))})
    found = found.withColumn("_after", F.lead("_own").over(Window.partitionBy("_cell", "_part").orderBy("_row"))).filter(~F.col("_ghost"))
    return found.select(
        F.col("_key").alias(key), "n_chars", "edited_sha256", written(F.col("_own")).alias("fingerprint"),
        written(F.col("_changed")).alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_after")).alias("near_next"))
