"""Hard negatives: for an anchor and one of its nearest rows of the same label, the best rows of other labels below it.

Search by inner product after LEMP. A task sorts the rows it reads by length into buckets; each bucket holds, per
coordinate, the list of its rows sorted by that coordinate of their direction. An anchor that looks for scores of at
least t in a bucket whose rows are no longer than l needs directions whose cosine with its own is t / (|anchor| l) or
more. Of such a direction every coordinate lies in a known range, narrowest for the anchor's largest ("focus")
coordinates. The slices of the focus lists are intersected, and only what is in all of them is scored, exactly and in
whole numbers. The score to reach rises while rows are found, and buckets that are too short are skipped.

Anchors are a stated set of rows. They visit the tasks in waves of bounded size; the other rows never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.operators.positions import ordered_positions
from flowquarry.session import settle

SCALE = 256
LARGEST = 1 << 19  # components of this size and more count as not finite: sums of products have to fit into a LONG
POSITIVES = 5
NEGATIVES = 5
PERCENT = 80
WAVE = 8_192  # anchors that are broadcast at once
BUCKET_ROWS = 2_048
FOCUS = 4  # coordinates of an anchor whose lists are intersected
NO_ID = np.iinfo(np.int64).max
NO_SCORE = np.iinfo(np.int64).min
MARGIN = 1e-7  # ranges are widened by this, so that rounding loses no row


def whole_vectors(rows: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """(_id, _label, _vector) of the rows that take part, components as floor(SCALE * x)."""
    x = F.col(f"`{vector}`")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < LARGEST))
    own = F.col(f"`{label}`")
    whole = isinstance(rows.schema[label].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    # a vector with a NULL component gives NULL or false, either of which the filter drops
    return rows.filter(own.isNotNull() & x.isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.col(f"`{key}`").cast("long").alias("_id"), (own.cast("long") if whole else F.xxhash64(own)).alias("_label"),
        F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")).cast("long")).alias("_vector"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``width`` columns, longer ones cut and shorter ones filled with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    values, sizes = vectors.flatten().to_numpy(), np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, inside = np.repeat(np.arange(len(sizes)), sizes), at < width
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[row[inside], at[inside]] = values[inside]
    return out


@dataclass(frozen=True)
class Anchors:
    """One wave of anchors."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))


class Bucket:
    """Rows of similar length with, per coordinate, their order by that coordinate of their direction."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.longest, self.shortest = float(lengths.max(initial=0)), float(lengths.min(initial=0))
        self.directions = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        # sums of products below 2^53 are exact as doubles too, and much faster
        self.largest = int(np.abs(vectors).max(initial=0))
        self.doubles = vectors.astype(float)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values in order, rows in order, place of each row) of a coordinate."""
        if f not in self.lists:
            order = np.argsort(self.directions[:, f], kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            self.lists[f] = (self.directions[order, f], order, place)
        return self.lists[f]

    def candidates(self, direction: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose focus coordinates allow ``cosine`` or more; None for all of them."""
        if cosine <= -1:
            return None
        reach = np.arccos(min(cosine, 1.0))
        turned = np.arccos(np.clip(direction[focus], -1, 1))
        least = np.cos(np.minimum(turned + reach, np.pi)) - MARGIN
        most = np.cos(np.maximum(turned - reach, 0)) + MARGIN
        slices = []
        for f, lo, hi in zip(focus.tolist(), least, most):
            values, order, place = self.sorted_list(f)
            a, b = np.searchsorted(values, lo, side="left"), np.searchsorted(values, hi, side="right")
            if b - a < len(order):
                slices.append((b - a, a, b, order, place))
        if not slices:
            return None
        slices.sort(key=lambda s: s[0])
        _, a, b, order, _ = slices[0]
        found = order[a:b]
        for _, a, b, _, place in slices[1:]:
            at = place[found]
            found = found[(at >= a) & (at < b)]
        return found

    def scores(self, rows: np.ndarray | None, anchor: np.ndarray) -> np.ndarray:
        if self.largest * int(np.abs(anchor).max(initial=0)) * max(len(anchor), 1) < 1 << 53:
            return ((self.doubles if rows is None else self.doubles[rows]) @ anchor.astype(float)).astype(np.int64)
        return (self.vectors if rows is None else self.vectors[rows]) @ anchor


def buckets_of(batch: pa.RecordBatch, width: int) -> Iterator[Bucket]:
    """The rows of a batch by falling length."""
    ids = batch["_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
    labels, vectors = batch["_label"].to_numpy(zero_copy_only=False), matrix(batch["_vector"], width)
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), BUCKET_ROWS):
        own = order[at:at + BUCKET_ROWS]
        yield Bucket(ids[own], labels[own], vectors[own], lengths[own])


def search(batches: Iterator[pa.RecordBatch], anchors: Anchors, least: np.ndarray, take) -> None:
    """Shows each anchor the rows that may score ``least`` (an entry per anchor, which ``take`` raises) or more.

    ``take(anchor number, bucket, rows or None for all, scores)`` is called for what the lists leave over.
    """
    lengths = anchors.lengths
    directions = anchors.vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
    focus = np.argsort(-np.abs(directions), axis=1, kind="stable")[:, :FOCUS]
    for batch in batches:
        for bucket in buckets_of(batch, anchors.vectors.shape[1]):
            for i in range(len(lengths)):
                bound = float(least[i])
                # the smallest cosine that suffices: that of the longest row, or for scores below 0 of the shortest
                length = lengths[i] * (bucket.longest if bound > 0 else bucket.shortest)
                if bound > 0 and bound > length * (1 + MARGIN):
                    continue
                cosine = bound / length - MARGIN if length > 0 else -1.0
                rows = bucket.candidates(directions[i], focus[i], cosine)
                if rows is None or len(rows):
                    take(i, bucket, rows, bucket.scores(rows, anchors.vectors[i]))


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by smaller id."""
    if len(scores) > 4 * n:
        lowest = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= lowest)
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))[:n]


class Leaders:
    """The best rows found so far for each of ``n`` searches."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.scores = np.full((n, size), NO_SCORE, dtype=np.int64)
        self.ids = np.full((n, size), NO_ID, dtype=np.int64)
        self.found = np.zeros(n, dtype=np.int64)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = self.found[i]
        scores, ids = np.concatenate([self.scores[i, :own], scores]), np.concatenate([self.ids[i, :own], ids])
        best = _best(scores, ids, self.size)
        self.found[i] = len(best)
        self.scores[i, :len(best)], self.ids[i, :len(best)] = scores[best], ids[best]

    def last(self, i: int) -> int:
        """The score that a further row has to reach."""
        return int(self.scores[i, -1])


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def _positives(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        least = np.full(len(anchors.ids), float(NO_SCORE))
        leaders = Leaders(len(anchors.ids), size)

        def take(i: int, bucket: Bucket, rows: np.ndarray | None, scores: np.ndarray) -> None:
            labels, ids = (bucket.labels, bucket.ids) if rows is None else (bucket.labels[rows], bucket.ids[rows])
            own = (labels == anchors.labels[i]) & (ids != anchors.ids[i]) & (scores >= leaders.last(i))
            if own.any():
                leaders.add(i, scores[own], ids[own])
                least[i] = leaders.last(i)

        search(batches, anchors, least, take)
        at = np.repeat(np.arange(len(least)), leaders.found)
        slot = np.arange(len(at)) - np.repeat(np.cumsum(leaders.found) - leaders.found, leaders.found)
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(at, pa.int32()), "score": leaders.scores[at, slot], "id": _ids(leaders.ids[at, slot])})

    return run


def _negatives(shared, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (owner, most) = shared.value
        first = np.searchsorted(owner, np.arange(len(anchors.ids) + 1))  # positives are sorted by anchor, then falling score
        floor = np.where(most >= 0, -(-percent * most // 100), NO_ID)  # nothing is between 80 % of a negative score and itself
        leaders = Leaders(len(owner), size)
        bound = floor.copy()
        least = np.full(len(anchors.ids), float(NO_ID))

        def lowered(i: int) -> None:
            least[i] = float(bound[first[i]:first[i + 1]].min(initial=NO_ID))

        for i in range(len(anchors.ids)):
            lowered(i)

        def take(i: int, bucket: Bucket, rows: np.ndarray | None, scores: np.ndarray) -> None:
            labels, ids = (bucket.labels, bucket.ids) if rows is None else (bucket.labels[rows], bucket.ids[rows])
            own = (labels != anchors.labels[i]) & (ids != anchors.ids[i]) & (scores >= least[i]) & (scores <= most[first[i]])
            if not own.any():
                return
            scores, ids = scores[own], ids[own]
            for p in range(first[i], first[i + 1]):
                fits = (scores <= most[p]) & (scores >= bound[p])
                if fits.any():
                    leaders.add(p, scores[fits], ids[fits])
                    bound[p] = max(floor[p], leaders.last(p))
            lowered(i)

        search(batches, anchors, least, take)
        at = np.repeat(np.arange(len(owner)), leaders.found)
        slot = np.arange(len(at)) - np.repeat(np.cumsum(leaders.found) - leaders.found, leaders.found)
        yield pa.RecordBatch.from_pydict({"positive": pa.array(at, pa.int32()), "score": leaders.scores[at, slot], "id": _ids(leaders.ids[at, slot])})

    return run


def _top(found: DataFrame, of: str, n: int) -> DataFrame:
    order = Window.partitionBy(of).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor: Column, vector: str = "embedding", label: str = "label", key: str = "vec_id",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of the vectors, components taken as floor(SCALE * x); higher ones come first, ties by
    smaller key. The positives of an anchor (a row for which ``is_anchor``) are its first ``positives`` rows of the same
    label; for each, the first ``negatives`` rows of other labels are returned whose score lies between ``percent`` of
    the positive's and the positive's own, with rank from 1.

    Rows with a NULL label, a NULL vector or a component that is NULL, not finite or of LARGEST or more take no part; nor
    do anchors without a key. Rows with an anchor's key are never its positives or negatives, other repeated rows count
    each; a repeated anchor counts once. Rows with a NULL key come last in ties. Vectors of unequal length are compared
    over the components that both have, one without components scores 0. Other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("_anchor_mark", is_anchor)  # evaluated before columns are renamed
    anchors = whole_vectors(marked.filter("_anchor_mark"), vector, label, key).filter("_id IS NOT NULL").distinct()
    anchors = settle(anchors, "anchors")
    count = anchors.count()
    waves = -(-count // WAVE)
    if waves > 1:
        anchors = settle(ordered_positions(anchors.withColumn("_vector_hash", F.xxhash64("_vector")), ["_id", "_label", "_vector_hash", "_vector"], pos="_pos"), "anchors")
    everything = whole_vectors(rows, vector, label, key)
    out = []
    for wave in range(max(waves, 1)):
        chosen = anchors.filter((F.col("_pos") >= wave * WAVE) & (F.col("_pos") < (wave + 1) * WAVE)) if waves > 1 else anchors
        held = chosen.orderBy("_id", "_label", "_vector").toArrow()  # at most WAVE rows
        sizes = np.diff(held["_vector"].combine_chunks().offsets.to_numpy()) if len(held) else np.zeros(0, np.int64)
        wave_anchors = Anchors(held["_id"].to_numpy(), held["_label"].to_numpy(), matrix(held["_vector"], int(sizes.max(initial=0))))
        shared = spark.sparkContext.broadcast(wave_anchors)
        near = _top(everything.mapInArrow(_positives(shared, positives), "anchor int, score long, id long"), "anchor", positives)
        near = near.orderBy("anchor", F.desc("score"), F.col("id").asc_nulls_last()).toArrow()  # at most WAVE * positives rows
        owner, most = near["anchor"].to_numpy().astype(np.int64), near["score"].to_numpy()
        both = spark.sparkContext.broadcast((wave_anchors, (owner, most)))
        found = _top(everything.mapInArrow(_negatives(both, negatives, percent), "positive int, score long, id long"), "positive", negatives)
        named = spark.createDataFrame(pa.table({
            "positive": pa.array(np.arange(len(owner)), pa.int32()), "anchor_id": pa.array(wave_anchors.ids[owner], pa.int64()),
            "positive_id": near["id"], "positive_score": near["score"]}))
        result = found.join(F.broadcast(named), "positive").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))
        out.append(settle(result, "negatives") if waves > 1 else result)
    return reduce(DataFrame.unionAll, out)
