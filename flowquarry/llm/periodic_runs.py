"""Stretches of a text that repeat with a period: maximal runs, found by branching squares on an enhanced suffix array.

The words of many texts, each text closed by a word of its own, are sorted as suffixes. An interval of the suffix
array whose suffixes share exactly ``depth`` words holds a branching square of period ``depth`` for each pair of
suffixes i and i + depth in two different children of the interval. Of each interval all children but the largest are
looked through, which is n log n suffixes in all; the inverse array says whether i + depth, or i - depth, lies in the
interval, so no tree is built. Every run ends in one branching square of its period; rotating that square to the left
as far as the words agree gives the run's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6
LEAST_PERIODS = 4
BATCH_WORDS = 1 << 17  # words whose suffixes are sorted at once; a longer text is sorted alone
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffixes in order, place of each suffix, classes): ``classes[k]`` numbers the stretches of 2^k words by their text.

    ``words`` are numbers from 0; the last one must be found nowhere else. Only suffixes that still tie are sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    by_place = words[order]
    head = np.concatenate([[True], by_place[1:] != by_place[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    classes, width = [rank.copy()], 1
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order, rank, classes
        held = order[slots]
        # a tie means that both suffixes go on for ``width`` words, as closing words differ
        second = rank[held + width]
        again = np.argsort(rank[held] * (n + 1) + second, kind="stable")
        order[slots] = held[again]
        first, second = rank[order[slots]], second[again]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head[slots] = new
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        classes.append(rank.copy())
        width *= 2


def common_prefixes(order: np.ndarray, classes: list[np.ndarray]) -> np.ndarray:
    """Words that the suffix at each place shares with the one before it."""
    n = len(order)
    shared = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(classes[0][order[1:]] == classes[0][order[:-1]]) + 1
    a, b = order[at - 1].copy(), order[at].copy()
    for k in range(len(classes) - 1, -1, -1):
        equal = classes[k][np.minimum(a, n - 1)] == classes[k][np.minimum(b, n - 1)]
        shared[at[equal]] += 1 << k
        a[equal] += 1 << k
        b[equal] += 1 << k
    return shared


def _nearest_smaller(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``at``, the nearest places left and right of it with a smaller value; both ends must have the least."""
    minima = [values]
    while len(minima[-1]) > 1 and 1 << len(minima) <= len(values):
        last, half = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(last[:-half], last[half:]))
    own, left, right = values[at], at.copy(), at.copy()
    for k in range(len(minima) - 1, -1, -1):
        step, least = 1 << k, minima[k]
        ok = left - step >= 0
        ok[ok] = least[left[ok] - step] >= own[ok]
        left[ok] -= step
        ok = right + step < len(values)
        ok[ok] = least[right[ok] + 1] >= own[ok]
        right[ok] += step
    return left - 1, right + 1


def branching_squares(order: np.ndarray, place: np.ndarray, shared: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that cannot be moved one word to the right, of periods up to ``deepest``."""
    none = np.zeros(0, dtype=np.int64)
    cut = np.flatnonzero((shared > 0) & (shared <= deepest))
    if not len(cut):
        return none, none
    low, high = _nearest_smaller(np.concatenate([shared, [0]]), cut)
    # places cut at the same depth between the same bounds are the inner borders of one interval's children
    by = np.lexsort((cut, low, -high))
    cut, low, high = cut[by], low[by], high[by]
    opens = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    closes = np.concatenate([opens[1:], [True]])
    n_open = np.cumsum(opens) - 1
    # children: from the interval's lower bound or a cut up to the next cut or the upper bound
    begins = np.empty(len(cut) + int(opens.sum()), dtype=np.int64)
    ends, depth, lower, upper = (np.empty_like(begins) for _ in range(4))
    at = np.arange(len(cut)) + n_open
    begins[at + 1], ends[at] = cut, cut
    begins[at[opens]], ends[at[closes] + 1] = low[opens], high[closes]
    for out, values in ((depth, shared[cut]), (lower, low), (upper, high)):
        out[at], out[at[closes] + 1] = values, values[closes]
    sizes = ends - begins
    firsts = at[opens]
    counts = np.diff(np.concatenate([firsts, [len(begins)]]))
    largest = np.repeat(np.maximum.reduceat(sizes, firsts), counts)
    is_largest = sizes == largest
    seen = np.cumsum(is_largest)
    before = np.repeat(seen[firsts] - is_largest[firsts], counts)
    small = ~(is_largest & (seen - before == 1))  # all children but one largest
    begins, ends, depth, lower, upper, sizes = (x[small] for x in (begins, ends, depth, lower, upper, sizes))
    child = np.repeat(np.arange(len(sizes)), sizes)
    slot = np.arange(len(child)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[child]
    starts, periods = [], []
    for sign in (1, -1):
        other = order[slot] + sign * depth[child]
        inside = np.flatnonzero((other >= 0) & (other < len(order)))
        where, c = place[other[inside]], child[inside]
        hit = (where >= lower[c]) & (where < upper[c]) & ((where < begins[c]) | (where >= ends[c]))
        starts.append(np.minimum(order[slot[inside[hit]]], other[inside[hit]]))
        periods.append(depth[c[hit]])
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(words: np.ndarray, longest: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) of all runs of ``words``, by start, then period; texts are of ``longest`` words at most."""
    order, place, classes = suffix_array(words)
    shared = common_prefixes(order, classes)
    start, period = branching_squares(order, place, shared, longest // least_periods)
    if not len(start):
        return np.zeros((0, 3), dtype=np.int64)
    end = start + 2 * period
    # rotate each square to the left while the words agree, in steps of powers of two
    for k in range(len(classes) - 1, -1, -1):
        to = start - (1 << k)
        ok = to >= 0
        ok[ok] = classes[k][to[ok]] == classes[k][to[ok] + period[ok]]
        start = np.where(ok, to, start)
    length = end - start
    long = (length >= least_words) & (length >= least_periods * period)
    # a square of a repeated word gives the same stretch again with a multiple of the period
    runs = np.stack([start[long], length[long], period[long]], axis=1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    own = np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])[:len(runs)]
    runs = runs[own]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list[bytes]], **least: int) -> Iterator[np.ndarray]:
    """``find_runs`` of each text, with starts from its first word; the suffixes of many texts are sorted at once."""
    held: list[list[bytes]] = []

    def flush() -> Iterator[np.ndarray]:
        sizes = np.array([len(t) for t in held])
        flat = pa.array([w for t in held for w in t], pa.binary())
        codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        words = np.empty(int(sizes.sum()) + len(held), dtype=np.int64)
        closing = begins + sizes
        inside = np.ones(len(words), dtype=bool)
        inside[closing] = False
        words[inside] = codes
        words[closing] = codes.max(initial=-1) + 1 + np.arange(len(held))
        runs = find_runs(words, int(sizes.max()), **least)
        owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
        runs[:, 0] -= begins[owner]
        cuts = np.searchsorted(owner, np.arange(len(held) + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield runs[a:b]

    size = 0
    for text in texts:
        if held and size + len(text) > BATCH_WORDS:
            yield from flush()
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield from flush()


def without_repeats(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that are not in a run behind its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id",
                  least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(key, n_words, runs, collapsed_text) for every row of ``docs``.

    Words are runs of characters other than ASCII white space. A run is a longest stretch of words with smallest period
    q in which words q apart are equal, of ``least_words`` words and ``least_periods`` periods or more; ``runs`` has
    its start (from 0), length and period, by start, then period. ``collapsed_text`` has the words that are in no run
    behind its first q words, joined by one space.

    A NULL, empty or blank text has no words and no runs. Rows are read where they are, nothing is shuffled: NULL keys,
    ties and repeated rows are rows like others. Texts are read whole: short ones together, a long one alone in the
    memory of its task. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                texts = [(t or b"").split() for t in part["_text"].cast(pa.binary()).to_pylist()]
                found = list(runs_of(texts, least_words=least_words, least_periods=least_periods))
                flat = np.concatenate(found)
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int64()) for i in range(3)], ["start", "length", "period"])
                kept = [b" ".join(without_repeats(w, r) if len(r) else w) for w, r in zip(texts, found)]
                yield pa.RecordBatch.from_arrays(
                    [part["_key"], pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    ["_key", "n_words", "runs", "collapsed_text"])

    key_type = rows.schema["_key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"_key {key_type}, n_words long, runs {RUNS}, collapsed_text string")
    return found.withColumnRenamed("_key", key)
