"""Near duplicates: all pairs of documents whose word shingles have a Jaccard similarity of a threshold or more.

Grouped prefix join. Shingles have one global order, rare before frequent. Two sets that
are similar enough share a shingle among the first ``n - ceil(t n) + 1`` of each. Documents
of the same size and the same prefix are one group, which enters the index once.

1. Frequent shingles: tasks report what many of their documents share; the most frequent
   of these, at most ``HEAVY``, go last in the order. Any order gives the same result.
2. Index: a row per prefix shingle and group; shingles of one group only are dropped, and
   of shingles with the same list of groups one stays.
3. Group pairs of a list are filtered by size and by bit signature. A list is worked through
   in blocks; a task reports what hangs together, not the pairs.
4. What hangs together through all lists is a cluster. Its members' sets are read again from
   the texts and compared exactly, each pair of distinct sets once, block by block. Again a
   task reports links per member and what hangs together, so rows grow with members, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.arrays import local_roots, mixed, shingle_sets, sorted_runs
from flowquarry.llm.batches import begin, give_back, pieces
from flowquarry.llm.components import connected_components
from flowquarry.session import settle

PERCENT = 75
HEAVY = 1 << 17
HEAVY_IN_TASK = 8  # documents of one batch that share a shingle, for it to be reported
SIGNATURE_BITS = 1024  # at least; a signature has a bit per shingle or more, as a power of two
LIST_BLOCK = 1024  # groups of one list compared at once
MEMBER_BLOCK = 256  # members of one cluster compared at once
BLOCK_BYTES = 32 << 20


def least_overlap(a, b, percent: int = PERCENT):
    """Shingles that sets of sizes a and b must share: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class ShingleOrder:
    """Rare shingles by their code, then the frequent ones by how frequent they are."""

    def __init__(self, heavy: list[int]):
        codes = np.array(heavy, dtype=np.int64).view(np.uint64)  # most frequent last
        self.place = np.argsort(codes, kind="stable")
        self.codes = codes[self.place]

    def prefix(self, codes: np.ndarray, percent: int) -> np.ndarray:
        wanted = prefix_length(len(codes), percent)
        if not len(self.codes) or not wanted:
            return codes[:wanted]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        is_heavy = self.codes[at] == codes
        rare = codes[~is_heavy]
        if len(rare) >= wanted:
            return rare[:wanted]
        last = codes[is_heavy][np.argsort(self.place[at[is_heavy]], kind="stable")]
        return np.concatenate([rare, last])[:wanted]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch["_text"].cast(pa.binary()).to_pylist()


def _report_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("shingles")
    for batch in batches:
        sets = [s for piece in pieces(batch) for s in shingle_sets(_texts(piece))]
        codes = np.concatenate(sets or [np.zeros(0, np.uint64)])
        del sets
        codes.sort()
        cuts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])
        often = np.flatnonzero(np.diff(cuts) >= HEAVY_IN_TASK)
        yield pa.RecordBatch.from_pydict({"code": codes[cuts[often]].view(np.int64), "n": np.diff(cuts)[often].astype(np.int64)})
        del codes, cuts
    give_back()


def frequent_shingles(texts: DataFrame) -> list[int]:
    """At most ``HEAVY`` shingle codes, the most frequent last."""
    seen = texts.mapInArrow(_report_heavy, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "code").limit(HEAVY).select("code").toPandas()["code"]
    return top[::-1].tolist()


def _digest(codes: np.ndarray) -> tuple[int, int]:
    """Two sums over the set, 128 bits together, that tell sets apart."""
    return tuple(np.array([codes.sum(dtype=np.uint64), mixed(codes).sum(dtype=np.uint64)]).view(np.int64).tolist())


def signature(codes: np.ndarray) -> np.ndarray:
    """Parity of the set's codes per bit; sets that differ in k codes differ in k bits at most."""
    bits = max(SIGNATURE_BITS, 1 << (max(len(codes), 1) - 1).bit_length())
    odd = np.bincount((codes & np.uint64(bits - 1)).astype(np.intp), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(signatures: np.ndarray, words: int) -> np.ndarray:
    """Signatures (last axis) as they would be with fewer bits."""
    while signatures.shape[-1] > words:
        half = signatures.shape[-1] // 2
        signatures = signatures[..., :half] ^ signatures[..., half:]
    return signatures


MEMBER_SCHEMA = "_key long, _text_hash long, n long, d1 long, d2 long, gid long, sig binary"


def _read_members(order_of, percent: int, postings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles")
        order = order_of.value
        for batch in (piece for whole in batches for piece in pieces(whole)):
            rows, seen, codes_out, gid_out = [], set(), [], []
            for codes in shingle_sets(_texts(batch)):
                prefix = order.prefix(codes, percent)
                d1, d2 = _digest(codes) if len(codes) else (0, 0)
                gid = int(mixed(np.array([len(codes)], np.uint64) + mixed(prefix).sum(dtype=np.uint64)).view(np.int64)[0])
                if postings:
                    if gid not in seen:
                        seen.add(gid)
                        codes_out.append(prefix)
                        gid_out.append(np.full(len(prefix), gid))
                else:
                    rows.append((len(codes), d1, d2, gid, signature(codes).tobytes()))
            if postings:
                cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
                yield pa.RecordBatch.from_pydict({
                    "code": cat(codes_out, np.uint64).view(np.int64), "gid": cat(gid_out, np.int64).astype(np.int64)})
            else:
                n, d1, d2, gid, sig = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_pydict({
                    "_key": batch["_key"], "_text_hash": batch["_text_hash"], "n": pa.array(n, pa.int64()), "d1": pa.array(d1, pa.int64()),
                    "d2": pa.array(d2, pa.int64()), "gid": pa.array(gid, pa.int64()), "sig": pa.array(sig, pa.binary())})

    return run


LIST_SCHEMA = "list long, whole boolean, gids array<long>"


def _shared_lists(list_block: int):
    """The groups that have a shingle, for each shingle of two groups or more; longer lists in pieces of ``list_block``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("lists")
        held = gids = np.zeros(0, dtype=np.int64)
        begun = False  # whether pieces of the held list have gone out

        def made(lists: list[tuple[int, bool, np.ndarray]]) -> pa.RecordBatch:
            code, whole, members = zip(*lists) if lists else ((), (), ())
            sizes = np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int32)
            values = pa.array(np.concatenate(members) if members else np.zeros(0, np.int64), pa.int64())
            return pa.RecordBatch.from_pydict({
                "list": pa.array(code, pa.int64()), "whole": pa.array(whole, pa.bool_()),
                "gids": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)})

        def finish(code: int, members: np.ndarray, last: bool) -> list[tuple[int, bool, np.ndarray]]:
            if not begun and last and len(members) <= list_block:
                return [(code, True, members)] if len(members) > 1 else []
            return [(code, False, members[i:i + list_block]) for i in range(0, len(members), list_block)]

        for batch in batches:
            code, gid = (np.concatenate([old, batch[c].to_numpy()]) for old, c in ((held, "code"), (gids, "gid")))
            if not len(code):
                continue
            own = np.concatenate([[True], (code[1:] != code[:-1]) | (gid[1:] != gid[:-1])])
            code, gid = code[own], gid[own]
            cuts = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])
            several = np.flatnonzero(np.diff(cuts) > 1) if not begun else np.arange(len(cuts) - 1)
            out = []
            for i in several.tolist():
                out += finish(int(code[cuts[i]]), gid[cuts[i]:cuts[i + 1]], True)
                begun = False
            if len(cuts) > 1:
                begun = False
            held, gids = code[cuts[-1]:], gid[cuts[-1]:]
            if len(held) > list_block:  # all but the last, which the next row may repeat
                begun = True
                out += finish(int(held[0]), gids[:-1], False)
                held, gids = held[-1:], gids[-1:]
            yield made(out)
        if len(held):
            yield made(finish(int(held[0]), gids, True))

    return run


def blocked(rows: DataFrame, sizes: DataFrame, on: str, member: Column) -> DataFrame:
    """Rows copied to the pairs of blocks (first <= second) of their group; ``sizes`` has ``blocks`` of those groups that need several."""
    dealt = rows.join(sizes, on, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(member, F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")}).drop("other", "blocks")


def near_pairs(sizes: np.ndarray, signatures: list[np.ndarray], single: np.ndarray, left: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < left, j > i) that sizes and signatures do not rule out.

    A signature speaks for a group of one set only. Sets of sizes a and b that are similar enough differ in
    a + b - 2 * (least overlap) codes at most.
    """
    words = np.array([len(s) for s in signatures])
    blocks = {w: (at, np.stack([signatures[i] for i in at])) for w in np.unique(words).tolist() for at in [np.flatnonzero(words == w)]}
    narrow: dict[tuple[int, int], np.ndarray] = {}
    lefts, rights = [], []
    for i in range(left):
        for w, (at, block) in blocks.items():
            chosen = (at > i) & (np.minimum(sizes[i], sizes[at]) * 100 >= percent * np.maximum(sizes[i], sizes[at]))
            if not chosen.any():
                continue
            fewest = min(w, int(words[i]))
            if (w, fewest) not in narrow:
                narrow[w, fewest] = folded(block, fewest)
            j = at[chosen]
            apart = np.bitwise_count(narrow[w, fewest][chosen] ^ folded(signatures[i], fewest)).sum(axis=1)
            ok = (apart <= sizes[i] + sizes[j] - 2 * least_overlap(sizes[i], sizes[j], percent)) | ~(single[i] & single[j])
            lefts.append(np.full(int(ok.sum()), i))
            rights.append(j[ok])
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return join(lefts), join(rights)


def _list_edges(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("list pairs")
        for table, at in sorted_runs(batches, ("list", "first", "second")):
            gid, n, own, first, second = (table[c].to_numpy() for c in ("gid", "n", "own", "first", "second"))
            single = table["single"].to_numpy(zero_copy_only=False)
            signatures = [np.frombuffer(b, dtype=np.uint64) for b in table["sig"].to_pylist()]
            a_out, b_out = [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                across = first[s] != second[s]
                order = s + (np.argsort(own[s:e], kind="stable") if across else np.arange(e - s))
                left = int((own[s:e] == first[s]).sum()) if across else e - s
                i, j = near_pairs(n[order], [signatures[k] for k in order.tolist()], single[order], left, percent)
                if across:
                    i, j = i[j >= left], j[j >= left]
                if len(i):
                    root = local_roots(e - s, i, j)
                    to = np.flatnonzero(root != np.arange(e - s))
                    a_out.append(gid[order[to]])
                    b_out.append(gid[order[root[to]]])
            cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"a": cat(a_out), "b": cat(b_out)})

    return run


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Intersection sizes of the first ``left`` sets with all sets."""
    n = len(sets)
    if n <= 4:
        out = np.zeros((left, n), dtype=np.int64)
        for i in range(left):
            for j in range(n):
                out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if j != i else len(sets[i])
        return out
    codes, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((left, n), dtype=np.float32)
    for start in range(0, len(codes), 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        has = np.zeros((n, min(4096, len(codes) - start)), dtype=np.float32)
        has[row[lo:hi], column[lo:hi] - start] = 1
        out += has[:left] @ has.T
    return np.rint(out).astype(np.int64)


def _cluster_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("cluster links")
        for table, at in sorted_runs(batches, ("cluster", "first", "second")):
            member, copies, own, first, second = (table[c].to_numpy() for c in ("member", "copies", "own", "first", "second"))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                # rows of one document repeated would come twice
                ids, at_first = np.unique(member[s:e], return_index=True)
                at_first = at_first[np.argsort(own[s + at_first], kind="stable")]
                where = s + at_first
                sets = shingle_sets(table["_text"].take(pa.array(where)).cast(pa.binary()).to_pylist())
                across = first[s] != second[s]
                left = int((own[where] == first[s]).sum())
                common = overlaps(sets, left)
                n = np.array([len(x) for x in sets])
                linked = 100 * common >= percent * (n[:left, None] + n[None, :] - common)
                if across:
                    linked[:, :left] = False
                else:
                    linked &= ~np.eye(len(n), dtype=bool)
                i, j = np.nonzero(linked)
                weight = copies[where]
                links = np.bincount(i, weight[j], minlength=len(n)) + (np.bincount(j, weight[i], minlength=len(n)) if across else 0)
                root = local_roots(len(n), i, j)
                yield pa.RecordBatch.from_pydict({
                    "member": member[where], "root": member[where][root], "links": links.astype(np.int64)})

    return run


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, n_links, class_id) for every row of ``docs``.

    Words are runs without ASCII white space, A-Z as a-z; a set is that of all runs of five words, of a shorter text
    the whole sequence. Texts link when 100 * |intersection| >= percent * |union|. n_links counts the other rows a
    row links with, equal sets included; component_id is the smallest key that links lead to; class_id tells equal
    sets. NULL and blank texts have no shingles and no links, and their own key as component. NULL keys and repeated
    rows are rows like others; other columns are not read; an empty table gives no rows. ``key`` is an integer column.
    """
    return verdicts_by_text(docs, text, key, percent).drop("_text_hash").withColumnRenamed("_key", key)


def verdicts_by_text(docs: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """As ``near_duplicates``, with the key as ``_key`` and a hash of the text, which tell rows apart."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), F.xxhash64(whole).alias("_text_hash"), whole.alias("_text"))
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(ShingleOrder(frequent_shingles(texts.select("_text"))))  # HEAVY codes at most
    members = settle(texts.mapInArrow(_read_members(order, percent, False), MEMBER_SCHEMA), "members")
    full = members.filter("n > 0")
    classes = settle(
        full.groupBy("n", "d1", "d2").agg(
            F.min("gid").alias("gid"), F.min("sig").alias("sig"), F.count("*").alias("copies"), F.min("_key").alias("least_key"),
            F.min(F.struct("_key", "_text_hash")).alias("reader"))
        .withColumn("member", F.monotonically_increasing_id()), "classes")
    groups = settle(classes.groupBy("gid").agg(
        F.min("n").alias("n"), F.min("sig").alias("sig"), (F.count("*") == 1).alias("single")), "groups")

    index = texts.select("_text").mapInArrow(_read_members(order, percent, True), "code long, gid long")
    lists = settle(
        index.repartition("code").sortWithinPartitions("code", "gid").mapInArrow(_shared_lists(LIST_BLOCK), LIST_SCHEMA), "lists")
    # copies share many shingles, which then have the same list; one of these is enough
    short = lists.filter("whole").groupBy("gids").agg(F.min("list").alias("list")).select("list", F.explode("gids").alias("gid"))
    pieces = lists.filter("NOT whole")
    sizes = pieces.groupBy("list").agg(F.ceil(F.sum(F.size("gids")) / LIST_BLOCK).alias("blocks"))
    entries = short.union(pieces.select("list", F.explode("gids").alias("gid")))
    dealt = blocked(entries.join(groups, "gid"), sizes, "list", F.xxhash64("gid"))
    edges = (
        dealt.repartition("list", "first", "second").sortWithinPartitions("list", "first", "second")
        .mapInArrow(_list_edges(percent), "a long, b long"))
    near = connected_components(edges)

    clusters = classes.join(near, classes.gid == near.node, "left").select(
        F.coalesce("component", "gid").alias("cluster"), "member", "copies", "n", "reader")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"), F.sum(F.col("n") * 8).alias("bytes")).filter("members > 1")
    several = settle(clusters.join(sizes.select("cluster"), "cluster"), "clusters")
    blocks = settle(sizes.select("cluster", F.greatest(
        F.ceil(F.col("members") / MEMBER_BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("blocks")).filter("blocks > 1"), "cluster-blocks")
    readers = several.select("cluster", "member", "copies", F.col("reader._key").alias("_reader"), F.col("reader._text_hash").alias("_hash"))
    same = texts["_key"].eqNullSafe(readers["_reader"]) & (texts["_text_hash"] == readers["_hash"])
    # members grow with the table, so the texts are joined by a shuffle at every size
    members_read = texts.join(readers.hint("merge"), same).select("cluster", "member", "copies", "_text")
    compared = settle(
        blocked(members_read, blocks, "cluster", F.xxhash64("member"))
        .repartition("cluster", "first", "second").sortWithinPartitions("cluster", "first", "second", "member")
        .mapInArrow(_cluster_links(percent), "member long, root long, links long"), "links")
    linked = compared.groupBy("member").agg(F.sum("links").alias("links"))
    joined = connected_components(compared.select(F.col("member").alias("a"), F.col("root").alias("b")))
    placed = classes.join(joined, classes.member == joined.node, "left").join(linked, "member", "left").select(
        "n", "d1", "d2", "member", "copies", "least_key",
        F.coalesce("component", "member").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    least = placed.groupBy("component").agg(F.min("least_key").alias("component_id"))
    verdicts = settle(placed.join(least, "component").select(
        "n", "d1", "d2", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("member").alias("class_id")), "verdicts")
    empty = members.filter("n = 0").select(
        "_key", "_text_hash", F.col("n").alias("n_shingles"), F.col("_key").alias("component_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("long").alias("class_id"))
    return full.join(verdicts, ["n", "d1", "d2"]).select(
        "_key", "_text_hash", F.col("n").alias("n_shingles"), "component_id", "n_links", "class_id").union(empty)


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key, of rows that repeat it one.

    Rows without shingles stay all. NULL keys come after others; a component of NULL keys only keeps each of its texts.
    """
    found = verdicts_by_text(docs, text, key, percent)
    kept = found.filter(F.col("_key").eqNullSafe(F.col("component_id"))).select(
        F.col("_key").alias("_kept"), F.col("_text_hash").alias("_hash"), (F.col("n_shingles") == 0).alias("_blank")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*names).alias("_row"), F.col(f"`{key}`").cast("long").alias("_key"), F.xxhash64(whole).alias("_text_hash"))
    same = rows["_key"].eqNullSafe(kept["_kept"]) & (rows["_text_hash"] == kept["_hash"])
    rows = rows.join(kept, same).withColumn("_repeat", F.when(F.col("_blank"), F.monotonically_increasing_id()))
    return rows.groupBy("_key", "_text_hash", "_repeat").agg(F.first("_row").alias("_row")).select("_row.*")
