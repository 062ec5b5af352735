"""Passages that repeat across documents, found by suffix sorting in two stages.

Matches are strings of ``LENGTH`` bytes. To bring equal strings together without shuffling
all suffixes, each string is assigned to its anchor, the place in it whose ``GRAM`` bytes have the
smallest hash; equal strings have equal anchors, and the strings of one anchor start side by side.

1. Documents are dealt into batches of bounded size by a hash of the text, salted if some text has too many copies
   for one batch, once; all steps read that exchange.
2. A batch reports the hashes of its anchors; only those that two documents share go on.
3. A batch sends, for each shared anchor, the stretch of text its strings lie in, equal stretches once.
4. Stretches of one anchor meet. Of different ones a suffix array is built in two stages: suffixes that are
   smaller than their successors are sorted directly, all others are induced from these by a scan over the
   buckets of first bytes. Neighbours with a common prefix of ``LENGTH`` bytes are equal strings; the
   smallest document of each goes back to the batches.
5. A batch removes the bytes of strings that also start in a document with a smaller key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.arrays import BYTE_BASE, BYTE_CODES, mixed, sorted_runs

LENGTH = 50
GRAM = 16
SPREAD = LENGTH - GRAM + 1  # places of the gram in a string
BATCH_BYTES = 4 << 20
PLACE_BITS = 20
UNIT_BYTES = 1 << 18  # bytes worked on at once; a longer text is cut with an overlap
PACKED = 5  # bytes of a hash that are sent, besides the bucket it is sent to; a chance hit costs work, not rightness
BUCKET_BYTES = 8 << 20
MAX_BUCKET_BITS = 16
NO_KEY = np.iinfo(np.int64).max  # a NULL key is later than all others


# ---- anchors -------------------------------------------------------------------------------------------------

def _units(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about ``UNIT_BYTES``: indexes, offsets and bytes; texts too short for a match are left out."""
    index, base, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - LENGTH + 1, 0), UNIT_BYTES):
            part = text[start:start + UNIT_BYTES + LENGTH - 1]
            index.append(i)
            base.append(start)
            parts.append(part)
            size += len(part)
            if size >= UNIT_BYTES:
                yield index, base, parts
                index, base, parts, size = [], [], [], 0
    if parts:
        yield index, base, parts


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, strings, anchor hash): runs of neighbouring strings of ``LENGTH`` bytes with one anchor."""
    for index, base, parts in _units(texts):
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        sizes = np.array([len(p) for p in parts])
        begins = np.cumsum(sizes) - sizes
        gram, width, power = BYTE_CODES[data], 1, int(BYTE_BASE)
        while width < GRAM:  # hashes of twice the width from two neighbours
            gram = gram[:-width] + gram[width:] * np.uint64(power)
            power, width = power * power % (1 << 64), width * 2
        gram = mixed(gram)
        places = np.arange(len(gram), dtype=np.uint64)
        least = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
        width = 1
        while width * 2 <= SPREAD:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if SPREAD > width:
            least = np.minimum(least[:-(SPREAD - width)], least[SPREAD - width:])
        place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(edge, begins + sizes - LENGTH + 1, 1)
        np.add.at(edge, begins + sizes, -1)
        valid = np.cumsum(edge[:-1])[:len(place)] == 0
        goes_on = np.zeros(len(place), dtype=bool)
        goes_on[1:] = valid[1:] & valid[:-1] & (place[1:] == place[:-1])
        breaks = np.flatnonzero(~goes_on)
        starts = breaks[valid[breaks]]
        # an anchor's hash is the least of many, so it is mixed once more before it is used to deal anchors out
        ends = np.concatenate([breaks, [len(place)]])[np.searchsorted(breaks, starts) + 1]
        part = np.searchsorted(begins, starts, side="right") - 1
        yield np.asarray(index)[part], starts - begins[part] + np.asarray(base)[part], ends - starts, mixed(gram[place[starts]])


def _docs(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    keys = table["doc"].fill_null(NO_KEY).to_numpy().astype(np.int64)
    return keys, [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]


def _report_anchors(bits: int):
    def run(table: pa.Table) -> pa.Table:
        keys, texts = _docs(table)
        found = [(h, keys[i]) for i, _, _, h in stretches(texts)]
        hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        owners = np.concatenate([k for _, k in found]) if found else np.zeros(0, np.int64)
        hashes = hashes >> np.uint64(64 - bits - 8 * PACKED)
        order = np.lexsort((owners, hashes))
        hashes, owners = hashes[order], owners[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1])]) if len(hashes) else np.zeros(0, bool)
        other = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owners[1:] != owners[:-1])]) if len(hashes) else new
        # an anchor that two documents of the batch have is reported twice
        own = np.sort(np.concatenate([hashes[new], np.unique(hashes[other])]))
        bucket = (own >> np.uint64(8 * PACKED)).astype(np.int64)
        packed = own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(own) else np.zeros(0, np.int64)
        ends = np.concatenate([at[1:], [len(own)]])
        return pa.table({
            "bucket": pa.array(bucket[at], pa.int64()), "batch": pa.array(np.full(len(at), table["batch"][0].as_py() if len(table) else 0), pa.int64()),
            "codes": pa.array([packed[s:e].tobytes() for s, e in zip(at, ends)], pa.binary())})

    return run


def _unpacked(raw: bytes) -> np.ndarray:
    codes = np.zeros((len(raw) // PACKED, 8), dtype=np.uint8)
    codes[:, :PACKED] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, PACKED)
    return codes.view("<u8").ravel()


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of each batch's anchors in a bucket those that were reported twice or more."""
    raws = table["codes"].to_pylist()
    codes = _unpacked(b"".join(raws))
    _, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    shared = counts[back] > 1
    ends = np.cumsum([len(r) // PACKED for r in raws])
    out = []
    for raw, end in zip(raws, ends.tolist()):
        own = shared[end - len(raw) // PACKED:end]
        out.append(np.frombuffer(raw, dtype=np.uint8).reshape(-1, PACKED)[own].tobytes())
    some = [i for i, o in enumerate(out) if o]
    return pa.table({"batch": table["batch"].take(pa.array(some, pa.int64())), "bucket": table["bucket"].take(pa.array(some, pa.int64())),
                     "codes": pa.array([out[i] for i in some], pa.binary())})


# ---- stretches and their suffix array --------------------------------------------------------------------------

def _send_stretches(bits: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        found: dict[bytes, list] = {}
        if len(docs) and len(shared):
            keys, texts = _docs(docs)
            wanted = np.unique(np.concatenate([
                _unpacked(c) | np.uint64(b << 8 * PACKED) for b, c in zip(shared["bucket"].to_pylist(), shared["codes"].to_pylist())]))
            for text, start, strings, hashes in stretches(texts):
                code = hashes >> np.uint64(64 - bits - 8 * PACKED)
                at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                hit = wanted[at] == code
                for i, s, n, h, k in zip(text[hit].tolist(), start[hit].tolist(), strings[hit].tolist(), hashes[hit].view(np.int64).tolist(), keys[text[hit]].tolist()):
                    piece = texts[i][s:s + n + LENGTH - 1]
                    known = found.get(piece)
                    if known is None:
                        found[piece] = [h, k, k]
                    elif k < known[1]:
                        known[1] = k
                    elif k > known[2]:
                        known[2] = k
        h, low, high = (pa.array([v[i] for v in found.values()], pa.int64()) for i in range(3))
        return pa.table({"anchor": h, "batch": pa.array([docs["batch"][0].as_py()] * len(found) if found else [], pa.int64()),
                         "low": low, "high": high, "piece": pa.array(list(found), pa.binary())})

    return run


def _eight_bytes(data: np.ndarray) -> np.ndarray:
    """The next eight bytes of each position as one number, zeros after the end."""
    word, width = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64), 1
    while width < 8:
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
        width *= 2
    return word[:len(data)]


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a byte later; the last one is larger than nothing."""
    n = len(data)
    sign = np.full(n, -1, dtype=np.int8)
    sign[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1].astype(np.int16))
    decided = np.where(sign != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # equal bytes: as the next change says
    return sign[decided] > 0


def _sorted_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of their first ``depth`` bytes, eight bytes at a time among those still equal."""
    n = len(words)
    order = at[np.argsort(words[at], kind="stable")]
    first = words[order]
    group = np.cumsum(np.concatenate([[0], first[1:] != first[:-1]])) if len(order) else np.zeros(0, np.int64)
    for offset in range(8, depth, 8):
        sizes = np.bincount(group)
        open_ = np.flatnonzero(sizes[group] > 1)
        if not len(open_):
            break
        part, own = order[open_], group[open_]
        word = np.where(part + offset < n, words[np.minimum(part + offset, n - 1)], 0)
        inner = np.lexsort((word, own))
        order[open_] = part[inner]
        word, own = word[inner], own[inner]
        new = np.zeros(len(order), dtype=np.int64)
        new[open_[1:]] = (word[1:] != word[:-1]) & (own[1:] == own[:-1])
        group = group + np.cumsum(new)
    return order


def suffix_order(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All positions in the order of the suffixes that start there, exact for the first ``depth`` bytes at least.

    Suffixes smaller than their successors are sorted directly; the others follow by one pass over the buckets of
    equal first bytes: a suffix that is larger than its successor lies in a later bucket, in the order of the
    successors, or in the same one behind it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    small = smaller_than_next(data)
    direct = _sorted_directly(_eight_bytes(data), np.flatnonzero(small), depth)
    ends = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[n - 1]].append(np.array([n - 1]))  # its successor, nothing, is smaller than all
    out = []
    for byte in range(256):
        bucket = []
        new = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(new):  # a run of one byte goes on inside the bucket
            bucket.append(new)
            before = new[new > 0] - 1
            new = before[data[before] == byte]
        bucket.append(direct[ends[byte]:ends[byte + 1]])
        own = np.concatenate(bucket)
        out.append(own)
        before = own[own > 0] - 1
        before = before[data[before] > byte]
        order = np.argsort(data[before], kind="stable")
        before = before[order]
        firsts, cuts = np.unique(data[before], return_index=True)
        for later, part in zip(firsts.tolist(), np.split(before, cuts[1:])):
            waiting[later].append(part)
    return np.concatenate(out)


def adjacent_prefixes(data: np.ndarray, order: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """Common prefix of each position in ``order`` with the one before it, up to ``cap`` bytes; 0 for the first."""
    words, n = _eight_bytes(data), len(data)
    a, b = order[:-1], order[1:]
    length = np.zeros(len(a), dtype=np.int64)
    going = np.arange(len(a))
    for offset in range(0, cap, 8):
        x, y = a[going] + offset, b[going] + offset
        inside = (x < n) & (y < n)
        differ = np.where(inside, words[np.minimum(x, n - 1)] ^ words[np.minimum(y, n - 1)], np.uint64(1) << np.uint64(63))
        equal = np.zeros(len(going), dtype=np.int64)
        for k in range(1, 9):
            equal += (differ >> np.uint64(64 - 8 * k)) == 0
        equal = np.minimum(equal, n - np.maximum(x, y))
        length[going] += np.maximum(equal, 0)
        going = going[equal == 8]
        if not len(going):
            break
    return np.concatenate([[0], np.minimum(length, cap)])


def least_documents(pieces: list[bytes], low: np.ndarray) -> list[np.ndarray]:
    """For each string of each piece the smallest ``low`` of the pieces that hold it."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    strings = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(pieces)), sizes)
    order = suffix_order(data)
    order = order[order - begins[owner[order]] < strings[owner[order]]]
    group = np.cumsum(adjacent_prefixes(data, order) < LENGTH) - 1
    least = np.full(group[-1] + 1, NO_KEY, dtype=np.int64)
    np.minimum.at(least, group, low[owner[order]])
    by_place = np.empty(len(data), dtype=np.int64)
    by_place[order] = least[group]
    return [by_place[b:b + n] for b, n in zip(begins.tolist(), strings.tolist())]


def _coded(values: np.ndarray) -> bytes:
    """Run lengths (one byte each, a piece has at most ``SPREAD`` strings) and values."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    lengths = np.diff(np.concatenate([at, [len(values)]])).astype(np.uint8)
    return lengths.tobytes() + values[at].astype("<i8").tobytes()


def _decoded(raw: bytes) -> np.ndarray:
    n = len(raw) // 9
    return np.repeat(np.frombuffer(raw, dtype="<i8", offset=n), np.frombuffer(raw, dtype=np.uint8, count=n))


def _compare_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, at in sorted_runs(batches, ("anchor",)):
        anchor, batch, low, high = (table[c].to_numpy() for c in ("anchor", "batch", "low", "high"))
        pieces = table["piece"].to_pylist()
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(p, len(known)) for p in pieces])
        least = np.full(len(known), NO_KEY, dtype=np.int64)
        np.minimum.at(least, number, low)
        distinct = list(known)
        run = np.repeat(np.arange(len(at) - 1), np.diff(at))
        run_of = np.empty(len(known), dtype=np.int64)
        run_of[number] = run
        varied = np.flatnonzero(np.bincount(run_of)[run_of] > 1)
        mins = dict(zip(varied.tolist(), least_documents([distinct[i] for i in varied], least[varied]))) if len(varied) else {}
        rows, codes, digests = [], [], []
        for r in np.flatnonzero([k in mins for k in number.tolist()] | (least[number] < high)).tolist():
            k = int(number[r])
            values = mins.get(k)
            if values is None:
                codes.append(bytes([len(pieces[r]) - LENGTH + 1]) + int(least[k]).to_bytes(8, "little", signed=True))
            elif (values < high[r]).any():
                codes.append(_coded(values))
            else:
                continue
            rows.append(r)
            digests.append(xxhash.xxh3_64_intdigest(pieces[r]) - (1 << 63))
        yield pa.RecordBatch.from_pydict({
            "batch": batch[rows], "anchor": anchor[rows], "digest": pa.array(digests, pa.int64()), "least": pa.array(codes, pa.binary())})


# ---- removal -----------------------------------------------------------------------------------------------------

RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def _remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
    keys, texts = _docs(docs)
    strings_of: dict[int, list[np.ndarray]] = {}
    if len(answers):
        known = dict(zip(zip(answers["anchor"].to_pylist(), answers["digest"].to_pylist()), answers["least"].to_pylist()))
        anchors = np.unique(answers["anchor"].to_numpy())
        for text, start, strings, hashes in stretches(texts):
            code = hashes.view(np.int64)
            hit = anchors[np.minimum(np.searchsorted(anchors, code), len(anchors) - 1)] == code
            for i, s, n, h in zip(text[hit].tolist(), start[hit].tolist(), strings[hit].tolist(), code[hit].tolist()):
                raw = known.get((h, xxhash.xxh3_64_intdigest(texts[i][s:s + n + LENGTH - 1]) - (1 << 63)))
                if raw is not None:
                    gone = np.flatnonzero(_decoded(raw) < keys[i])
                    if len(gone):
                        strings_of.setdefault(i, []).append(s + gone)
    out = []
    for i, text in enumerate(texts):
        starts = ends = np.zeros(0, np.int64)
        kept = text
        if i in strings_of:
            at = np.unique(np.concatenate(strings_of[i]))
            new = np.concatenate([[True], at[1:] > at[:-1] + LENGTH])
            starts = at[new]
            ends = np.concatenate([at[:-1][new[1:]], [at[-1]]]) + LENGTH
            left = [0, *ends.tolist()]
            kept = b"".join(text[a:b] for a, b in zip(left, [*starts.tolist(), len(text)]))
        out.append((len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), starts, ends))
    n, removed, spans, digest, starts, ends = zip(*out) if out else ((),) * 6
    return pa.table({
        "doc": docs["doc"], "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
        "kept_sha256": pa.array(digest, pa.string()), "starts": pa.array(list(starts), pa.list_(pa.int64())), "ends": pa.array(list(ends), pa.list_(pa.int64()))})


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) for every row of ``docs``.

    Each byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller key is removed;
    strings are those of the input, so overlapping and chained repeats all count. starts and ends are the maximal
    removed runs as byte offsets. A NULL text is empty; a NULL key is later than all others; rows with the same key
    remove nothing from each other. Other columns are not read. An empty table gives no rows.
    """
    table = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = F.sum(F.octet_length("text").cast("long"))
    by_text = table.groupBy(F.xxhash64("text").alias("hash")).agg(size.alias("bytes"))
    found = by_text.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
    total = found.total or 0
    # copies of a text share a batch, which sends their stretches once, unless they are too many for one
    salts = max(1, -(-(found.most or 0) // batch_bytes))
    batches = max(1, -(-total // batch_bytes))
    # an anchor is expected every (SPREAD + 1) / 2 bytes
    bits = min(MAX_BUCKET_BITS, max(1, (int(total * 2 / (SPREAD + 1) * PACKED / BUCKET_BYTES)).bit_length()))
    salt = F.pmod(F.xxhash64("doc"), F.lit(salts))
    dealt = table.withColumn("batch", F.pmod(F.xxhash64(salt, "text"), F.lit(batches)))
    reported = dealt.groupBy("batch").applyInArrow(_report_anchors(bits), "bucket long, batch long, codes binary")
    shared = reported.groupBy("bucket").applyInArrow(_shared_anchors, "batch long, bucket long, codes binary")
    sent = dealt.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(
        _send_stretches(bits), "anchor long, batch long, low long, high long, piece binary")
    answers = sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _compare_stretches, "batch long, anchor long, digest long, least binary")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_remove, RESULT).withColumnRenamed("doc", key)
