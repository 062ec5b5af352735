import random
import zlib

import numpy as np
import pytest

from flowquarry.llm import tokenizing
from flowquarry.llm.token_counts import token_counts
from flowquarry.llm.token_store import dac_access, dac_decode, dac_encode, dac_read, read_token_store, tokens_at, write_token_store
from flowquarry.llm.tokenizing import WordIds, load_tokenizer
from tests.llm.data import awkward_texts, frame

PIECES = ["a", "Bc", "é", "Σ", "σ", "İ", ".", ",", "!", "'s", " ", "\n", "\t", "\xa0", "́", "12", "<|endoftext|>",
          "<|startoftext|>", "<|", "ß", "漢", "%", "\x1c", "क़", "don't", "THE", "\U0001f600"]


def _odd_texts(n):
    pick = random.Random(11)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 14))) for _ in range(n)]


def test_word_ids_are_the_librarys(monkeypatch):
    library, texts = load_tokenizer("word_bpe_49k.json"), _odd_texts(3000)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for entries in (1_000_000, 5):  # with room in the cache, and without
        monkeypatch.setattr(tokenizing, "CACHE_ENTRIES", entries)
        words = WordIds("word_bpe_49k.json")
        found = [np.frombuffer(b, "<u4").tolist() for k in range(0, len(texts), 500)
                 for b in words.texts([t.encode() for t in texts[k:k + 500]])]
        assert found == expected


def test_special_tokens_keep_their_case():
    library = load_tokenizer("word_bpe_49k.json")
    specials = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|StartOfText|>"]
    texts = [form.format(s) for s in specials for form in ("{0}", "{0} The END, of it.", "A{0}b. THE", "é {0}", "Été {0}The, {0}.")]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] != expected[5] == expected[10]
    found = WordIds("word_bpe_49k.json").texts([t.encode() for t in texts])
    assert [np.frombuffer(b, "<u4").tolist() for b in found] == expected


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_round_trip_and_random_access(n):
    pick = np.random.default_rng(n)
    ids = (pick.integers(0, 1 << 32, n, dtype=np.uint64) >> pick.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    coded = dac_encode(ids)
    assert (dac_decode(*coded) == ids).all()
    at = pick.permutation(n)
    assert (dac_access(*coded, at) == ids[at]).all()


def test_an_access_reads_one_block_of_bits_a_level():
    pick = np.random.default_rng(5)
    ids = pick.integers(0, 1 << 20, 20_000).astype(np.uint32)
    levels, marks, ranks = dac_encode(ids)
    for at in (0, 511, 512, 7_777, 19_999):
        others = []
        place = at
        for bits, rank in zip(marks, ranks):  # all other blocks are turned over, and all other directory entries spoilt
            block = place // 512
            spoilt = np.frombuffer(bits, np.uint8) ^ 0xFF
            spoilt[block * 64:block * 64 + 64] ^= 0xFF
            entries = np.full(len(rank) // 4, 0xFFFFFFFF, "<u4")
            own = np.frombuffer(rank, "<u4")
            entries[block] = own[block]
            others.append((spoilt.tobytes(), entries.tobytes()))
            set_before = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[:place].sum()
            if not np.frombuffer(bits, np.uint8)[place >> 3] >> (place & 7) & 1:
                break
            place = int(set_before)
        assert dac_access(levels, [m for m, _ in others], [r for _, r in others], np.array([at]))[0] == ids[at]
    assert (dac_read(levels, marks, ranks, 100, 9_000) == ids[100:9_100]).all() and len(dac_read(levels, marks, ranks, 5, 0)) == 0


def test_store_round_trip(spark, tmp_path):
    rows, path = awkward_texts(), str(tmp_path / "store")
    write_token_store(frame(spark, rows), path)
    library = load_tokenizer("word_bpe_49k.json")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for _, t in ordered]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    expected = [(k, int(s), len(i), zlib.crc32(i.tobytes())) for (k, _), s, i in zip(ordered, starts, ids)]
    found = [tuple(r) for r in read_token_store(spark, path).orderBy("start").collect()]
    assert found == expected
    everything, wanted = np.concatenate(ids), [0, 5, len(np.concatenate(ids)) - 1, 77, 77]
    positions = spark.createDataFrame([(p,) for p in [*wanted, None, -1, len(everything)]], "position long")
    assert sorted(map(tuple, tokens_at(spark, path, positions).collect())) == sorted((p, int(everything[p])) for p in wanted)


def test_empty_store(spark, tmp_path):
    write_token_store(frame(spark, []), str(tmp_path / "store"))
    assert read_token_store(spark, str(tmp_path / "store")).collect() == []


@pytest.mark.parametrize("table_entries", [0, 5, 1 << 16])
def test_counts_are_the_librarys(spark, table_entries):
    rows = awkward_texts() + [(1000 + i, t) for i, t in enumerate(_odd_texts(300))]
    library = load_tokenizer("byte_bpe_50k.json")
    expected = []
    for k, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((k, t, len((t or "").encode()), n, n > 512))
    counted = token_counts(frame(spark, rows), table_entries=table_entries)
    assert {"lang", "source", "name", "rate"} <= set(counted.columns) and counted.columns.count("n_tokens") == 1
    found = [(r.doc_id, r.text, r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect()]
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x.encode()) for x in r[:1]) + ((r[1] or "").encode(),)
    assert sorted(found, key=order) == sorted(expected, key=order)


def test_counts_of_an_empty_table(spark):
    assert token_counts(frame(spark, [])).collect() == []


def test_memory_of_the_store_is_bounded(spark, tmp_path, monkeypatch):
    """Batches of few rows and bytes reach the workers, few bytes are remembered, and the session stays as it was."""
    from flowquarry.llm import token_store

    seen, name, inner = str(tmp_path / "seen"), "spark.sql.execution.arrow.maxRecordsPerBatch", token_store._segments

    def spied(*args):
        def run(batches):
            def count():
                for b in batches:
                    with open(seen, "a") as f:
                        f.write(f"{len(b)} {b.nbytes}\n")
                    yield b
            return inner(*args)(count())
        return run

    monkeypatch.setattr(token_store, "_segments", spied)
    before, text = spark.conf.get(name), "word" + " " * 100_000
    write_token_store(spark.range(1500).selectExpr("id AS doc_id", f"'{text}' AS text").coalesce(1), str(tmp_path / "store"))
    sizes = [tuple(map(int, line.split())) for line in open(seen)]
    assert sum(n for n, _ in sizes) == 1500 and max(n for n, _ in sizes) <= 512 and max(b for _, b in sizes) < 16 << 20
    assert spark.conf.get(name) == before
    words = WordIds("word_bpe_49k.json")
    words.texts([b"Q" * 500 + b" short"])
    assert b"short" in words.cache and max(map(len, words.cache)) <= 64


def test_earlier_mixing_targets_stay():
    import corpus_pipeline

    assert corpus_pipeline.WEIGHTS == {"en": 0.50, "de": 0.15, "fr": 0.15, "es": 0.12, "low": 0.08}
