import itertools
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from flowquarry.llm import decontamination
from flowquarry.llm.decontamination import MASKS, contamination_report, decontaminate
from flowquarry.llm.line_dedup import drop_boilerplate, spread_lines
from tests.llm.data import WORDS, awkward_texts, frame, prose


def _sites(spark, rows):
    return spark.createDataFrame([(k, t, s, 1, "x") for k, t, s in rows], "doc_id long, text string, source string, n_lines int, site string").repartition(3)


def test_boilerplate_equals_exact_counts(spark):
    pick, rows = random.Random(4), []
    lines = [f"a line that may be boilerplate {i}" for i in range(30)] + ["short", "", "  blank around the line  "]
    for i in range(300):
        rows.append((i % 250, "\n".join(pick.choice(lines[:pick.choice([5, 15, 33])]) for _ in range(pick.randint(0, 6))), pick.choice([None, *[f"s{j}" for j in range(14)]])))
    rows += [(900, None, "s1"), (None, lines[0] + "\n" + lines[1], "s2"), (901, "\n", None), (902, ("own line of this text %d\n" * 3000) % tuple(range(3000)), "s3")]
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            sites[line.strip(" ")].add(s)
    for least in (3, 10):
        expected = Counter()
        for k, t, _ in rows:
            every = (t or "").split("\n")
            left = [x for x in every if not x.strip(" ") or len(sites[x.strip(" ")]) < least]
            expected[(k, len(every), len(every) - len(left), "\n".join(left))] += 1
        found = drop_boilerplate(_sites(spark, rows), min_sites=least).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in found) == expected


def test_sketches_beyond_the_near_band(spark):
    lines = spark.range(40_000).select((F.col("id") % 4).alias("h1"), F.lit(0).cast("long").alias("h2"),
                                       F.concat(F.lit("s"), (F.col("id") / 4 % F.lit(1) + F.floor(F.col("id") / 4) % F.pow(F.lit(10), F.col("id") % 4)).cast("int").cast("string")).alias("site"))
    assert {r.h1 for r in spread_lines(lines, 100).collect()} == {2, 3}


def test_no_lines(spark):
    assert drop_boilerplate(_sites(spark, [])).collect() == []


def _words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def _brute_force(docs, items, window=16, share=0.75):
    """Items found under any shift of the item on the document."""
    out = {}
    for d, (_, text) in enumerate(docs):
        w, found = _words(text), set()
        for item, passage in items:
            p = _words(passage)
            for shift in range(-len(p) + 1, len(w)):
                equal = [w[j + shift] == p[j] for j in range(max(0, -shift), min(len(p), len(w) - shift))]
                least = min(len(p), window)
                best = max((sum(equal[i:i + least]) for i in range(len(equal) - least + 1)), default=-1)
                if p and best >= share * least:
                    found.add(item)
        out[d] = found
    return out


def test_masks_fit_under_every_choice_of_substitutions():
    for n in range(1, 17):
        masks = [m for least, found in MASKS if least <= n for m in [found]][-1]
        for gone in itertools.combinations(range(n), n - math.ceil(0.75 * n)):
            places = [(m, i) for m in masks for i in range(n - len(m) + 1)]
            assert any(all(i + k not in gone for k, bit in enumerate(m) if bit == "1") for m, i in places)


def test_short_items_are_found_with_every_allowed_substitution(spark):
    words, docs, items, expected = [f"w{i}" for i in range(200)], [], [], {}
    for n in range(1, 17):
        passage = [f"p{n}x{j}" for j in range(n)]
        items.append((n, " ".join(passage)))
        allowed = n - math.ceil(0.75 * n)
        for gone in itertools.islice(itertools.combinations(range(n), allowed), 0, None, 7):
            there = [f"q{j}" if j in gone else x for j, x in enumerate(passage)]
            docs.append((len(docs), " ".join(words[:20] + there + words[20:40])))
            expected[len(docs) - 1] = n
        if allowed < n - 1:  # one more is too many
            there = [f"q{j}" if j <= allowed else x for j, x in enumerate(passage)]
            docs.append((len(docs), " ".join(there)))
    found = {r.doc_id: r.item_id for r in contamination_report(frame(spark, docs), _benchmark(spark, items)).collect() if r.contaminated}
    assert found == expected and len(expected) > 300


def _benchmark(spark, items):
    return spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, _key string")


ITEMS = [(1, prose(101, 25)), (2, prose(102, 14)), (3, prose(103, 40)), (4, "rather short"), (5, None), (6, prose(101, 25)), (7, "..")]


def _documents():
    pick, rows = random.Random(9), awkward_texts()[:12]
    for i in range(30):
        passage = _words(ITEMS[i % 3][1])
        for _ in range(i // 3):  # more and more substituted words
            passage[pick.randrange(len(passage))] = pick.choice(WORDS) + "x"
        if i % 5 == 0:
            passage = passage[len(passage) // 3:]
        rows.append((1000 + i, prose(i, 20) + ", " + ", ".join(passage).upper() + " " + prose(i + 50, 15)))
    return rows


def test_contamination_equals_brute_force(spark, monkeypatch):
    docs = _documents()
    expected = _brute_force(docs, [(k, t) for k, t in ITEMS])
    for bound in (2_000_000, 0):  # broadcast seeds, and seeds joined by a shuffle
        monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", bound)
        found = contamination_report(frame(spark, docs), _benchmark(spark, ITEMS)).collect()
        assert Counter((r.doc_id, r.contaminated, r.n_items) for r in found) == Counter((k, bool(expected[i]), len(expected[i])) for i, (k, _) in enumerate(docs))
    left = decontaminate(frame(spark, docs), _benchmark(spark, ITEMS))
    assert left.columns == frame(spark, docs).columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(k for i, (k, _) in enumerate(docs) if not expected[i])


def test_whole_passages_are_found_and_others_are_not(spark):
    docs = [(i, prose(i, 30) + " " + ITEMS[i % 3][1] + " " + prose(i + 7, 30)) for i in range(10)] + [(100 + i, prose(900 + i, 80)) for i in range(10)]
    found = {r.doc_id: r.contaminated for r in contamination_report(frame(spark, docs), _benchmark(spark, ITEMS)).collect()}
    assert found == {k: k < 100 for k, _ in docs}


def test_empty_tables(spark):
    assert contamination_report(frame(spark, []), _benchmark(spark, ITEMS)).collect() == []
    docs = frame(spark, awkward_texts())
    assert decontaminate(docs, _benchmark(spark, [])).count() == docs.count()
