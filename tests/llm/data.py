"""Small texts with the awkward cases: NULL, empty, blank, very long, tied, repeated and clashing."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "ra", "se", "ti", "vo", "zu") for b in ("n", "rt", "lk", "s", "", "mp", "dd", "ff")]


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(words))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): copies, near copies, shared passages, and every awkward case."""
    base, other, passage = prose(1, 120), prose(2, 90), prose(3, 40)
    near = base.split()
    near[60] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (10, base), (4, base), (11, "  ".join(base.split())), (12, " ".join(near)), (13, base.upper()),
        (20, other), (21, other + " " + passage), (22, passage), (23, prose(4, 30) + " " + passage + " " + prose(5, 30)),
        (30, None), (31, ""), (32, " \t\n "), (33, "one"), (34, "one two three four"), (35, "One two three four"),
        (40, prose(6, 20_000)), (41, prose(6, 20_000) + " more"), (42, "x" * 30_000), (43, "x" * 30_049),
        (50, "ünï çødé Ω \U0001f600 " + passage), (50, "ünï çødé Ω \U0001f600 " + passage), (51, "a\x0bb\x0cc\x1cd é <|endoftext|>"),
        (None, base), (None, None), (None, "alone and unlike the rest of them"),
    ]
    return rows + [(100 + i, passage) for i in range(30)]


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """A table with columns whose names the operators use themselves."""
    full = [(k, t, "en", f"src{i % 3}", -1, "mine", 0.5) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_tokens long, name string, rate double").repartition(3)
