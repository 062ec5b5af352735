"""Token counts by a two-tier lookup in the map tasks; no pre-token is shuffled.

Tier 1 is a broadcast hash table of the lengths of the most frequent pre-tokens, of at
most ``table_entries`` entries of at most ``MAX_KEY`` characters each. Tier 2 is a cache in
each worker: a pre-token that tier 1 lacks is encoded by the library once and remembered.
Both only save work, the counts are the library's.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.tokenizing import load_tokenizer

# Fixed value: the pre-token pattern that byte-level vocabularies of this family state.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MAX_KEY = 48
TABLE_ENTRIES = 1 << 16
SUMMARY_WORDS = 1 << 19  # words a task counts at once; beyond, those seen once are let go
SUMMARY_ROWS = 1 << 14  # pre-tokens a task reports
CACHE_ENTRIES = 1_000_000


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens of a task's texts, by words at white space, in bounded memory."""
    words: Counter[str] = Counter()
    for batch in batches:
        for text in batch["text"]:
            words.update((text.as_py() or "").split())
            while len(words) > SUMMARY_WORDS:
                least = min(words.values())
                words = Counter({w: n for w, n in words.items() if n > least})
    tokens: Counter[str] = Counter()
    for word, n in words.items():
        for token in PRE_TOKEN.findall(" " + word):
            if len(token) <= MAX_KEY:
                tokens[token] += n
    top = tokens.most_common(SUMMARY_ROWS)
    yield pa.RecordBatch.from_pydict({
        "token": pa.array([t for t, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})


def frequent_lengths(df: DataFrame, text: Column, tokenizer: str, table_entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Tokens in each of the most frequent pre-tokens of the whole table.

    Tasks report summaries of bounded size, which are added up; the cut to ``table_entries`` bounds the table.
    """
    counts = df.select(text.alias("text")).mapInArrow(_frequent, "token string, n long")
    top = counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(table_entries)
    tokens = [r.token for r in top.select("token").collect()]
    found = load_tokenizer(tokenizer).encode_batch_fast(tokens, add_special_tokens=False)
    return {t: len(e) for t, e in zip(tokens, found)}


class PreTokenLengths:
    """Tier 2: the lengths a worker has worked out itself."""

    def __init__(self, tokenizer: str):
        self.tokenizer = load_tokenizer(tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, int] = {}

    def count(self, texts: list[str], frequent: dict[str, int]) -> np.ndarray:
        """Tokens of each text. A text that holds the string of a special token goes to the library whole."""
        out = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = len(self.tokenizer.encode(text, add_special_tokens=False))
                continue
            tokens = PRE_TOKEN.findall(text)
            lengths = [frequent.get(t) for t in tokens]
            if None in lengths:
                rare = [t for t, n in zip(tokens, lengths) if n is None]
                out[i] = sum(n for n in lengths if n is not None) + self.rare(rare)
            else:
                out[i] = sum(lengths)
        return out

    def rare(self, tokens: list[str]) -> int:
        lengths = [self.cache.get(t) for t in tokens]
        if None not in lengths:
            return sum(lengths)
        new = list({t for t, n in zip(tokens, lengths) if n is None})
        found = {t: len(e) for t, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
        if len(self.cache) < CACHE_ENTRIES:
            self.cache.update(found)
        return sum(found[t] if n is None else n for t, n in zip(tokens, lengths))


@functools.lru_cache(maxsize=2)
def pre_token_lengths(tokenizer: str) -> PreTokenLengths:
    return PreTokenLengths(tokenizer)


def token_counts(
    df: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512,
    table_entries: int = TABLE_ENTRIES,
) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A NULL text counts as empty: 0, 0, false. Rows are neither moved nor merged, so ties, repeated
    rows and NULL keys stay; columns named like the results are replaced; an empty table stays empty.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    frequent = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, value, tokenizer, table_entries))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths, table = pre_token_lengths(tokenizer), frequent.value
        for batch in batches:
            yield pd.Series(lengths.count(batch.tolist(), table))

    counted = df.withColumn("n_tokens", count(value))
    return counted.withColumns({
        "n_bytes": F.octet_length(value).cast("long"), "over_limit": F.col("n_tokens") > limit})
