"""Word-wise use of public tokenizers inside tasks: results are the library's, repeated words are looked up."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterable

import numpy as np
from tokenizers import Tokenizer

from flowquarry.llm.batches import keep

WORD_END = "</w>"  # fixed value: how such a vocabulary marks the last token of a pre-token
JOINED = 512  # words given to the library in one string
CLOSING = (b",", b".")  # after a letter or digit, a lone one at the end of a word is a token of its own
CACHE_ENTRIES = 750_000  # words a worker remembers; later new words are encoded each time they occur
CACHE_WORD = 64  # bytes of the longest word that is remembered


def tokenizer_path(name: str) -> str:
    """A path as it is, or the place of a public vocabulary file of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load_tokenizer(name: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores already
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordIds:
    """Ids of texts for a tokenizer that drops white space, as bytes of little-endian 32-bit numbers.

    Such a tokenizer never joins text across white space, so a text's ids are its
    words' ids in a row; words are split at ASCII white space, as bytes. Two more
    equalities spare library calls for new words: case does not matter in ASCII words,
    and one closing comma or full stop after an ASCII letter or digit is a token of its own.
    Special tokens are found before the library ignores case, so text that holds one in
    any case keeps its own.
    """

    def __init__(self, name: str):
        self.tokenizer = load_tokenizer(name)
        self.cache: dict[bytes, bytes] = {}
        special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or rb"(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith(WORD_END)

    def _fold(self, text: bytes) -> bytes:
        """In lower case if that leaves the ids as they are."""
        low = text.lower()
        return text if low == text or not text.isascii() or self.special.search(low) else low

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words by the library. A word of Latin letters is one pre-token, which ends with the only
        id that has the word end; so many of them can be given to the library in one string."""
        texts = [w.decode() for w in words]
        plain = [w.isalpha() or t.isalpha() and max(t) < "\u0250" and "\u0130" not in t for w, t in zip(words, texts)]
        out = {}
        letters = [i for i, p in enumerate(plain) if p]
        joined = [" ".join([texts[i] for i in letters[k:k + JOINED]]) for k in range(0, len(letters), JOINED)]
        for k, found in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.asarray(found.ids, dtype="<u4")
            raw, at = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            for i, start, end in zip(letters[k * JOINED:(k + 1) * JOINED], [0, *at[:-1]], at, strict=True):
                out[words[i]] = raw[start:end]
        rest = [w for w, p in zip(words, plain) if not p]
        out.update(zip(rest, self._library(rest)))
        return out

    def _library(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the cache lacks; ASCII words of either case share them unless they hold a special token."""
        cores = {w: self._fold(w) for w in words}
        stems = {c: c[:-1] if c[-1:] in CLOSING and c[-2:-1].isalnum() else c for c in cores.values()}
        cache = self.cache
        ids = self._encode([s for s in {*stems.values(), *CLOSING} if s not in cache])
        found = lambda s: ids[s] if s in ids else cache[s]
        whole = {c: found(s) if len(s) == len(c) else found(s) + found(c[-1:]) for c, s in stems.items()}
        out = {w: whole[c] for w, c in cores.items()}
        if len(cache) < CACHE_ENTRIES:
            for w, i in itertools.chain(ids.items(), out.items()):
                if len(w) <= CACHE_WORD:
                    cache[w] = i
                    if len(cache) >= CACHE_ENTRIES:
                        break
        return out

    def texts(self, texts: Iterable[bytes | None]) -> list[bytes]:
        split = [self._fold(t).split() if t else [] for t in texts]
        distinct = list(set().union(*split))
        # the words of these texts only: a small table is faster to look up in, and the cache may be full
        known = dict(zip(distinct, map(self.cache.get, distinct)))
        new = [w for w, ids in known.items() if ids is None]
        if new:
            known.update(self.learn(new))
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


@functools.lru_cache(maxsize=2)
def word_ids(name: str) -> WordIds:
    """One per worker process; it lives on between tasks, until the process does other work."""
    return WordIds(name)


keep(word_ids.cache_clear)
keep(load_tokenizer.cache_clear)
