"""Stateless hashed text vectors.

Buckets come from SHA-256, so any engine can reproduce them. The helpers run per Arrow batch and
remember token buckets, because natural text repeats its tokens; the memory is bounded.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vector sizes and token patterns of the two text vectors.
WORD_DIMENSIONS = 384
GRAM_DIMENSIONS = 512
WORD_PATTERN = r"\b\w\w+\b"
GRAM_WORD_PATTERN = r"[0-9a-z가-힣_]+"
GRAM_SIZES = (2, 3, 4)

MEMO = 1 << 16  # remembered tokens per Python worker; the memory starts over when it is full
MEMO_LENGTH = 64  # longer tokens are rarely seen again and are not remembered
PAIR_FACTOR = 1_000_003
WORDS = re.compile(WORD_PATTERN)
GRAM_WORDS = re.compile(GRAM_WORD_PATTERN)
VECTOR = T.ArrayType(T.IntegerType())


class Memo(dict):
    """Token to hash, filled on first use and bounded in tokens and in their length."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, token: str):
        if len(token) > MEMO_LENGTH:
            return self.compute(token)
        if len(self) >= MEMO:
            self.clear()
        value = self[token] = self.compute(token)
        return value


def word_hash(token: str) -> int:
    return int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big")


def gram_bucket(token: str) -> tuple[int, int]:
    digest = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(digest[:4], "big") % GRAM_DIMENSIONS, 1 if digest[4] & 1 else -1


WORD_HASHES = Memo(word_hash)
GRAM_BUCKETS = Memo(gram_bucket)


@F.pandas_udf(VECTOR)
def word_vector(texts: pd.Series) -> pd.Series:
    """Unnormalised counts of hashed words and word pairs; a pair mixes the hashes of its words."""
    rows = []
    for text in texts:
        words = WORDS.findall((text or "").lower())
        hashes = np.fromiter((WORD_HASHES[w] for w in words), dtype=np.int64, count=len(words))
        pairs = (hashes[:-1] * PAIR_FACTOR + hashes[1:]) % (1 << 32)
        buckets = np.concatenate([hashes, pairs]) % WORD_DIMENSIONS
        rows.append(np.bincount(buckets, minlength=WORD_DIMENSIONS).astype(np.int32))
    return pd.Series(rows)


@F.pandas_udf(VECTOR)
def gram_vector(texts: pd.Series) -> pd.Series:
    """Unnormalised signed counts of hashed words and character 2- to 4-grams."""
    rows = []
    for text in texts:
        folded = unicodedata.normalize("NFKC", text or "").lower()
        dense = "".join(folded.split())
        grams = Counter(f"w:{w}" for w in GRAM_WORDS.findall(folded))
        for n in GRAM_SIZES:
            grams.update(f"c{n}:{dense[i:i + n]}" for i in range(len(dense) - n + 1))
        vector = np.zeros(GRAM_DIMENSIONS, dtype=np.int32)
        for gram, count in grams.items():
            bucket, sign = GRAM_BUCKETS[gram]
            vector[bucket] += sign * count
        rows.append(vector)
    return pd.Series(rows)
