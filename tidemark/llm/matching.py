"""Matching entities across sources without keys: blocks across attributes, pairwise features, a calibrated classifier.

Blocks are made across attributes.  Of the records that share a contact value, a place or a date of birth all are compared,
however many they are; pairs that the values and letters of names leave no chance are dropped by whole arrays.  What is
left is compared field by field, and a logistic model trained on weak labels (see ``people``) gives each pair its
probability.

Edge cases: records without any usable attribute meet nobody; repeated records count once; missing attributes are
neither for nor against a pair; a date of birth with day and month exchanged counts as nearly the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import SPREAD, Block, all_pairs, compared, hopeful_pairs
from tidemark.llm.people import joined_before, learn, profiles, scored

BANDS, ROWS, PRIME = 6, 1, (1 << 31) - 1
_RNG = np.random.default_rng(11)
_A, _B = _RNG.integers(1, PRIME, BANDS * ROWS), _RNG.integers(0, PRIME, BANDS * ROWS)


@lru_cache(50_000)
def minhash_bands(words: str) -> tuple[int, ...]:
    """Bands of the MinHash signature of the letter pairs of some words."""
    grams = {hash_pair(w[i : i + 2]) for w in words.split() for i in range(max(1, len(w) - 1))}
    if not grams:
        return ()
    g = np.fromiter(grams, dtype=np.int64)
    least = ((_A[:, None] * g[None, :] + _B[:, None]) % PRIME).min(axis=1).reshape(BANDS, ROWS)
    return tuple(int(x) for x in (least * np.array([[1 + 7919 * r for r in range(ROWS)]])).sum(axis=1))


def hash_pair(pair: str) -> int:
    return sum((i * 1_000_003 + 17) * ord(c) for i, c in enumerate(pair, 1)) % PRIME


def pairs_of(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of all pairs of blocks, of spread ones without those that dates leave no chance."""
    yield from hopeful_pairs(block) if block.kind[0] == SPREAD else all_pairs(block.first, np.arange(len(block.group)))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of contexts too large for a block: they have no finer key, so their chunks meet two by two."""
    return rows.withColumn("sub", F.lit(""))


def match(a: DataFrame, b: DataFrame, golden: DataFrame, threshold: float = 0.5, across: bool = False) -> DataFrame:
    """(id1, id2, differ, probability) of records of one entity, within and across the sources.

    With ``across`` only pairs of a record of ``a`` and one of ``b`` are compared, that of ``a`` being id1.
    """
    codes = compared(profiles(a, b), pairs_of, spread, across)
    return scored(codes, learn(codes, joined_before(golden)), threshold)
