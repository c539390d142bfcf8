"""Exact deduplication against a minimal perfect hash over historical digests.

The history's distinct digests are cut into shards by hash.  Each shard gets a
minimal perfect hash: cascading bit arrays, in which a key owns its bit if no
other key of the level falls on it; keys that collide go to the next level.
The rank of a key's bit is its slot, and slots hold the full 32-byte digest,
the locator of the winning row and the number of rows.  A new batch, reduced to
its distinct digests, looks up its slot and compares all bytes there: a repeat
updates the slot's winner, a nonmember forms a group of its own.

Rows meet their verdict by digest; the partition of a text that a third of all
rows have is split by Spark's adaptive execution.

Defined results: null text is empty; a null doc_id never stays unless its whole
group lacks ids; repeated rows are counted each; texts of any length are hashed
whole; ties cannot be, as rows that share the winning id all win; other
columns, whatever their names, stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage, unused

GAMMA = 2.0
KEYS_PER_SHARD = 100_000
NO_ID = -(2**63)  # stands for a null doc_id inside the index
INDEX = "shard int, n long, sizes binary, bits binary, digests binary, winners binary, counts binary"
VERDICT = "digest binary, keep_id long, group_size long"


def digest(text: Column) -> Column:
    """SHA-256 of the text after lower-casing A-Z; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def _words(digests: np.ndarray, level: int) -> np.ndarray:
    """A hash of each digest for one level, from its four 8-byte words."""
    w = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    x = w[:, level % 4] + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def build_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes, concatenated level bits and each key's slot, for distinct (n, 32) digests."""
    left, sizes, bits = np.arange(len(digests)), [], []
    slots, used = np.zeros(len(digests), np.int64), 0
    while len(left):
        m = max(64, int(GAMMA * len(left)))
        h = (_words(digests[left], len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(h, minlength=m) == 1
        own = alone[h]
        slots[left[own]] = used + np.cumsum(alone)[h[own]] - 1
        used += int(own.sum())
        sizes.append(m)
        bits.append(alone)
        left = left[~own]
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool), slots


def find_slots(digests: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 if it falls through; a nonmember may get any slot."""
    rank = np.cumsum(bits) - 1
    out, left, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, m in enumerate(sizes):
        h = base + (_words(digests[left], level) % np.uint64(m)).astype(np.int64)
        hit = bits[h]
        out[left[hit]] = rank[h[hit]]
        left, base = left[~hit], base + int(m)
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _matrix(pdf.digest)
    sizes, bits, slots = build_hash(keys)
    order = np.argsort(slots)
    return pd.DataFrame([{
        "shard": pdf["shard"].iloc[0], "n": len(keys), "sizes": sizes.tobytes(), "bits": np.packbits(bits).tobytes(),
        "digests": keys[order].tobytes(), "winners": pdf.winner.to_numpy(np.int64)[order].tobytes(), "counts": pdf.n.to_numpy(np.int64)[order].tobytes(),
    }])


def _lookup(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    own, winners, counts = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = _matrix(batch.digest)
    new = np.ones(len(keys), bool)
    w, n = batch.winner.to_numpy(np.int64), batch.n.to_numpy(np.int64)
    if len(index):
        row = index.iloc[0]
        sizes = np.frombuffer(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        own = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, counts = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
        slot = find_slots(keys, sizes, bits)
        found = np.flatnonzero(slot >= 0)
        found = found[(own[slot[found]] == keys[found]).all(axis=1)]
        new[found] = False
        winners[slot[found]] = np.maximum(winners[slot[found]], w[found])
        counts[slot[found]] += n[found]
    return pd.DataFrame({
        "digest": [x.tobytes() for x in own] + [keys[i].tobytes() for i in np.flatnonzero(new)],
        "keep_id": np.concatenate([winners, w[new]]), "group_size": np.concatenate([counts, n[new]]),
    })


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    groups = rows.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("winner"), F.count("*").alias("n"))
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the hash and its slots.  ``history`` has digest and doc_id."""
    return _distinct(history, shards).groupBy("shard").applyInPandas(_build, INDEX)


def resolve(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of every digest of the index and of the batch."""
    return index.groupBy("shard").cogroup(_distinct(batch, shards).groupBy("shard")).applyInPandas(_lookup, VERDICT)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every row's group: doc_id, keep_id, group_size, kept, text_sha256.

    The older half of the id range is the history, the newer half the batch.
    Texts are equal if identical after lower-casing A-Z; the largest doc_id
    stays.  Null counts as empty text.  Rows without doc_id count in
    group_size and are never kept unless the whole group lacks ids.  Repeated
    rows are rows: each is counted, and rows that share the winning id are all
    marked kept (``drop_repeats`` leaves one).  An empty table gives no rows.
    """
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    middle = 0 if low is None else (low + high) // 2
    shards = max(1, -(-n // KEYS_PER_SHARD))
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    index = build_index(rows.where(old), shards)
    verdict = resolve(index, rows.where(~old), shards).withColumn("keep_id", F.nullif("keep_id", F.lit(NO_ID)))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(verdict, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged, one per distinct text.

    Rows of one id and text are one before anything is shuffled, and texts are shuffled once: what stays is looked
    up where that put them.
    """
    own_id, own_sha = unused(docs, "own_id", "own_sha")
    known = lambda c: F.coalesce(c.cast("long"), F.lit(NO_ID))
    kept = exact_groups(docs).where("kept").select(known(F.col("doc_id")).alias(own_id), F.col("text_sha256").alias(own_sha))
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    rows = docs.withColumns({own_id: known(F.col("doc_id")), own_sha: sha}).dropDuplicates([own_id, own_sha])
    return rows.join(kept, [own_id, own_sha], "left_semi").select(*docs.columns)
