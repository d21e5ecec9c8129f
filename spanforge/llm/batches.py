"""Batches of documents that ask shards about keys and get answers back.

Documents are dealt to batches by a hash of their id; the batch is the unit that a Python worker holds. A batch sends each
shard the distinct keys it has there, so a key that a third of all documents hold comes to its shard once a batch at
most. The shard answers with a few bits for each key, in the order it was asked; the batch regenerates its keys and reads
the answers off. Documents cross the network once: every pass over the batches uses the same exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import bucket

#: Text that a batch holds on average, and the text whose keys one shard holds. Batches follow the input's size; from MANY batches on they first grow to MOST_BYTES.
BATCH_BYTES = 4_000_000
MOST_BYTES = 16_000_000
MANY = 1024
#: Batches or pairs of texts in a batch that make a key frequent.
OFTEN = 32


def size_of(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text)."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return row.n, row.b or 0


def batched(docs: DataFrame, n_batches: int) -> DataFrame:
    return docs.select(bucket(F.col("doc_id"), n_batches, seed=17).alias("batch"), "doc_id", "text")


def batch_count(n_bytes: int) -> int:
    """Follows the input alone, so that the rows between batches and shards do too. These are the square of it."""
    return max(16, min(-(-n_bytes // BATCH_BYTES), max(MANY, -(-n_bytes // MOST_BYTES))))


def first_copies(docs: DataFrame, n_batches: int) -> DataFrame:
    """(batch, kind, shard, again, often) of kind 0: ``shard`` is the smallest id that has a text, told to its batch."""
    nothing = F.lit(None).cast("binary")
    least = docs.groupBy(F.sha2("text", 256).alias("same")).agg(F.min("doc_id").alias("doc_id"))
    return least.select(
        bucket(F.col("doc_id"), n_batches, seed=17).alias("batch"), F.lit(0).alias("kind"), F.col("doc_id").alias("shard"), nothing.alias("again"), nothing.alias("often")
    )


def with_told(dealt: DataFrame, told: DataFrame):
    """Batches with what they were told, to work on together."""
    return dealt.groupBy("batch").cogroup(told.groupBy("batch"))


def by_shard(keys: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, shard bounds, 32 further bits) of distinct 64-bit keys: sorted by shard, then by those bits.

    The shard comes from the upper half and the bits sent from the lower half. Two keys that agree in both count as one,
    which shards of a few million keys see in one of a thousand keys; users of the answers must not mind.
    """
    shard = ((keys >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.lexsort((low, shard))
    return order, np.searchsorted(shard[order], np.arange(n_shards + 1)), low[order]


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).view(bool)


def texts_of(group: pa.Table) -> tuple[list[int], list[str]]:
    """Ids and texts of a batch in the order of ids, which is the same in every pass."""
    ids, texts = group.column("doc_id").to_pylist(), group.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    return [ids[k] for k in order], [texts[k] for k in order]


QUESTIONS = "shard long, batch long, keys binary, twice binary"
ANSWERS = "batch long, shard long, again binary, often binary"


def questions(batch: int, bounds: np.ndarray, low: np.ndarray, twice: np.ndarray) -> pa.Table:
    """A row for each shard that a batch has keys for; ``twice`` marks keys that two texts of the batch hold."""
    full = np.flatnonzero(np.diff(bounds))
    return pa.table(
        {
            "shard": pa.array(full, pa.int64()),
            "batch": pa.array([batch] * full.size, pa.int64()),
            "keys": pa.array([low[bounds[s] : bounds[s + 1]].tobytes() for s in full], pa.binary()),
            "twice": pa.array([pack_bits(twice[bounds[s] : bounds[s + 1]]) for s in full], pa.binary()),
        }
    )


def answers(asked: DataFrame) -> DataFrame:
    """For each batch and shard two bits a key: whether it occurs again anywhere, and whether it occurs often."""

    def answer(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in group.column("keys").to_pylist()]
        twice = [unpack_bits(t, k.size) for t, k in zip(group.column("twice").to_pylist(), keys, strict=True)]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.ones(every.size, bool)
        np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
        at = np.flatnonzero(first)
        count = np.add.reduceat(1 + np.concatenate(twice)[order].astype(np.int32), at)
        total = np.empty(every.size, np.int32)
        total[order] = np.repeat(count, np.diff(np.append(at, every.size)))
        parts = np.split(total, np.cumsum([k.size for k in keys])[:-1])
        return pa.table(
            {
                "batch": group.column("batch"),
                "shard": group.column("shard"),
                "again": pa.array([pack_bits(p > 1) for p in parts], pa.binary()),
                "often": pa.array([pack_bits(p >= OFTEN) for p in parts], pa.binary()),
            }
        )

    return asked.groupBy("shard").applyInArrow(answer, ANSWERS)
