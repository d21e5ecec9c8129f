"""Operator 1: removal of 50-byte strings that occur in an earlier document, by interval expansion on a BWT.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id; strings lie within
one document and are judged on the input.

1. Every window of LENGTH bytes is known by the least hash of the GRAM-byte strings in it. Equal windows have equal least
   hashes, so runs of windows with one least hash ("segments") are what may be compared with each other. Batches ask
   shards which of their hashes any other document has; most of the text ends here. Strings of 32 bytes seldom recur by chance, so what is left
   doesn't grow faster than the input.
   Segments of a frequent hash are split again by the least of a second hash, so that common strings of GRAM bytes don't bring
   all that holds them together in one shard.
2. Batches send the distinct contents of the remaining segments, with the smallest document that holds each, to the shard of
   the hash. Equal contents settle each other: all but the smallest document lose every window.
3. Where a hash has several contents, the shard, some hashes at a time, sorts their suffixes by 64 bytes and builds the Burrows-Wheeler
   transform. Intervals of rows that start alike are extended backwards breadth first; the first interval to end at a
   row gives that row's common prefix with the row before, so the values come in increasing order. The search stops at LENGTH; rows
   without a value share LENGTH bytes or more. The smallest document of each such group decides.
4. Shards answer with bits, and batches remove what is covered.

A text that a third of all documents have is one content a batch. Copies of a whole text are reduced to the smallest id before
all this; a copy loses all of its bytes if it has LENGTH of them.

Edge cases: a null or empty text loses nothing; texts shorter than LENGTH bytes neither lose nor cause anything; rows with one
id, of equal or different texts, don't touch each other, as an id is not smaller than itself; a row with a null id neither loses nor causes
anything; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import batches as B
from spanforge.llm.common import id_and_text, table

LENGTH = 50
GRAM = 32
CHUNK_BYTES = 1 << 18
#: Contents that are sorted at once: no more than a processor's cache holds, whatever a shard holds.
SORT_BYTES = 1 << 17
_SORTED = 64
_rng = np.random.default_rng(50)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_FACTOR = _rng.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, by doubling."""
    h, m, k = _BYTE[buf], 1, 0
    while m < GRAM:
        n = h.size - m
        left = h[:n] * _FACTOR[k]
        left ^= left >> np.uint64(31)
        left += h[m:]
        h, m, k = left, 2 * m, k + 1
    h *= _FACTOR[7]
    h ^= h >> np.uint64(32)
    return h


def _mixed(h: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Hashes in an order of their own."""
    h = h * factor
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    m = 1
    while 2 * m <= width:
        h = np.minimum(h[:-m], h[m:])
        m *= 2
    return np.minimum(h[: h.size - (width - m)], h[width - m :]) if m < width else h


def segments(texts: list[bytes], second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, hash) of each run of windows with one least hash, in order; ``second`` takes another hash."""
    out: list[tuple[np.ndarray, ...]] = []
    part: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        nonlocal part, size, first
        if size >= LENGTH:
            lengths = np.array([len(t) for t in part])
            begin = np.cumsum(lengths) - lengths
            grams = _gram_hashes(np.frombuffer(b"".join(part), np.uint8))
            least = _least(_mixed(grams, _FACTOR[6]) if second else grams, LENGTH - GRAM + 1)
            change = np.empty(least.size + 1, bool)
            change[0] = change[-1] = True
            np.not_equal(least[1:], least[:-1], out=change[1:-1])
            change[begin[begin < least.size]] = True
            ends = begin + lengths - LENGTH + 1  # windows from here on would leave the text
            change[ends[(ends > begin) & (ends < least.size)]] = True
            edge = np.flatnonzero(change)
            start, width = edge[:-1], np.diff(edge)
            doc = np.searchsorted(begin, start, side="right") - 1
            inside = start < ends[doc]
            out.append((doc[inside] + first, (start - begin[doc])[inside], width[inside], least[start[inside]]))
        part, size, first = [], 0, upto

    for k, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            flush(k)
        part.append(text)
        size += len(text)
    flush(len(texts))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class _Batch:
    """A batch's documents that stand for their copies, their segments, and the segments' hashes by shard."""

    def __init__(self, group: pa.Table, stands: set[int], n_shards: int):
        self.ids, texts = B.texts_of(group)
        self.raw = [t.encode() for t in texts]
        chosen: dict[tuple[int, bytes], int] = {}
        for k, doc in enumerate(self.ids):
            if doc in stands:
                chosen.setdefault((doc, self.raw[k]), k)
        self.own = sorted(chosen.values())
        self.doc, self.start, self.width, hashes = segments([self.raw[k] for k in self.own])
        self.keys, self.key_of = np.unique(hashes, return_inverse=True)
        self.order, self.bounds, self.low = B.by_shard(self.keys, n_shards)
        self.n_shards = n_shards

    def twice(self) -> np.ndarray:
        """Whether two documents of the batch have a hash, by shard order."""
        low = np.full(self.keys.size, np.iinfo(np.int64).max)
        high = np.full(self.keys.size, -1)
        np.minimum.at(low, self.key_of, self.doc)
        np.maximum.at(high, self.key_of, self.doc)
        return (high > low)[self.order]

    def contents(self, answers: list[tuple[int, bytes, bytes]]) -> _Contents:
        """The distinct contents of segments whose hashes occur again, in the order of their first segment."""
        again, often = np.zeros(self.keys.size, bool), np.zeros(self.keys.size, bool)
        for shard, bits, more in answers:
            own = self.order[self.bounds[shard] : self.bounds[shard + 1]]
            again[own], often[own] = B.unpack_bits(bits, own.size), B.unpack_bits(more, own.size)
        raws = [self.raw[k] for k in self.own]
        at = np.flatnonzero(again[self.key_of])
        doc, start, width, keys = self._split(raws, at, often)
        place: dict[bytes, int] = {}
        index = [place.setdefault(raws[d][a:b], len(place)) for d, a, b in zip(doc.tolist(), start.tolist(), (start + width + LENGTH - 1).tolist(), strict=True)]
        which = np.array(index, np.int64)
        first = np.unique(which, return_index=True)[1]
        ids = np.array([self.ids[k] for k in self.own], np.int64)[doc]
        shard = ((keys[first] >> np.uint64(32)) % np.uint64(self.n_shards)).astype(np.int64)
        return _Contents(list(place), doc, start, width, which, ids, keys[first], shard, ids[first])

    def _split(self, raws: list[bytes], at: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, windows, hash) of these segments in order, those of a frequent hash split by the second hash.

        Whether a hash is frequent is the same for all batches, so equal windows still have equal hashes.
        """
        hot = often[self.key_of[at]]
        cold, hot = at[~hot], at[hot]
        doc, start = self.doc[hot], self.start[hot]
        part, begin, width, second = segments([raws[d][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), (start + self.width[hot] + LENGTH - 1).tolist(), strict=True)], second=True)
        both = _mixed(self.keys[self.key_of[hot]][part] ^ second, _FACTOR[5])
        columns = zip((self.doc[cold], self.start[cold], self.width[cold], self.keys[self.key_of[cold]]), (doc[part], start[part] + begin, width, both), strict=True)
        doc, start, width, keys = (np.concatenate(c) for c in columns)
        order = np.lexsort((start, doc))
        return doc[order], start[order], width[order], keys[order]


class _Contents(NamedTuple):
    raw: list[bytes]
    text: np.ndarray  # by segment: the text, where it starts, its windows, which content it has, its document
    start: np.ndarray
    width: np.ndarray
    which: np.ndarray
    doc: np.ndarray
    keys: np.ndarray  # by content: hash, shard, smallest document
    shard: np.ndarray
    least: np.ndarray

    def by_shard(self):
        """(shard, places of its contents in order)."""
        order = np.argsort(self.shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(self.shard[order])) + 1):
            if own.size:
                yield int(self.shard[own[0]]), own


def group_by_prefix(buf: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, group of each row): rows of one group start with the same ``length`` bytes.

    ``buf`` ends in at least 64 zero bytes. Suffixes are sorted by their first 64 bytes; the groups come from the BWT alone.
    """
    n = buf.size
    key = np.zeros(n, np.uint64)
    key[:] = buf
    for m in (1, 2, 4):
        nxt = np.zeros(n, np.uint64)
        nxt[: n - m] = key[m:]
        key = (key << np.uint64(8 * m)) | nxt
    m = 8
    while True:
        order = np.argsort(key)  # rows that tie may stand in any order: only groups are read from it
        if m >= _SORTED:
            break
        ranked = key[order]
        step = np.zeros(n, np.uint64)
        np.not_equal(ranked[1:], ranked[:-1], out=step[1:], casting="unsafe")
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(step, dtype=np.uint64)
        nxt = np.zeros(n, np.uint64)
        nxt[: n - m] = rank[m:]
        key = (rank << np.uint64(32)) | nxt
        m *= 2
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    before = row_of[order - 1]  # the row of the suffix one byte longer; the first suffix has none
    begins = buf[order]
    lonely = int(row_of[0])
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lb, rb = np.array([0]), np.array([n])
    label = np.full(n, -1, np.int64)
    for _ in range(length):  # common prefixes of 0, 1, ... length - 1 bytes
        sizes = rb - lb
        rows = np.repeat(lb - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        interval = np.repeat(np.arange(lb.size), sizes)
        fine = rows != lonely
        rows, interval = rows[fine], interval[fine]
        to = before[rows]
        if to.size * 8 < n:
            sort = np.argsort(to)
            to, owner = to[sort], interval[sort]
        else:
            label[to] = interval
            to = np.flatnonzero(label >= 0)
            owner = label[to]
            label[to] = -1
        cut = np.ones(to.size + 1, bool)
        char = begins[to]
        cut[1:-1] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (char[1:] != char[:-1])
        edge = np.flatnonzero(cut)
        first, end = to[edge[:-1]], to[edge[1:] - 1] + 1
        new = ~known[end]
        lb, rb = first[new], end[new]
        known[rb] = True
        if not lb.size:
            break
    return order, np.cumsum(known[:n]) - 1


def earlier_windows(contents: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each content's windows, whether another content with a smaller document has the same LENGTH bytes."""
    lengths = np.array([len(c) for c in contents])
    begin = np.cumsum(lengths + 1) - lengths - 1
    buf = np.frombuffer(b"\0".join(contents) + bytes(_SORTED + 1), np.uint8)
    order, group = group_by_prefix(buf)
    owner = np.searchsorted(begin, np.arange(buf.size), side="right") - 1
    valid = np.arange(buf.size) + LENGTH <= (begin + lengths)[owner]
    doc = np.where(valid, least[owner], np.iinfo(np.int64).max)[order]
    smallest = np.minimum.reduceat(doc, np.flatnonzero(np.diff(group, prepend=-1)))[group]
    out = np.empty(buf.size, bool)
    out[order] = smallest < doc
    return [out[b : b + n - LENGTH + 1] for b, n in zip(begin.tolist(), lengths.tolist(), strict=True)]


CONTENTS = "shard long, batch long, lengths binary, hashes binary, docs binary, raw binary"
REPLIES = "batch long, kind int, shard long, bits binary, windows binary"


def _send(batch: int, contents: _Contents) -> pa.Table:
    lengths = np.array([len(r) for r in contents.raw], np.uint32)
    rows = [
        (shard, batch, lengths[own].tobytes(), contents.keys[own].astype(np.uint32).tobytes(), contents.least[own].tobytes(), b"".join([contents.raw[k] for k in own.tolist()]))
        for shard, own in contents.by_shard()
    ]
    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(CONTENTS.split(", "), columns, kinds, strict=True)})


def _shared(keys: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Places whose key another place has too, in parts of about SORT_BYTES that no key crosses."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    own = order[(np.concatenate([same, [False]]) | np.concatenate([[False], same]))[: order.size]]
    new = np.concatenate([[True], keys[own][1:] != keys[own][:-1]])[: own.size]
    before = np.cumsum(size[own]) - size[own]
    part = (before[new] // SORT_BYTES)[np.cumsum(new) - 1]
    return [x for x in np.split(own, np.flatnonzero(np.diff(part)) + 1) if x.size]


def settle(sent: DataFrame) -> DataFrame:
    """Answers to batches: a bit a content, whether it belongs to a smaller document of another batch; and for the others a bit a window."""

    def work(group: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        lengths, keys, docs = ([np.frombuffer(x, kind) for x in group.column(c).to_pylist()] for c, kind in (("lengths", np.uint32), ("hashes", np.uint32), ("docs", np.int64)))
        index: list[int] = []
        for own, raw in zip(lengths, group.column("raw").to_pylist(), strict=True):
            end = np.cumsum(own, dtype=np.int64)
            index += [place.setdefault(raw[a:b], len(place)) for a, b in zip((end - own).tolist(), end.tolist(), strict=True)]
        which, doc, size = np.array(index, np.int64), np.concatenate(docs), np.concatenate(lengths).astype(np.int64) - LENGTH + 1
        texts = list(place)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        later = doc > least[which]
        bounds = np.cumsum([0, *(x.size for x in lengths)])
        width = np.where(later, 0, size)
        begin = np.cumsum(width) - width
        windows = np.zeros(int(width.sum()), bool)
        seen: dict[int, np.ndarray] = {}
        for several in _shared(np.concatenate(keys)[np.unique(which, return_index=True)[1]], np.array([len(t) for t in texts])):
            seen |= zip(several.tolist(), earlier_windows([texts[k] for k in several.tolist()], least[several]), strict=True)
        if seen:
            for k in np.flatnonzero(~later & np.isin(which, list(seen))).tolist():
                windows[begin[k] : begin[k] + width[k]] = seen[int(which[k])]
        cut = np.append(begin, windows.size)
        n = group.num_rows
        return pa.table(
            {
                "batch": group.column("batch"),
                "kind": pa.array([2] * n, pa.int32()),
                "shard": group.column("shard"),
                "bits": pa.array([B.pack_bits(later[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                "windows": pa.array([B.pack_bits(windows[cut[a] : cut[b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            }
        )

    return sent.groupBy("shard").applyInArrow(work, REPLIES)


REMOVED = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _told(group: pa.Table) -> tuple[set[int], list[tuple[int, bytes, bytes]], dict[int, tuple[bytes, bytes]]]:
    """What a batch was told: documents that stand for their copies, which hashes occur again and often, how contents were settled."""
    stands, again, settled = set(), [], {}
    for kind, shard, bits, windows in zip(*(group.column(c).to_pylist() for c in ("kind", "shard", "bits", "windows")), strict=True):
        if kind == 0:
            stands.add(shard)
        elif kind == 1:
            again.append((shard, bits, windows))
        else:
            settled[shard] = bits, windows
    return stands, again, settled


def _covered(own: _Batch, contents: _Contents, settled: dict[int, tuple[bytes, bytes]]) -> list[list[tuple[int, int]]]:
    """Maximal runs of bytes that go, for each document that stands for its copies."""
    size = np.array([len(r) for r in contents.raw], np.int64) - LENGTH + 1
    later = np.zeros(size.size, bool)
    some: dict[int, np.ndarray] = {}
    for shard, at in contents.by_shard():
        bits, packed = settled[shard]
        later[at] = B.unpack_bits(bits, at.size)
        left = at[~later[at]]
        windows, end = B.unpack_bits(packed, int(size[left].sum())), np.cumsum(size[left])
        if windows.any():
            hit = np.add.reduceat(windows, end - size[left]) > 0
            some |= {int(k): windows[b - size[k] : b] for k, b in zip(left[hit], end[hit], strict=True)}
    whole = later[contents.which] | (contents.doc > contents.least[contents.which])
    doc, start, width = contents.text[whole], contents.start[whole], contents.width[whole]
    if some:
        parts = []
        for n in np.flatnonzero(~whole & np.isin(contents.which, list(some))).tolist():
            edge = np.flatnonzero(np.diff(some[int(contents.which[n])].astype(np.int8), prepend=0, append=0))
            parts += [(int(contents.text[n]), int(contents.start[n]) + a, b - a) for a, b in edge.reshape(-1, 2).tolist()]
        if parts:
            more = np.array(parts, np.int64)
            doc, start, width = np.concatenate([doc, more[:, 0]]), np.concatenate([start, more[:, 1]]), np.concatenate([width, more[:, 2]])
            order = np.lexsort((start, doc))
            doc, start, width = doc[order], start[order], width[order]
    out: list[list[tuple[int, int]]] = [[] for _ in own.own]
    if doc.size:  # ranges of windows don't overlap, so their ends rise with their starts
        end = start + width - 1 + LENGTH
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], doc.size) - 1
        for d, a, b in zip(doc[first].tolist(), start[first].tolist(), end[last].tolist(), strict=True):
            out[d].append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document."""
    every = id_and_text(docs, id_col, text_col)
    plain = every.where("doc_id is not null")
    _, n_bytes = B.size_of(plain)
    n_batches = B.batch_count(n_bytes)
    dealt = B.batched(plain, n_batches)
    stands = B.first_copies(plain, n_batches).withColumnsRenamed({"again": "bits", "often": "windows"})

    def ask(key, group: pa.Table, told: pa.Table) -> pa.Table:
        own = _Batch(group, _told(told)[0], n_batches)
        batch = key[0].as_py()
        return B.questions(batch, own.bounds, own.low, own.twice())

    def send(key, group: pa.Table, told: pa.Table) -> pa.Table:
        stands_, again, _ = _told(told)
        own = _Batch(group, stands_, n_batches)
        return _send(key[0].as_py(), own.contents(again))

    def remove(key, group: pa.Table, told: pa.Table) -> pa.Table:
        stands_, again, settled = _told(told)
        own = _Batch(group, stands_, n_batches)
        covered = _covered(own, own.contents(again), settled)
        first = {k: n for n, k in enumerate(own.own)}
        by_doc = {(own.ids[k], own.raw[k]): k for k in own.own}
        spans, kept = [], []
        for k, raw in enumerate(own.raw):
            stand = k if k in first else by_doc.get((own.ids[k], raw))
            if stand is not None:
                found = covered[first[stand]]
            else:
                found = [(0, len(raw))] if len(raw) >= LENGTH else []
            at, left = 0, []
            for a, b in found:
                left.append(raw[at:a])
                at = b
            spans.append([{"start": a, "end": b} for a, b in found])
            kept.append(b"".join([*left, raw[at:]]))
        return pa.table(
            {
                "doc_id": pa.array(own.ids, pa.int64()),
                "n_bytes": pa.array([len(r) for r in own.raw], pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    again = B.answers(B.with_told(dealt, stands).applyInArrow(ask, B.QUESTIONS)).select(
        "batch", F.lit(1).alias("kind"), "shard", F.col("again").alias("bits"), F.col("often").alias("windows")
    )
    told = stands.unionByName(again)
    settled = settle(B.with_told(dealt, told).applyInArrow(send, CONTENTS))
    nameless = every.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.encode("text", "UTF-8").alias("kept")
    )
    return B.with_told(dealt, told.unionByName(settled)).applyInArrow(remove, REMOVED).unionByName(nameless)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every whole document loses to earlier ones."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
