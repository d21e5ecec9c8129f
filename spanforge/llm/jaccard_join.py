"""Operator 6: n-gram Jaccard self-join, exact, as components of documents.

Two documents link when 100 * |A and B| >= 80 * |A or B| over their sets of distinct five-word shingles. Equal sets are one
class. For the others:

1. Batches ask shards how often each shingle occurs; shards answer with bits (more than once, often).
2. Linked sets share one of the first |A| - ceil(0.8 |A|) + 1 shingles in any fixed order. The order is by those bits and
   then by hash, so a set with a fifth of its shingles to itself needs no partner at all.
3. Sets that share such a shingle hang together. A group of up to BLOCK sets that hang together is worked on as one. In a larger one each set first meets
   some that share most shingles with it, which links most near copies; then only shingles whose sets are in several components are left, and
   their sets meet by shingle or all at once, whichever moves fewer of them. So sets move neither once a shingle in a group of near copies nor by the square of a
   group that long chains hold together. These groups are dealt to size-banded tiles. Sizes within a factor of 1.25 lie in the same or in
   neighbouring bands; bands of many sets are cut into blocks, so a tile is of bounded size however large a group is. In a tile hashed bitmaps bound the overlap of a pair from above by bit counts, and what passes is intersected
   exactly as sorted arrays. A tile gives a spanning forest of its links, not all of them.
4. The forests' components are the result.

Sets are of 64-bit hashes of shingles.

Edge cases: null, empty and blank texts have no shingles and are alone; fewer than five words count as one shingle; repeated rows
and copies are one class; two texts under one id are two documents, of which each has the component of its own links; a row with a null id
is linked with nothing and has no component; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from spanforge.llm import batches as B
from spanforge.llm.common import bucket, checkpointed, fresh, id_and_text, slices, table
from spanforge.llm.components import connected_components
from spanforge.llm.shingles import shingle_sets

PERCENT = 80
#: Sets that one block of a tile holds, and sets of small groups that are worked on together.
BLOCK = 1024
_SIZE_BAND = 1.25


def least_overlap(a: np.ndarray | int, b: np.ndarray | int):
    """Smallest intersection of sets of these sizes that links them: 100 i >= 80 (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    """How many shingles, taken in a fixed order, must hold one of any linked partner's: its overlap is at least 0.8 n."""
    return n - -(-PERCENT * n // 100) + 1


def _ask(sets: list[np.ndarray], n_shards: int):
    """Distinct shingles of a batch by shard, and which of them two of its sets hold."""
    every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    first = np.ones(every.size, bool)
    np.not_equal(every[1:], every[:-1], out=first[1:])
    at = np.flatnonzero(first)
    keys, twice = every[at], np.diff(np.append(at, every.size)) > 1
    order, bounds, low = B.by_shard(keys, n_shards)
    return keys, order, bounds, low, twice[order]


def _unlike(group: pa.Table, stands: set[int]) -> tuple[list[int], list[np.ndarray], list[bytes], list[np.ndarray]]:
    """(ids, sets, digests) of a batch, and the distinct sets of its first copies."""
    ids, texts = B.texts_of(group)
    sets = shingle_sets(texts)
    digests = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in sets]
    return ids, sets, digests, list({d: s for i, d, s in zip(ids, digests, sets, strict=True) if i in stands}.values())


def _told(told: pa.Table) -> tuple[set[int], list[tuple[int, bytes, bytes]]]:
    """First copies, and answers by shard."""
    rows = list(zip(*(told.column(c).to_pylist() for c in ("kind", "shard", "again", "often")), strict=True))
    return {s for kind, s, _, _ in rows if kind == 0}, [(s, a, o) for kind, s, a, o in rows if kind == 1]


def shingle_questions(dealt: DataFrame, stands: DataFrame, n_shards: int) -> DataFrame:
    def ask(key, group: pa.Table, told: pa.Table) -> pa.Table:
        _, _, bounds, low, twice = _ask(_unlike(group, _told(told)[0])[3], n_shards)
        return B.questions(key[0].as_py(), bounds, low, twice)

    return B.with_told(dealt, stands).applyInArrow(ask, B.QUESTIONS)


SETS = "doc_id long, n long, digest binary, prefix array<long>, shingles binary"


def document_sets(dealt: DataFrame, told: DataFrame, n_shards: int) -> DataFrame:
    """Every document's set size and digest; first copies that may have partners also with the shared part of the prefix and the set."""

    def work(key, group: pa.Table, told: pa.Table) -> pa.Table:
        stands, answered = _told(told)
        ids, sets, digests, unlike = _unlike(group, stands)
        keys, order, bounds, _, _ = _ask(unlike, n_shards)
        rank = np.zeros(keys.size, np.uint8)
        for shard, again, often in answered:
            own = order[bounds[shard] : bounds[shard + 1]]
            rank[own] = B.unpack_bits(again, own.size).astype(np.uint8) + B.unpack_bits(often, own.size)
        rows, posted = [], set()
        for doc, own, digest in zip(ids, sets, digests, strict=True):
            prefix, raw = None, None
            if own.size and doc in stands and digest not in posted:
                posted.add(digest)
                ranks = rank[np.searchsorted(keys, own)]
                alone = int(np.count_nonzero(ranks == 0))
                if alone < (length := prefix_length(own.size)):
                    taken = np.argsort(ranks, kind="stable")[alone:length]
                    prefix, raw = own[taken].view(np.int64).tolist(), own.tobytes()
            rows.append((doc, own.size, digest, prefix, raw))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(SETS.split(", "), columns, kinds, strict=True)})

    return B.with_told(dealt, told).applyInArrow(work, SETS)


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """Hashed signature of a set: one bit for each shingle's upper bits."""
    out = np.zeros(bits, bool)
    out[(own >> np.uint64(40)) & np.uint64(bits - 1)] = True
    return np.packbits(out).view(np.uint64)


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of the left block and sets of the right block (places in ``sets``).

    If both blocks are the same each pair is met once. A pair's overlap is at most half of what its sizes exceed the
    bits that differ, as a bit that differs is a shingle of one set only; pairs already joined need no look.
    """
    parent = list(range(len(sets)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    sizes = np.array([s.size for s in sets])
    bits = 1 << int(np.clip(int(4 * sizes.max()) - 1, 255, 65535)).bit_length()
    maps = {int(k): bitmap(sets[k], bits) for k in np.union1d(left, right)}
    same = left is right
    right = right[np.argsort(sizes[right], kind="stable")]
    right_maps, right_sizes = np.stack([maps[int(k)] for k in right]), sizes[right]
    place = {int(k): n for n, k in enumerate(right)}
    out = []
    for i in map(int, right if same else left):
        a = place[i] + 1 if same else int(np.searchsorted(right_sizes, -(-PERCENT * sizes[i] // 100)))
        b = int(np.searchsorted(right_sizes, 100 * sizes[i] // PERCENT, side="right"))
        if a >= b:
            continue
        differ = np.bitwise_count(right_maps[a:b] ^ maps[i]).sum(axis=1, dtype=np.int64)
        bound = (sizes[i] + right_sizes[a:b] - differ) // 2
        need = least_overlap(int(sizes[i]), right_sizes[a:b])
        may = np.flatnonzero(bound >= need)
        for k in may[np.argsort(differ[may], kind="stable")].tolist():
            j = int(right[a + k])
            if root(i) != root(j) and np.intersect1d(sets[i], sets[j], assume_unique=True).size >= need[k]:
                parent[root(i)] = root(j)
                out.append((i, j))
    return out


def tile_links(tiled: DataFrame) -> DataFrame:
    """(a, b) of the links that each tile keeps; rows are (tile, grp, side, doc_id, shingles)."""

    def work(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("doc_id").to_pylist(), np.int64)
        grp = np.array(group.column("grp").to_pylist(), np.int64)
        side = np.array(group.column("side").to_pylist(), np.int8)
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        found: list[tuple[int, int]] = []
        order = np.lexsort((ids, grp))
        for own in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
            if own.size > 1:
                members = [sets[k] for k in own]
                sides = side[own]
                every = np.arange(own.size)
                one, two = (every, every) if not sides.any() else (every[sides == 1], every[sides == 2])
                if one.size and two.size:
                    found += [(int(ids[own[i]]), int(ids[own[j]])) for i, j in links(members, one, two)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return tiled.groupBy("tile").applyInArrow(work, "a long, b long")


def over_block(groups: DataFrame) -> DataFrame:
    """(grp) of over BLOCK rows, of which there are at most a BLOCKth of the rows."""
    return groups.groupBy("grp").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > BLOCK).select("grp")


def into_tiles(groups: DataFrame, n_sets: int) -> DataFrame:
    """(doc_id, tile, grp, side): sets dealt by the group they hang together in, band of size and block; rows are (doc_id, grp, n).

    Groups of at most BLOCK sets share tiles of about BLOCK sets. Of larger groups each pair of blocks in the same or in neighbouring bands is a
    tile of its own. What is told about these few is broadcast, so sets don't move before they have a tile.
    """
    sets = groups.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(_SIZE_BAND))).cast("long"))
    by_band = sets.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("m"))
    by_group = by_band.groupBy("grp").agg(F.sum("m").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", "m"))).alias("in_band"))
    sized = sets.join(F.broadcast(by_group.where(F.col("all") > BLOCK)), "grp", "left")

    def tile(g: Column, x: Column, y: Column, z: Column) -> Column:
        return F.struct(g.alias("g"), x.cast("long").alias("x"), y.cast("long").alias("y"), z.cast("long").alias("z")).alias("tile")

    def blocks(band: Column) -> Column:
        return F.ceil(F.coalesce(F.element_at("in_band", band), F.lit(0)) / BLOCK).cast("int")

    def pairs(band: Column, make) -> Column:
        """One pair of blocks for each block of a band."""
        return F.when(blocks(band) > 0, F.transform(F.sequence(F.lit(0), blocks(band) - 1), make))

    small = sized.where("all is null").select(
        "doc_id", tile(F.lit(-1).cast("long"), bucket(F.col("grp"), max(64, n_sets // BLOCK), seed=23), F.lit(0), F.lit(0)), "grp", F.lit(0).alias("side")
    )
    band, own = F.col("band"), F.col("own")
    same = pairs(band, lambda s: F.struct((2 * band).alias("x"), F.least(own, s).alias("y"), F.greatest(own, s).alias("z"), F.when(s == own, 0).when(own < s, 1).otherwise(2).alias("side")))
    up = pairs(band + 1, lambda s: F.struct((2 * band + 1).alias("x"), own.alias("y"), s.alias("z"), F.lit(1).alias("side")))
    down = pairs(band - 1, lambda s: F.struct((2 * band - 1).alias("x"), s.alias("y"), own.alias("z"), F.lit(2).alias("side")))
    large = (
        sized.where("all is not null")
        .withColumn("own", F.pmod(F.xxhash64(F.lit(29), "doc_id"), blocks(band)).cast("int"))
        .select("doc_id", "grp", F.explode(F.flatten(F.filter(F.array(same, up, down), lambda t: t.isNotNull()))).alias("t"))
        .select("doc_id", tile(F.col("grp"), F.col("t.x"), F.col("t.y"), F.col("t.z")), "grp", F.col("t.side").alias("side"))
    )
    return small.unionByName(large)


def by_anchor(held: DataFrame) -> DataFrame:
    """(doc_id, grp, n): each set with others of the anchor it shares most shingles with, at most about BLOCK together; rows are (doc_id, a, shingle, n).

    ``a`` is the least set that holds the shingle. Each set has one row, and near copies of one text are mostly linked where they meet here.
    """
    most = held.repartition("doc_id").groupBy("doc_id", "n", "a").agg(F.count(F.lit(1)).alias("m")).groupBy("doc_id", "n").agg(F.max_by("a", F.struct("m", "a")).alias("anchor"))
    sized = most.join(most.groupBy("anchor").agg(F.ceil(2 * F.count(F.lit(1)) / BLOCK).alias("parts")), "anchor")
    return sized.select("doc_id", F.xxhash64("anchor", F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.col("parts"))).alias("grp"), "n")


def taken_apart(held: DataFrame) -> DataFrame:
    """(doc_id, grp, n): what is left to compare of large groups; rows are (doc_id, grp, shingle, n, component).

    A shingle whose sets are in one component is settled. Of a group's others either the sets meet by shingle, with a row for each shingle that a set
    shares, or all at once with a row for each set, whichever needs fewer rows in tiles. Linked sets of two components share a shingle, so they meet.
    """
    open_ = held.groupBy("shingle").agg(F.min("component").alias("one"), F.max("component").alias("other"), F.count(F.lit(1)).alias("m")).where("one <> other").select("shingle", "m")
    left = checkpointed(held.join(open_, "shingle"))
    in_tiles = lambda m: m * F.ceil(m / BLOCK)
    by_shingle = left.groupBy("grp").agg(F.sum(F.ceil(F.col("m") / BLOCK)).alias("apart"))
    at_once = left.select("grp", "doc_id").distinct().groupBy("grp").agg(in_tiles(F.count(F.lit(1))).alias("whole"))
    # groups are few, at most a BLOCKth of the sets
    rows = left.join(F.broadcast(by_shingle.join(at_once, "grp").select("grp", (F.col("whole") <= F.col("apart")).alias("_whole"))), "grp")
    whole = rows.where("_whole").select("doc_id", "grp", "n").distinct()
    return whole.unionByName(rows.where("not _whole").select("doc_id", F.col("shingle").alias("grp"), "n"))


def class_nodes(every: DataFrame) -> DataFrame:
    """(digest, rep, node): each distinct set, its smallest document, and a number of its own.

    That is the document's id but where one id is the smallest of several sets: the others get a hash.
    """
    classes = every.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    first = F.row_number().over(Window.partitionBy("rep").orderBy("digest")) == 1
    return classes.withColumn("node", F.when(first, F.col("rep")).otherwise(F.xxhash64("rep", "digest")))


def set_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles) of every text."""

    def size(batches):
        for batch in slices(batches):
            sizes = [s.size for s in shingle_sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "n_shingles"])

    return docs.mapInArrow(size, "doc_id long, n_shingles long")


def _components(plain: DataFrame) -> DataFrame:
    """(doc_id, n, digest, root, component) of every row: ``root`` is a component's own number, ``component`` its smallest id; digest and root are null where a text has no shingles."""
    _, n_bytes = B.size_of(plain)
    n_batches = B.batch_count(n_bytes)
    dealt, stands = B.batched(plain, n_batches), B.first_copies(plain, n_batches)
    answers = B.answers(shingle_questions(dealt, stands, n_batches)).withColumn("kind", F.lit(1))
    every = checkpointed(document_sets(dealt, stands.unionByName(answers), n_batches))
    classes = checkpointed(class_nodes(every))
    # sets stay where they are until tiles are known; prefixes, sizes and groups are all that moves before
    posting = every.where("prefix is not null").withColumnRenamed("doc_id", "rep")
    first = posting.select("rep", "digest", "n", "prefix").join(classes, ["rep", "digest"])
    posted = first.select("node", F.explode("prefix").alias("shingle"))
    least = posted.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("shingle", "a")
    shared = checkpointed(posted.join(least, "shingle"))
    hanging = connected_components(shared.select("a", F.col("node").alias("b"))).select("node", F.col("component").alias("grp"))
    groups = checkpointed(hanging.join(first.drop("prefix"), "node").withColumnRenamed("node", "doc_id"))
    sets, n_sets = posting.select("rep", "digest", "shingles"), groups.count()

    def linked(met: DataFrame) -> DataFrame:
        tiles = into_tiles(checkpointed(met), n_sets).join(groups.select("doc_id", "rep", "digest"), "doc_id")
        return tile_links(tiles.join(sets, ["rep", "digest"]).drop("rep", "digest"))

    met, large = groups.select("doc_id", "grp", "n"), checkpointed(over_block(groups))
    if large.isEmpty():
        found = linked(met)
    else:
        held = met.join(F.broadcast(large), "grp").join(shared.select(F.col("node").alias("doc_id"), "a", "shingle"), "doc_id")
        held = checkpointed(held)
        near = connected_components(linked(by_anchor(held)), forests=True)
        rest = held.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        found = linked(met.join(F.broadcast(large), "grp", "left_anti").unionByName(taken_apart(rest)))
        found = found.unionByName(near.select(F.col("node").alias("a"), F.col("component").alias("b")))
    joined = classes.join(connected_components(found, forests=True), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("rep").alias("least"))
    by_class = joined.join(smallest, "component").select("digest", F.col("component").alias("root"), F.col("least").alias("component"))
    return every.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(by_class, "digest", "left").select(
        "doc_id", "n", "digest", "root", F.coalesce("component", "doc_id").alias("component")
    )


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    plain = id_and_text(docs, id_col, text_col)
    found = _components(plain.where("doc_id is not null")).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return found.unionByName(set_sizes(plain.where("doc_id is null")).withColumn("component_id", F.lit(None).cast("long")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that are the smallest of their component.

    Of repeated rows, and of one id's texts in one component, one stays; other texts under that id are documents of their own. Rows with a null id stay.
    """
    digest, doc, own_set = (fresh(docs, n) for n in ("_digest", "_doc", "_set"))
    ours = _components(id_and_text(docs).where("doc_id is not null")).where("component = doc_id")
    kept = ours.groupBy("doc_id", "root").agg(F.min("digest").alias(own_set)).select(F.col("doc_id").alias(doc), own_set)

    def digests(batches):
        for batch in slices(batches):
            sets = shingle_sets([t or "" for t in batch.column("text").to_pylist()])
            own = pa.array([hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if s.size else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, digest])

    marked = docs.where("doc_id is not null").mapInArrow(digests, StructType([*docs.schema.fields, StructField(digest, BinaryType())]))
    same = (F.col("doc_id").cast("long") == F.col(doc)) & F.col(digest).eqNullSafe(F.col(own_set))
    one = marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", digest]).select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return near_duplicate_components(table(spark, sf_dir, "documents"))
