"""Operator 11: resampling towards a target distribution by importance weights of hashed words.

DuckDB works inside each task: SQL unnests words, windows make runs of 1 to ``longest`` of them, a registered function gives their zlib CRC, and counts
by bucket go to Parquet, for each document and once for all documents of a task. Spark merges the tasks' counts with those of the target's texts
into one gain a bucket, sums gains over the counts of each document, adds the Gumbel noise that its id gives, and ranks.

Scale: text is read once, in blocks that hold BLOCK_CHARS or one document. Counts that meet in a shuffle are one array of ``buckets`` numbers a task. The gains are one array
of ``buckets`` numbers, the only thing sent to all tasks. Scores are dealt out by range and each task sorts its own; the rank adds the sizes of
the ranges before, of which the driver sees one number a range.

Edge cases: a null text has no features; fewer features than ``least_features`` are never drawn; a null id is the empty text in the hash and comes first in
ties; repeated rows are documents of their own, ranked one after the other; extra columns are ignored; an empty table gives an empty result, an empty
target gains that depend on the source alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import id_and_text, shuffle_partitions, slices, table, written

#: Runs of ASCII digits, ASCII letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters of the query: longest run of words, buckets, least features of a drawn document, share drawn in percent, seed.
LONGEST, BUCKETS, LEAST_FEATURES, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Characters of text that DuckDB works on at once, unless one document has more.
BLOCK_CHARS = 4_000_000

SCHEMA = "row long, doc_id long, n_features long, buckets array<int>, counts array<long>, of_task boolean"
_ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("of_task", pa.bool_())]
)


def _runs(longest: int) -> str:
    """SQL for runs of 1 to ``longest`` words as (row, gram)."""
    parts = ["SELECT row, word AS gram FROM words"]
    for n in range(2, longest + 1):
        later = ", ".join(f"lead(word, {k}) OVER later" for k in range(1, n))
        parts.append(f"SELECT row, concat_ws(' ', word, {later}) FROM words WINDOW later AS (PARTITION BY row ORDER BY place) QUALIFY lead(word, {n - 1}) OVER later IS NOT NULL")
    return " UNION ALL ".join(parts)


def counting_sql(longest: int, buckets: int) -> str:
    """SQL over ``block`` (row, doc_id, text) for the bucket counts of its rows."""
    return f"""
    WITH lists AS (SELECT row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS list FROM block),
    words AS (SELECT row, unnest(list) AS word, unnest(range(len(list))) AS place FROM lists),
    counted AS (SELECT row, gram, count(*) AS n FROM ({_runs(longest)}) GROUP BY row, gram),
    hashed AS (SELECT gram, (crc(gram) % {buckets})::INTEGER AS bucket FROM (SELECT DISTINCT gram FROM counted)),
    summed AS (SELECT row, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (gram) GROUP BY row, bucket),
    listed AS (SELECT row, sum(n)::BIGINT AS n_features, list(bucket) AS buckets, list(n) AS counts FROM summed GROUP BY row)
    SELECT row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts, false AS of_task
    FROM block LEFT JOIN listed USING (row)"""


def _crcs(words: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.uint32())


def _blocks(batches):
    """Slices of batches whose texts have at most BLOCK_CHARS bytes together, or one row."""
    for batch in slices(batches, 1000):
        sizes = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset :][: batch.num_rows + 1])
        at, held = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if k > at and held + size > BLOCK_CHARS:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += size
        if batch.num_rows > at:
            yield batch.slice(at)


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bucket counts of every row, and a row with ``of_task`` for what each task has counted together; written as Parquet."""

    def work(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        con.create_function("crc", _crcs, ["VARCHAR"], "UINTEGER", type="arrow")
        sql, total, seen = counting_sql(longest, buckets), np.zeros(buckets, np.int64), 0
        for block in _blocks(batches):
            con.register("block", pa.table(block))
            out = con.sql(sql).to_arrow_table().cast(_ARROW).combine_chunks()
            con.unregister("block")
            np.add.at(total, out["buckets"].combine_chunks().flatten().to_numpy(), out["counts"].combine_chunks().flatten().to_numpy())
            seen += out.num_rows
            yield from out.to_batches()
        con.close()
        if seen:
            held = np.flatnonzero(total).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([total.sum()], pa.int64()), pa.array([held], pa.list_(pa.int32())), pa.array([total[held]], pa.list_(pa.int64())), pa.array([True])],
                schema=_ARROW,
            )

    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    return written(rows.mapInArrow(work, SCHEMA))


def _merged(counts: DataFrame, name: str) -> DataFrame:
    """(bucket, count) over all tasks."""
    return counts.where("of_task").select(F.inline(F.arrays_zip("buckets", "counts"))).groupBy(F.col("buckets").alias("bucket")).agg(F.sum("counts").alias(name))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for all buckets: thousandths of the log of how much likelier the target makes it, each count plus one."""
    of_source, of_target = _merged(source, "s"), _merged(target, "t")
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(of_source, "bucket", "left").join(of_target, "bucket", "left").fillna(0)
    every = both.agg(F.collect_list(F.struct("bucket", "s", "t")).alias("rows"), F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("row.s", "row.t", "all_s", "all_t"))
    gain = F.floor(1000 * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
    return every.select(F.explode("rows").alias("row"), "all_s", "all_t").select("row.bucket", gain.alias("gain"))


def noise(id_text: Column, seed: int = SEED) -> Column:
    """Thousandths of the Gumbel noise that a hash of seed and id gives."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_features: int = LEAST_FEATURES, percent: int = PERCENT, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for what is not drawn."""
    spark = docs.sparkSession
    counts = bucket_counts(docs, longest, buckets, id_col, text_col)
    wanted = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), longest, buckets)
    gains = bucket_gains(counts, wanted, buckets).agg(F.sort_array(F.collect_list(F.struct("bucket", "gain")))["gain"].alias("gains"))
    weighed = counts.where("not of_task").select("row", "doc_id", "n_features", "buckets", "counts", gains.scalar().alias("gains"))
    weight = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: n * F.get("gains", b)), F.lit(0).cast("long"), lambda a, x: a + x)
    scored = weighed.select("row", "doc_id", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed))
    able = F.col("n_features") >= least_features
    order = [F.desc(able), F.desc("score"), F.asc("doc_id"), F.asc("row")]
    dealt = scored.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    dealt = written(dealt.drop("row").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(dealt.where(able).groupBy(part.alias("part")).count().collect())  # one number for each range
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets.append((k, before))
        before += sizes[k]
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("place") + 1
    ranked = dealt.withColumn("part", part).withColumn("place", place).join(starts, "part", "left")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(able & (rank <= percent * before // 100), rank).alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight and score towards the texts of ``benchmark``, and the rank of the tenth that is drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))
),
rows AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
wanted AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM benchmark),
counted AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM rows) GROUP BY ALL),
targeted AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM wanted) GROUP BY ALL),
bytes AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), (2 * k + 1)::BIGINT, 2))::BIGINT) AS bytes
  FROM (SELECT word FROM counted UNION SELECT word FROM targeted)
),
hashed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM bytes, crc_table
),
source AS (SELECT bucket, sum(n) AS s FROM counted JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM targeted JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM source), 0)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM target), 0)::DOUBLE AS all_t),
gains AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + {BUCKETS}) / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain
  FROM range({BUCKETS}) r(b) LEFT JOIN source ON source.bucket = b LEFT JOIN target ON target.bucket = b, totals
),
weights AS (SELECT row, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM rows LEFT JOIN weights USING (row)
),
able AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, row) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_FEATURES})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (row)
"""
