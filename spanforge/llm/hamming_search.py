"""Operator 2: exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has one bit a dimension, its sign. Codes are cut into SEGMENTS parts and indexed by each of them. A query
looks up, part by part, all values at radius 0, then 1, then 2 and so on, and verifies the whole codes found there. After radius r
every code within SEGMENTS * (r + 1) - 1 of the query has been met, so a query ends as soon as its k-th verified distance is
within that; the others go on. The last radius is the width of a part, which covers every code.

Equal codes are one entry with its k + 1 smallest ids, which is all that a top-k by (distance, id) can need, so a vector that a
third of all rows share is one entry. Rounds are checkpointed; what a round keeps is k rows a query.

Edge cases: null vectors and null ids are left out; null elements are no sign (bit 0); vectors of over BITS dimensions are an error; repeated ids count once; the query itself is no
result; ties go to the smaller id; fewer than k other rows give fewer results; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import checkpointed, table

K = 10
QUERY_EVERY = 50
BITS, SEGMENTS = 64, 4
_WIDTH = BITS // SEGMENTS


def sign_code(vector: Column) -> Column:
    """64 bits: bit i is set where element i is at least 0. A shorter vector's other bits are 0; a longer one is an error, as none of it may be left out."""
    bit = lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = F.aggregate(F.transform(vector, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a vector has more than {BITS} dimensions")).cast("long")).otherwise(code)


def _part(code: Column, n: int) -> Column:
    return F.shiftrightunsigned(code, n * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1).cast("long"))


def index_codes(vectors: DataFrame, k: int) -> DataFrame:
    """(part, value, code, ids): every distinct code under each of its parts, with its k + 1 smallest ids."""
    salted = vectors.dropDuplicates(["vec_id", "code"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("code", "salt").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    least = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    codes = least.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    parts = F.array(*(F.struct(F.lit(n).alias("part"), _part(F.col("code"), n).alias("value")) for n in range(SEGMENTS)))
    return codes.select("code", "ids", F.explode(parts).alias("p")).select("p.part", "p.value", "code", "ids")


def probes(queries: DataFrame, radius: int) -> DataFrame:
    """(query_id, code, part, value) of all part values at exactly this distance from the query's own."""

    def make(batches):
        masks = np.array([sum(1 << b for b in c) for c in combinations(range(_WIDTH), radius)], np.int64)
        part = np.repeat(np.arange(SEGMENTS), masks.size)
        for batch in batches:
            for q, code in zip(batch.column("query_id").to_pylist(), batch.column("query_code").to_pylist(), strict=True):
                own = (code & ((1 << BITS) - 1) if code < 0 else code)
                value = np.concatenate([((own >> n * _WIDTH) & ((1 << _WIDTH) - 1)) ^ masks for n in range(SEGMENTS)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(value.size, q)), pa.array(np.full(value.size, code)), pa.array(part, pa.int32()), pa.array(value, pa.int64())],
                    names=["query_id", "query_code", "part", "value"],
                )

    return queries.mapInArrow(make, "query_id long, query_code long, part int, value long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance) of each query's k nearest other rows."""
    coded = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), sign_code(F.col(vector_col)).alias("code"), is_query.alias("asks")
    )
    rows = coded.groupBy("vec_id").agg(F.min("code").alias("code"), F.max("asks").alias("asks"))
    index = checkpointed(index_codes(rows, k))
    active = checkpointed(rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("code").alias("query_code")))
    best_first = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    spark = vectors.sparkSession
    kept = spark.createDataFrame([], "query_id long, query_code long, vec_id long, distance int")
    done: list[DataFrame] = []
    for radius in range(_WIDTH + 1):
        met = (
            probes(active, radius)
            .join(index, ["part", "value"])
            .select("query_id", "query_code", "code", "ids")
            .dropDuplicates(["query_id", "code"])
            .withColumn("distance", F.bit_count(F.col("code").bitwiseXOR(F.col("query_code"))))
            .select("query_id", "query_code", F.explode("ids").alias("vec_id"), "distance")
            .where("vec_id <> query_id")
        )
        ranked = kept.unionByName(met).dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        held = checkpointed(ranked)
        covered = SEGMENTS * (radius + 1) - 1
        ended = held.groupBy("query_id").agg(F.max("rank").alias("n"), F.max("distance").alias("far")).where(F.lit(radius == _WIDTH) | ((F.col("n") == k) & (F.col("far") <= covered))).select("query_id")
        done.append(held.join(ended, "query_id", "left_semi").select("query_id", "rank", "vec_id", "distance"))
        if radius == _WIDTH:
            break
        active = checkpointed(active.join(ended, "query_id", "left_anti"))
        if active.isEmpty():
            break
        kept = held.join(ended, "query_id", "left_anti").drop("rank")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("distance").cast("long").alias("distance"))


def op2_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every fiftieth vector among all vectors."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = """
with bits as (
  select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings where vec_id is not null
),
pairs as (
  select q.vec_id as query_id, o.vec_id as vec_id, cast(sum(case when (q.x >= 0) <> (o.x >= 0) then 1 else 0 end) as bigint) as distance
  from bits q join bits o on q.i = o.i and q.vec_id <> o.vec_id
  where q.vec_id % 50 = 0 group by 1, 2
)
select query_id, row_number() over (partition by query_id order by distance, vec_id) as rank, vec_id, distance
from pairs qualify rank <= 10
"""
