"""Small helpers that the operators of this package share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns over at once, so that its memory follows these and not the Arrow batch.
SLICE_ROWS = 500
#: Rows of an Arrow batch at most. Batches lie outside the heap, on both sides of the pipe, and texts can be very long.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS where it is higher."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path goes to Spark only, so any store that Spark reads will do."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that operators read, under fixed names; a null text is empty."""
    short_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def released() -> None:
    """Gives the memory that Arrow has freed back to the system: workers live on after a task, and an executor has one for each core."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow record batches cut into short slices. After the last one what Arrow has freed is given back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    released()


def bucket(col: Column, n: int, seed: int = 0) -> Column:
    """A bucket in [0, n) from a column's hash."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(n)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share.

    It is what the cluster names in spark.checkpoint.dir; a temporary one is made only where that is unset and all runs on one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="spanforge-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once and read back from the shared folder: later steps don't repeat it and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The frame, written once as Parquet to the shared folder and read back, so that later steps read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: At most this many keys of a join count as hot, so what is broadcast has this many rows at most.
HOT_KEYS = 2000
#: Words of 64 bits in a filter of keys: it never has more rows than this, whatever it is made from.
FILTER_WORDS = 1 << 18


def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _filter_bit(keys: list[str]) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit(41), *keys)
    return F.pmod(h, F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63).cast("long")).cast("int"))


def marked_by(df: DataFrame, held: DataFrame, keys: list[str], name: str = "_may") -> DataFrame:
    """The rows with a column that is true for all whose keys ``held`` has, and for some others: few while it has few million keys.

    The filter is broadcast; it has FILTER_WORDS rows at most.
    """
    word, bit = _filter_bit(keys)
    at, bits = fresh(df, "_word"), fresh(df, "_bits")
    words = held.select(word.alias(at), bit.alias("_bit")).groupBy(at).agg(F.bit_or("_bit").alias(bits))
    marked = df.withColumn(at, word).join(F.broadcast(words), at, "left")
    return marked.withColumn(name, F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))).drop(at, bits)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n_left: int, n_col: str = "n") -> DataFrame:
    """An inner join with rows unique by key; ``n_col`` of these says how often the key stands in ``left``, which has ``n_left`` rows.

    Keys of more than ``n_left / HOT_KEYS`` rows, which HOT_KEYS can be at most, are broadcast; the others are joined by a shuffle, where none is large
    and from which a filter of keys keeps most rows without a partner. ``left`` is read twice, so it should be a table or a light plan over one.
    """
    right = written(right)
    often = max(1000, n_left // HOT_KEYS)
    hot = right.where(F.col(n_col) > often)
    cold = right.where(F.col(n_col) <= often)
    return left.join(F.broadcast(hot), keys).unionByName(marked_by(left, cold, keys).where("_may").drop("_may").join(cold, keys)).drop(n_col)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; SPANFORGE_TOKENIZERS overrides the installed package's folder."""
    folder = os.environ.get("SPANFORGE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def with_texts(docs: DataFrame, work, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All columns of documents with new texts, and their length in characters where there is a column for it.

    ``work()`` is called once a task and gives a function from a slice's texts to as many new ones; a document goes where that is None. To it a null text is empty, and
    a document with a null text that stays keeps its text and its length as they were.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    short_batches(docs.sparkSession)

    def run(batches):
        rewrite = work()
        for batch in slices(batches):
            old = batch.column(text_col)
            made = pa.array(rewrite([t or "" for t in old.to_pylist()]), old.type)
            new = pc.if_else(old.is_valid(), made, old)
            columns = {c: batch.column(c) for c in batch.schema.names} | {text_col: new}
            if chars_col in columns:
                length = pc.utf8_length(new).cast(batch.schema.field(chars_col).type)
                columns[chars_col] = pc.if_else(old.is_valid(), length, batch.column(chars_col))
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema).filter(made.is_valid())

    return docs.mapInArrow(run, docs.schema)
