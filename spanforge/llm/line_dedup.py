"""Operator 8: substring dedup by hashing lines and moving paragraphs.

There are two kinds of units. A line with a word in it is normalised (case, white space) and known by the digest of that. A moving
paragraph is any LEAST_RUN words in a row (case and what stands between words don't count), so passages are met that begin and
end within lines or run over short ones (``passages``). Of all units with one digest the earliest stays and the others go: of
lines by (doc_id, position), of paragraphs those of the smallest doc_id. Lines under ``least_words`` words, if that is set above 1, and lines without
a word go within a repeated paragraph only. Units are judged on the given text; offsets are those of the original text, in code points.

Only digests and places are shuffled to find the earliest units, and each task adds up its own minimum first, so a unit that a third of all
documents hold costs one row a task. The way back to the occurrences is a join in which the hot digests, of which there can be
few, are broadcast. Copies of a whole text are settled by the text's own digest.

Edge cases: rows are told apart by id and text, so two texts under one id don't touch each other and repeated rows have equal results; null and
empty texts lose nothing; a row with a null id neither loses nor causes anything; a paragraph repeated within one document
only stays; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import fresh, id_and_text, join_hot, marked_by, slices, table, written
from spanforge.llm.passages import LEAST_RUN, WORD, Codes, Windows, merged, ranges_of_words, without

LEAST_WORDS = 1

_BLANKS = re.compile(r"\s+", re.ASCII)
_LINE, _KEY, _WINDOWS, _COPY = range(4)


def normalised(unit: str) -> str:
    return _BLANKS.sub(" ", unit.lower()).strip(" ")


UNITS = "kind int, a long, b long, doc_id long, tag long, at int, size int"


def units(rows: DataFrame, least_words: int) -> DataFrame:
    """Lines as (digest in a and b, at: number of the line, size: length with the line end) and keys of windows as (key in a)."""

    def cut(batches):
        codes = Codes()
        for batch in slices(batches):
            lines, keys = [], [(np.zeros(0, np.int64),) * 3]
            for doc, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
                words = []
                for n, line in enumerate(text.split("\n")):
                    own = WORD.findall(line)
                    words += own
                    if len(own) >= least_words:
                        digest = hashlib.md5(normalised(line).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                        lines.append((digest, doc, tag, n, len(line)))
                if (windows := Windows(words, codes)).size:
                    own_keys = np.unique(windows.keys)
                    keys.append((own_keys, np.full(own_keys.size, doc, np.int64), np.full(own_keys.size, tag, np.int64)))
            key, doc, tag = (np.concatenate(c) for c in zip(*keys, strict=True))
            digests = np.frombuffer(b"".join([x[0] for x in lines]), np.int64).reshape(-1, 2)
            n, m = len(lines), key.size
            none = np.zeros(m, np.int32)
            columns = [
                np.concatenate([np.full(n, _LINE, np.int32), np.full(m, _KEY, np.int32)]), np.concatenate([digests[:, 0], key]), np.concatenate([digests[:, 1], none.astype(np.int64)]),
                np.concatenate([np.array([x[1] for x in lines], np.int64), doc]), np.concatenate([np.array([x[2] for x in lines], np.int64), tag]),
                *(np.concatenate([np.array([x[k] for x in lines], np.int32), none]) for k in (3, 4)),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in UNITS.split(", ")])

    return rows.mapInArrow(cut, UNITS)


def repeated_lines(lines: DataFrame, n_rows: int) -> DataFrame:
    """(doc_id, tag, at) of the lines that go."""
    place = F.struct("doc_id", "tag", "at")
    first = lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_hot(lines.select("a", "b", "doc_id", "tag", "at"), first, ["a", "b"], n_rows).where(place != F.col("first")).select("doc_id", "tag", "at")


SEGMENTS = "key long, digest long, doc_id long, tag long, at int, size int, hashes binary"


def shared_segments(texts: DataFrame) -> DataFrame:
    """Segments of windows whose keys are asked for, with a digest of their windows; rows are (doc_id, tag, text, keys)."""

    def cut(batches):
        codes = Codes()
        for batch in slices(batches):
            rows = []
            for doc, tag, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "keys")), strict=True):
                windows = Windows(WORD.findall(text), codes)
                start, end = windows.segments()
                hashes, key = windows.hashes(), windows.keys[start]
                for k in np.flatnonzero(np.isin(key, np.array(asked, np.int64))).tolist():
                    raw = hashes[start[k] : end[k]].tobytes()
                    digest = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                    rows.append((int(key[k]), digest, doc, tag, int(start[k]), int(end[k] - start[k]), raw))
            kinds = (*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    return texts.mapInArrow(cut, SEGMENTS)


def single_windows(segments: DataFrame) -> DataFrame:
    """(key, hash, doc_id, tag, at) of every window of the segments."""

    def cut(batches):
        for batch in slices(batches):
            size = batch.column("size").to_numpy()
            every = np.repeat(np.arange(size.size), size)
            inner = np.arange(every.size) - np.repeat(np.cumsum(size) - size, size)
            hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64)
            key, doc, tag, at = (batch.column(c).to_numpy()[every] for c in ("key", "doc_id", "tag", "at"))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, hashes, doc, tag, (at + inner).astype(np.int32))], names=["key", "hash", "doc_id", "tag", "at"])

    return segments.mapInArrow(cut, "key long, hash long, doc_id long, tag long, at int")


def repeated_windows(rows: DataFrame, keys: DataFrame, n_rows: int, stands: DataFrame) -> DataFrame:
    """(doc_id, tag, at, size): runs of windows that a document with a smaller id holds, in the texts that stand for their copies."""
    shared = keys.groupBy("key").agg(F.min("tag").alias("one"), F.max("tag").alias("other"), F.count(F.lit(1)).alias("n")).where("one <> other").select("key", "n")
    asked = written(join_hot(keys, shared, ["key"], n_rows).groupBy("doc_id", "tag").agg(F.collect_set("key").alias("keys")).join(stands, ["doc_id", "tag"], "left_semi"))
    texts = marked_by(rows, asked, ["doc_id", "tag"]).where("_may").drop("_may")
    segments = written(shared_segments(texts.join(asked, ["doc_id", "tag"])))
    n_segments = segments.count()
    contents = written(segments.groupBy("key", "digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    whole = join_hot(segments.drop("hashes"), contents.where("n > 1"), ["key", "digest"], n_segments).where("doc_id > least").select("doc_id", "tag", "at", "size")
    apart = contents.groupBy("key").agg(F.min("least").alias("one"), F.max("least").alias("other"), F.count(F.lit(1)).alias("n")).where("one <> other").select("key", "n")
    several = join_hot(contents.select("key", "digest", F.col("least").alias("doc_id")), apart, ["key"], n_segments)
    windows = written(single_windows(segments.join(several, ["key", "digest", "doc_id"])))
    first = windows.groupBy("key", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last")
    single = join_hot(windows, first, ["key", "hash"], windows.count()).where("doc_id > first").select("doc_id", "tag", "at", F.lit(1).alias("size"))
    return whole.unionByName(single)


_PLACES = "array<struct<kind:int,at:int,size:int>>"


def repeated_units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, tag, places): what goes, by kind, for each text that loses something; rows are (doc_id, text).

    A place of kind _COPY says that a text is not the first of its copies, so it loses all windows.
    """
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tag"), "text")
    own = rows.select("doc_id", "tag", F.md5("text").alias("same"))
    stands = written(own.groupBy("same").agg(F.min(F.struct("doc_id", "tag")).alias("s")).select("s.doc_id", "s.tag"))
    every = written(units(rows, least_words))
    n_rows = every.count()
    lines = repeated_lines(every.where(F.col("kind") == _LINE).dropDuplicates(["doc_id", "tag", "at"]), n_rows)
    windows = repeated_windows(rows, every.where(F.col("kind") == _KEY).select(F.col("a").alias("key"), "doc_id", "tag"), n_rows, stands)
    place = lambda kind, at, size: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), size.cast("int").alias("size")).alias("place")
    gone = lines.select("doc_id", "tag", place(_LINE, F.col("at"), F.lit(0)))
    gone = gone.unionByName(windows.select("doc_id", "tag", place(_WINDOWS, F.col("at"), F.col("size"))))
    gone = gone.unionByName(own.join(stands, ["doc_id", "tag"], "left_anti").select("doc_id", "tag", place(_COPY, F.lit(0), F.lit(0))))
    return written(gone.groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places")))


def spans_of(text: str, places: list[dict]) -> list[tuple[int, int]]:
    """(start, end) in code points of what goes, in order and apart."""
    lines = {p["at"] for p in places if p["kind"] == _LINE}
    windows = [(p["at"], p["size"]) for p in places if p["kind"] == _WINDOWS]
    copy = any(p["kind"] == _COPY for p in places)
    spans = []
    if copy or windows:
        words = [m.span() for m in WORD.finditer(text)]
        if copy:
            windows = [(0, len(words) - LEAST_RUN + 1)] if len(words) >= LEAST_RUN else []
        spans = ranges_of_words(words, windows)
    if lines:
        start = 0
        for n, line in enumerate(text.split("\n")):
            end = start + len(line) + 1
            if n in lines:
                spans.append((start, min(end, len(text))))
            start = end
    return merged(spans)


def _marked(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> tuple[DataFrame, str]:
    """The documents, all columns, and with them the places of repeated units, null where there are none, in a column of its own; and that column's name.

    Most documents lose nothing, and a filter lets these pass without a shuffle.
    """
    doc, tag, places, may = (fresh(docs, n) for n in ("_doc", "_tag", "_places", "_may"))
    given = docs.withColumns({doc: F.col(id_col).cast("long"), tag: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    gone = repeated_units(id_and_text(docs, id_col, text_col), least_words).select(F.col("doc_id").alias(doc), F.col("tag").alias(tag), F.col("places").alias(places))
    given = marked_by(given, gone, [doc, tag], may)
    touched = given.where(F.col(may)).join(gone, [doc, tag], "left").select(*docs.columns, places)
    return touched.unionByName(given.where(~F.col(may)).select(*docs.columns, F.lit(None).cast(_PLACES).alias(places))), places


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, kept, removed): the given text, what is left of it, and what went with original offsets."""
    plain = id_and_text(docs, id_col, text_col)

    def cut(batches):
        for batch in slices(batches):
            texts, places = batch.column("text").to_pylist(), batch.column("_places").to_pylist()
            spans = [[] if p is None else spans_of(t, p) for t, p in zip(texts, places, strict=True)]
            kept = [without(t, s) for t, s in zip(texts, spans, strict=True)]
            removed = pa.array([[{"start": a, "length": b - a} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(kept, pa.string()), removed], names=["doc_id", "text", "kept", "removed"])

    return _marked(plain, "doc_id", "text", least_words)[0].mapInArrow(cut, "doc_id long, text string, kept string, removed array<struct<start:bigint,length:bigint>>")


def without_repeated_units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents, all columns, without the units that earlier ones hold; the documents stay, and a null text stays null."""
    marked, places = _marked(docs, "doc_id", "text", least_words)

    def cut(batches):
        for batch in slices(batches):
            texts = [t if t is None or p is None else without(t, spans_of(t, p)) for t, p in zip(batch.column("text").to_pylist(), batch.column(places).to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns([places])

    cleaned = marked.mapInArrow(cut, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every whole document keeps once each repeated unit is left to its earliest place."""
    return dedup_units(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"),
        F.array_join(F.transform("removed", lambda r: F.concat(r.start, F.lit(":"), r.start + r.length)), ",").alias("spans"),
    )


#: Words are those of scripts with blanks, as in the given tables. Ids are unique there.
ORACLE = """
with docs as (select cast(doc_id as bigint) as doc_id, coalesce(text, '') as text from documents),
lines as (
  select doc_id, pos, line, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) as plain, len(regexp_extract_all(line, '[\\p{L}\\p{N}_]+')) >= 1 as counts,
         coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as start,
         count(*) over (partition by doc_id) = pos as ends
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from docs)
),
gone_lines as (
  select doc_id, start as s, start + length(line) + case when ends then 0 else 1 end as e
  from (select *, row_number() over (partition by md5(plain) order by doc_id, pos) > 1 as gone from lines where counts) where gone
),
parts as (select doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') as w, string_split_regex(text, '[\\p{L}\\p{N}_]+') as between_words from docs),
words as (
  select doc_id, pos, lower(word) as word, length(word) as n,
         sum(length(gap)) over own + sum(length(word)) over own - length(word) as start
  from (select doc_id, unnest(w) as word, unnest(between_words[:len(w)]) as gap, generate_subscripts(w, 1) as pos from parts where len(w) > 0)
  window own as (partition by doc_id order by pos rows between unbounded preceding and current row)
),
windows as (
  select doc_id, pos, start, n, case when count(*) over frame = 50 then md5(string_agg(word, ' ') over frame) end as digest
  from words window frame as (partition by doc_id order by pos rows between current row and 49 following)
),
judged as (select *, digest is not null and min(doc_id) over (partition by digest) < doc_id as gone from windows),
covered as (select *, bool_or(gone) over (partition by doc_id order by pos rows between 49 preceding and current row) as gone_word from judged),
gone_words as (
  select doc_id, min(start) as s, max(start + n) as e
  from (select *, pos - row_number() over (partition by doc_id order by pos) as island from covered where gone_word) group by doc_id, island
),
spans as (select * from gone_lines where e > s union all select * from gone_words),
merged as (
  select doc_id, min(s) as s, max(e) as e
  from (select *, sum(case when s <= reach then 0 else 1 end) over (partition by doc_id order by s, e) as island
        from (select *, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) as reach from spans))
  group by doc_id, island
),
cuts as (
  select doc_id, string_agg(cast(s as bigint) || ':' || cast(e as bigint), ',' order by s) as spans, count(*) as n_spans,
         string_agg(substring(text, cast(before as bigint) + 1, cast(s - before as bigint)), '' order by s) || substring(any_value(text), cast(max(e) as bigint) + 1) as kept
  from (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as before from merged join docs using (doc_id)) group by doc_id
)
select doc_id,
       cast(octet_length(encode(text)) as bigint) as n_bytes,
       cast(octet_length(encode(text)) - octet_length(encode(coalesce(kept, text))) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(coalesce(kept, text)) as kept_sha256,
       coalesce(spans, '') as spans
from docs left join cuts using (doc_id)
"""
