"""Operator 3: packing documents into fixed-length token sequences.

Every document is tokenised, ends with a separator id and is cut at multiples of the sequence length. The pieces of a
random group of documents are packed by first-fit decreasing; a tournament tree over the bins' free room finds the first
bin that a piece fits in O(log bins). Groups hold about GROUP_DOCS documents whatever the input's size, so more data means
more groups and not larger ones, and only the last bins of a group are left partly empty.

Edge cases: a null or empty text is its separator alone; a null id is an id like others; repeated rows are packed as often as they occur; pieces of equal
length are taken in the order of document and start; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.bytechars import byte_of_char, token_bytes
from spanforge.llm.common import bucket, id_and_text, slices, table, tokenizer_path

SEQUENCE_TOKENS = 2048
SEPARATOR_ID = 1
GROUP_DOCS = 4096
WORD_ENTRIES = 150_000
#: Pre-tokens that a worker remembers: some 200 bytes each.
PIECE_ENTRIES = 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"

#: Characters of plain Latin script, and what stands between words of it.
_PLAIN = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250)]))
_BLANKS = "\t\n\v\f\r "


def _pattern() -> str:
    """The pre-token pattern that the vocabulary file states, 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+, for lower-cased plain Latin script."""
    kinds = {c: unicodedata.category(c)[0] for c in unicodedata.normalize("NFC", _PLAIN).lower()}
    letters, digits = ("".join(re.escape(c) for c in sorted(kinds) if kinds[c] == kind) for kind in "LN")
    return rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+"


class PieceTokens(dict):
    """Little-endian ids by pre-token; a word's end is byte 0xFF, which UTF-8 text never has."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECE_ENTRIES:
            self.clear()
        ids = self.merge(piece.encode() + b"\xff")
        out = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class WordTokens(dict):
    """Little-endian ids by white-space-separated chunk; the pre-token pattern never joins two chunks.

    Plain Latin script is cut by the vocabulary's pattern and merged by rank, a whole text at once where nothing else is in it. All other
    chunks, and texts with separators that only Python takes for white space, go to the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, end = byte_of_char(), spec["model"]["end_of_word_suffix"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith(end)
                ranks[token_bytes(token[: -len(end)] if ends else token, chars) + b"\xff" * ends] = i
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.pieces = PieceTokens(core._core_bpe.encode_single_piece)
        self.cut = re.compile(_pattern()).findall
        self.ascii = "".join(c for c in _BLANKS + _PLAIN if c.isascii()).encode()
        self.plain = re.compile(f"[{re.escape(_BLANKS + _PLAIN)}]*").fullmatch
        self.odd_space = "\x1c\x1d\x1e\x1f\x85"
        self.markers = [t for t in special if not t.isspace()]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= WORD_ENTRIES:
            self.clear()
        ids = self._plain_ids(chunk)
        if ids is None:
            ids = self._library_ids(chunk)
        self[chunk] = ids
        return ids

    def _plain_ids(self, text: str) -> bytes | None:
        """The ids of plain Latin script without markers; None for other texts."""
        if any(m in text for m in self.markers):
            return None
        if text.isascii():
            if text.encode().translate(None, self.ascii):
                return None
        elif self.plain(text):
            text = unicodedata.normalize("NFC", text)
        else:
            return None
        return b"".join(map(self.pieces.__getitem__, self.cut(text.lower())))

    def _library_ids(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        ids = self._plain_ids(text)
        if ids is not None:
            return ids
        if any(c in text for c in self.odd_space):
            return self._library_ids(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for each worker: loading it takes longer than a short task."""
    return WordTokens(path)


class FirstFit:
    """Bins in the order they are opened; a winner tree over their free room names the first that holds a given length."""

    def __init__(self, most_bins: int, room: int):
        self.leaves = 1
        while self.leaves < most_bins:
            self.leaves *= 2
        self.room = room
        self.tree = [room] * (2 * self.leaves)

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        free = tree[node]
        tree[node] = free - length
        at = node - self.leaves
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
        return at, self.room - free


def cut_documents(docs: DataFrame, path: str, tokens: int = SEQUENCE_TOKENS, separator: int = SEPARATOR_ID) -> DataFrame:
    """Pieces of at most ``tokens`` ids of every document, each with a checksum of its ids. A narrow map."""

    def cut(batches):
        coder, last = word_tokens(path), struct.pack("<I", separator)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = coder.encode(text) + last
                whole = len(ids) // 4
                for at in range(0, len(ids), 4 * tokens):
                    piece = ids[at : at + 4 * tokens]
                    rows.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), whole))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5,
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.mapInArrow(cut, PIECES)


def pack_pieces(pieces: DataFrame, n_groups: int, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Packs the pieces of each random group of documents by first-fit decreasing; one shuffle of a few numbers a piece."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        fit = FirstFit(group.num_rows, tokens)
        places = [fit.put(n) for n in group.column("length").to_pylist()]
        first = group.column("bin_group")[0].as_py() << 32
        return group.drop_columns(["bin_group"]).append_column(
            "sequence_id", pa.array([first + b for b, _ in places], pa.int64())
        ).append_column("offset", pa.array([o for _, o in places], pa.int64()))

    grouped = pieces.withColumn("bin_group", bucket(F.col("doc_id"), n_groups, seed=3))
    return grouped.groupBy("bin_group").applyInArrow(pack, PACKED)


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    tokens: int = SEQUENCE_TOKENS,
    group_docs: int = GROUP_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's pieces with the sequence and the offset they were given."""
    n_groups = max(1, -(-docs.count() // group_docs))
    pieces = cut_documents(id_and_text(docs, id_col, text_col), path or tokenizer_path("word_bpe_49k.json"), tokens)
    return pack_pieces(pieces, n_groups, tokens)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
