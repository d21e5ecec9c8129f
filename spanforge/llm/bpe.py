"""Operator 10: byte-pair encoding by dynamic programming over prefixes, and its decoding.

For each prefix of a pre-token exactly one vocabulary token can be the last one of the prefix's own encoding. It is
found from left to right: an automaton over the vocabulary names every token that ends at the prefix's end (its suffix
links walk from the longest to the shortest), and a candidate is the answer when it starts the text or is compatible
with the last token of the prefix before it. Two tokens are compatible when merging their joined bytes gives back just
these two. Following the stored tokens from the end gives the ids. Work is linear in the text times the few tokens that
end at one place, whatever the length of the pre-token.

Edge cases: a null text counts as empty and gives no ids; extra columns of the input are ignored; repeated rows give
repeated results; a text of any length is encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.bytechars import byte_of_char, token_bytes
from spanforge.llm.common import id_and_text, slices, table, tokenizer_path

#: Unicode white space, and the published pre-token pattern of this vocabulary, which uses it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Words, pre-tokens and tested pairs that a worker remembers; what is full starts anew.
WORD_ENTRIES, PIECE_ENTRIES, PAIR_ENTRIES = 600_000, 100_000, 400_000

SCHEMA = "doc_id long, n_tokens long, ids binary, text string"


class PrefixEncoder:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = byte_of_char(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        own = {i: token_bytes(t, chars) for t, i in vocab.items() if t not in self.special}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole, pair = vocab[left + right], (vocab[left], vocab[right])
            if whole != 256 + rank:
                raise ValueError("ids must follow the order of merges")
            self.parts[whole] = pair
            self.merged[pair] = whole
        self.vocab_end = max(own) + 1
        self.automaton = ahocorasick.Automaton()
        for i, b in own.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.raw_of = [own.get(i, b"") for i in range(self.vocab_end + len(self.special))]
        for text, i in self.special.items():
            self.raw_of[i] = text.encode()
        self.tested: dict[int, bool] = {}
        self.pattern = regex.compile(_PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = _Memo(self._piece, PIECE_ENTRIES)
        self.spaced = _Memo(lambda word: self._unit(" " + word), WORD_ENTRIES)
        self.bare = _Memo(self._unit, PIECE_ENTRIES)
        self.newline = self._unit("\n")

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b before both are whole.

        Walks back in time over the parts of a that touch b and the parts of b that touch a. Two of them stand side
        by side until the first of them goes into its own parent; their merge happens if it ranks before that. At equal
        rank the merge further left comes first.
        """
        end = self.vocab_end
        x, y, x_until, y_until = a, b, end, end
        while True:
            whole = self.merged.get((x, y))
            if whole is not None and whole < x_until and whole <= y_until:
                return False
            if (x > y and x in self.parts) or y not in self.parts:
                if x not in self.parts:
                    return True
                x_until, x = x, self.parts[x][1]
            else:
                y_until, y = y, self.parts[y][0]

    def _test(self, pair: int) -> bool:
        if len(self.tested) >= PAIR_ENTRIES:
            self.tested.clear()
        fits = self.tested[pair] = self.compatible(pair >> 32, pair & 0xFFFFFFFF)
        return fits

    def ids_of_piece(self, raw: bytes) -> list[int]:
        """The ids of one pre-token. A token that starts it needs no test: each one is its own bytes' encoding."""
        last, known, done = [0] * (len(raw) + 1), self.tested, -1
        for end, (length, token) in self.automaton.iter(raw.decode("latin-1")):
            if end == done:
                continue
            start = end + 1 - length
            if start:
                pair = last[start] << 32 | token
                fits = known.get(pair)
                if fits is None:
                    fits = self._test(pair)
                if not fits:
                    continue
            last[end + 1] = token
            done = end
        out, end = [], len(raw)
        while end:
            out.append(last[end])
            end -= len(self.raw_of[last[end]])
        return out[::-1]

    def _piece(self, piece: str) -> bytes:
        ids = self.ids_of_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        """A word with the space before it, or the like; its parts are looked up under the keys that words use."""
        pieces = self.pattern.findall(unit)
        if len(pieces) == 1:
            return self._piece(unit)
        return b"".join([self.spaced[p[1:]] if p[0] == " " else self.pieces[p] for p in pieces])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.split_special is not None and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if " ".join(text.split()) != text.replace("\n", " "):
            return b"".join([self.pieces[p] for p in self.pattern.findall(text)])
        # every white-space character is a blank or newline between two words, so a word with the space before it is cut as in the whole text
        spaced, bare, out = self.spaced.__getitem__, self.bare, []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.newline)
            head, *words = line.split(" ")
            if head:
                out.append(bare[head])
            out.extend(map(spaced, words))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        raw = b"".join(map(self.raw_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.decode("utf-8", "replace")


class _Memo(dict):
    """Values by key, made when first asked for; it starts anew when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder for each vocabulary and worker process."""
    return PrefixEncoder(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit) and the text decoded from them.

    A narrow map: no shuffle, and a worker holds one slice of rows and bounded word memos.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def encode(batches):
        coder = encoder(path)
        for batch in slices(batches):
            ids = [coder.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([coder.decode(x) for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "text"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(encode, SCHEMA)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every whole document, as digests."""
    return encode_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
