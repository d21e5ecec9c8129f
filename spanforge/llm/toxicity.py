"""Operator 4: toxicity scores on text restored by a noisy-channel decoder.

Three jobs. Counts of character trigrams over all documents give the language model. A bounded, documented sample of
labelled documents outside the held-out fold (at most SAMPLE_EACH of each label, in the order of a hash of the id) gives the
words: those that set toxic documents apart are picked one by one, each by the toxic documents it newly explains, and a
logistic regression weighs them. At last every whole text is read: words written with digits and signs, spaced
letters or repeated letters become a lattice of what each character may stand for, Viterbi search under the language model
restores the word, and the restored words are scored.

Held-out rows (crc32 of the id as text, modulo 5, is 0) never enter the sample; lang, source and doc_id are no inputs.

Edge cases: a null or empty text gets the score of no evidence (under 0.5); without labelled rows of both kinds every
score is the share of toxic rows, or 0; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import checkpointed, id_and_text, slices, table, with_texts

#: Most labelled documents of each label that the classifier is fitted on.
SAMPLE_EACH = 3000
#: The least number of sampled toxic documents a word must newly explain, so SAMPLE_EACH bounds the words, and its least precision.
LEAST_NEW, LEAST_PRECISION = 3, 0.9
#: A word in this share of the sampled toxic documents counts as evidence of its own, even where others explain them too.
COMMON_SHARE = 0.03
#: Documents that the assumed one-word document of each picked word counts for.
LONE_WORD_TRUST = 5.0
WORD_ENTRIES = 200_000
#: Longer chunks are decoded each time, so that a worker doesn't hold on to them.
LONGEST_KEPT = 100

_A = 26  # letters; code 0 is the edge of a word
_CODES = _A + 1
#: Letters that digits and signs stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l",
}
_CHANNEL = {"same": 0.05, "sign": 1.2, "drop": 1.0, "star": 2.2}


def letter_of_latin1() -> np.ndarray:
    """The code of each Latin-1 byte: 1 to 26 for letters without their accents, 0 for all else."""
    out = np.zeros(256, np.uint16)
    for b in range(256):
        base = unicodedata.normalize("NFD", chr(b)).lower()[0]
        if "a" <= base <= "z" and chr(b).isalpha():
            out[b] = ord(base) - 96
    return out


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(code, n) of every character trigram in all texts. Each task adds up its own table first."""

    def count(batches):
        letters, total = letter_of_latin1(), np.zeros(_CODES**3, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                c = letters[np.frombuffer(f" {text} ".encode("latin-1", "replace"), np.uint8)].astype(np.int32)
                total += np.bincount(c[:-2] * _CODES * _CODES + c[1:-1] * _CODES + c[2:], minlength=_CODES**3) if c.size > 2 else 0
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(total[code], pa.int64())], names=["code", "n"])

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Negative log probability of a letter after two others, backed off to shorter contexts."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(_CODES, _CODES, _CODES).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + _CODES)
        p2 = (bi + 50 * p1) / (bi.sum(1, keepdims=True) + 50)
        p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
        self.cost = (-np.log(p3)).ravel().tolist()

    def restore(self, noisy: str, edges: bool = False) -> str:
        """The likeliest word behind a noisy one: a lattice of (cost, letters) by the last two letters, left to right.

        The whole text is decoded, whatever its length; with ``edges`` the lattice may end a word after any letter, and words come apart by blanks.
        """
        cost_of = self.cost
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # letters are linked from the last to the first
        for c in noisy:
            arcs: list[tuple[str, float]] = []
            plain = unicodedata.normalize("NFD", c)[0].lower()
            if "a" <= plain <= "z":
                arcs.append((plain, _CHANNEL["same"]))
            stands = LOOKALIKES.get(c, "")
            arcs += [(x, _CHANNEL["sign"] + _CHANNEL["star"] * (len(stands) > 2)) for x in stands]
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (p, q), (cost, word) in states.items():
                for letter, price in arcs:
                    code = ord(letter) - 96
                    total = cost + price + cost_of[(p * _CODES + q) * _CODES + code]
                    key = (q, code)
                    if key not in nxt or total < nxt[key][0]:
                        nxt[key] = (total, (word, letter))
                    if edges and q:
                        total = cost + price + cost_of[(p * _CODES + q) * _CODES] + cost_of[q * _CODES * _CODES + code]
                        if total < nxt.get((0, code), (math.inf,))[0]:
                            nxt[(0, code)] = (total, ((word, " "), letter))
                    if code == q and (total := cost + _CHANNEL["drop"]) < nxt.get((p, q), (math.inf,))[0]:
                        nxt[(p, q)] = (total, word)  # the same letter again
                if not arcs or not plain.isalpha():  # a sign that stands for nothing
                    total = cost + (0.2 if not stands else 20.0)
                    if total < nxt.get((p, q), (math.inf,))[0]:
                        nxt[(p, q)] = (total, word)
            states = nxt
        best = min(states.items(), key=lambda s: s[1][0] + cost_of[(s[0][0] * _CODES + s[0][1]) * _CODES], default=None)
        letters, link = [], best[1][1] if best else None
        while link:
            link, letter = link
            letters.append(letter)
        return "".join(reversed(letters))


_EDGES = ".,;:?\"'()[]{}<>-_~`#%&*$!|"
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ ._*-]{1,2}[^\W_]){3,}(?![^\s.,!?])")
_SPACED_HINT = re.compile(r" [^\W_][ ._*-]{1,2}[^\W_][ ._*-]{1,2}[^\W_]")
_SPELLED = re.compile(r"[^\W_](?:[._*~-]{1,2}[^\W_]){3,}")
_BETWEEN, _NO_LETTER = re.compile(r"[^\w@$!|+(*#€£]+|_+"), re.compile(r"[\W_]+")
_JOINED = re.compile(r"[^\W\d_][._*~-][^\W\d_]")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_SIGN_INSIDE = re.compile(r"[^\W\d_][0-9@$!|+*#€£(]+[^\W\d_]|^[0-9@$!|+(]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$!|+]+$")


def fold(word: str) -> str:
    return word.strip(_EDGES).lower()


def _latin(c: str) -> bool:
    base = unicodedata.normalize("NFD", c)[0].lower()
    return "a" <= base <= "z" or not base.isalpha()


def parts_of(chunk: str) -> set[str]:
    """What punctuation, letters of other scripts and at last signs hold apart in a chunk, in pieces of two characters or more."""
    own = chunk if chunk.isascii() else "".join(c if _latin(c) else " " for c in chunk)
    return {p for pattern in (_BETWEEN, _NO_LETTER) for p in pattern.split(own) if len(p) > 1} - {chunk}


class Restorer(dict):
    """The words behind white-space-separated chunks: the chunk's own word and, if it looks noisy, the restored one."""

    def __init__(self, model: CharacterModel):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if len(self) >= WORD_ENTRIES:
            self.clear()
        out = self._words(chunk)
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = out
        return out

    def _words(self, chunk: str) -> tuple[str, ...]:
        word = fold(chunk)
        if word.isalpha() and word.isascii() and (len({*word}) > len(word) - 2 or not _THRICE.search(word)):
            return (word,)
        own = chunk.strip(".,;:?\"'").lower()
        if not word:
            return ()
        words = {word, *self._restored(own, word)}
        for part in parts_of(own):
            plain = fold(part)
            words.update((plain, *self._restored(part, plain)))
        return tuple(sorted(words - {""}))

    def _restored(self, own: str, word: str) -> set[str]:
        if not (_SIGN_INSIDE.search(own) or _JOINED.search(own) or _THRICE.search(own)):
            return set()
        spelled = [w for m in _SPELLED.finditer(own) for w in self.model.restore(m[0], edges=True).split()]
        return {self.model.restore(own), self.model.restore(word), *spelled}

    def spaced(self, text: str) -> list[str]:
        """Words behind spaced-out runs: each run as one word, as the words it is likeliest made of, and as those that wider gaps hold apart."""
        if not _SPACED_HINT.search(text) and not _SPACED_HINT.match(" " + text[:8]):
            return []
        words = []
        for m in _SPACED.finditer(text):
            run = re.sub(r"[ ._*-]", "", m[0]).lower()
            words += [self.model.restore(run), *self.model.restore(run, edges=True).split()]
            words += [self.model.restore(re.sub(r"[._*-]", "", part.replace(" ", "")).lower()) for part in (m[0].split("  ") if "  " in m[0] else ())]
        return [w for w in dict.fromkeys(words) if w]

    def features(self, text: str) -> set[str]:
        """Restored words of a text, and the first four and five letters of the longer ones."""
        words = set()
        for chunk in set(text.split()):
            words.update(self[chunk])
        words.update(self.spaced(text))
        return words | {w[:n] + "-" for w in words for n in (4, 5) if len(w) >= n}


def training_sample(labels: DataFrame, docs: DataFrame, each: int = SAMPLE_EACH) -> DataFrame:
    """(doc_id, text, toxic) of at most ``each`` labelled documents of each label, none of the held-out fold.

    The ids of the sample are bounded by its parameter, so they are broadcast.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .distinct()
    )
    order = F.xxhash64(F.lit(4), "doc_id")
    picked = rows.where("toxic").orderBy(order).limit(each).unionByName(rows.where("not toxic").orderBy(order).limit(each))
    return docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")


def _select_words(rows: list[tuple[bool, set[str]]]) -> list[str]:
    """Words of high precision: each picked by the toxic documents that it newly explains, then all that are common."""
    toxic, clean = Counter(), Counter()
    for is_toxic, words in rows:
        (toxic if is_toxic else clean).update(words)
    good = {w for w, n in toxic.items() if n >= LEAST_NEW and n >= LEAST_PRECISION * (n + clean[w])}
    left = [words & good for is_toxic, words in rows if is_toxic]
    picked: list[str] = []
    while True:
        news = Counter(w for words in left for w in words)
        # whole words before their beginnings, shorter before longer, so that ties are settled alike on every run
        best = min(news, key=lambda w: (-news[w], w.endswith("-"), len(w), w), default=None)
        if best is None or news[best] < LEAST_NEW:
            break
        picked.append(best)
        left = [words for words in left if best not in words]
    whole = [w for w in good if not w.endswith("-")]
    same = {w[:n] + "-" for w in whole for n in (4, 5) if toxic[w] >= 0.8 * toxic[w[:n] + "-"]}  # beginnings of one word only
    picked = [next(w for w in whole if w.startswith(p[:-1]) and toxic[w] >= 0.8 * toxic[p]) if p in same else p for p in picked]
    picked, good = list(dict.fromkeys(picked)), good - same
    common = max(2 * LEAST_NEW, COMMON_SHARE * sum(t for t, _ in rows))
    return picked + sorted((w for w in good - {*picked} if toxic[w] >= common), key=lambda w: (-toxic[w], w))


class Classifier:
    """Bias and weights by word, fitted by Newton steps with an L2 penalty."""

    def __init__(self, words: list[str], weights: np.ndarray):
        self.bias, self.weight = float(weights[0]), dict(zip(words, map(float, weights[1:]), strict=True))

    @classmethod
    def fit(cls, rows: list[tuple[bool, set[str]]]) -> Classifier:
        words = _select_words(rows)
        n_toxic = sum(t for t, _ in rows)
        if not words or not 0 < n_toxic < len(rows):
            share = n_toxic / len(rows) if rows else 0.0
            return cls([], np.array([math.log(max(share, 1e-6) / max(1 - share, 1e-6))]))
        place = {w: k + 1 for k, w in enumerate(words)}
        x = np.zeros((len(rows) + len(words), 1 + len(words)))
        x[:, 0] = 1
        for k, (_, own) in enumerate(rows):
            x[k, [place[w] for w in own & place.keys()]] = 1
        # for each word a document of it alone: words that mostly come together still count one by one
        x[len(rows) + np.arange(len(words)), 1 + np.arange(len(words))] = 1
        y = np.array([t for t, _ in rows] + [0.9] * len(words), float)
        trust = np.concatenate([np.ones(len(rows)), np.full(len(words), LONE_WORD_TRUST)])
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 0.01)
        penalty[0] = 0.01
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (trust * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (trust * (y - p)) - penalty * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        return cls(words, w)

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(sorted(self.weight[w] for w in words & self.weight.keys()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> tuple[np.ndarray, Classifier]:
    """(trigram counts of all documents, classifier). Both are of bounded size: 27^3 counts, and the sample's words."""
    counts = np.zeros(_CODES**3, np.int64)
    for row in count_trigrams(docs).collect():
        counts[row.code] = row.n
    table_of_counts = counts

    def words(batches):
        restorer = Restorer(CharacterModel(table_of_counts))
        for batch in slices(batches):
            own = [sorted(restorer.features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"]
            )

    sample = checkpointed(training_sample(labels, docs, each).mapInArrow(words, "doc_id long, toxic boolean, words array<string>"))
    by_word = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if("toxic").alias("n_toxic"), F.count_if(~F.col("toxic")).alias("n_clean")
    )
    good = by_word.where((F.col("n_toxic") >= LEAST_NEW) & (F.col("n_toxic") >= LEAST_PRECISION * (F.col("n_toxic") + F.col("n_clean"))))
    kept = (
        sample.select("doc_id", "toxic", F.explode_outer("words").alias("word"))
        .join(good.select("word", F.lit(1).alias("good")), "word", "left")
        .groupBy("doc_id", "toxic")
        .agg(F.array_sort(F.collect_list(F.when(F.col("good") == 1, F.col("word")))).alias("words"))
    )
    rows = sorted((r.doc_id, bool(r.toxic), set(r.words)) for r in kept.collect())
    return counts, Classifier.fit([(t, w) for _, t, w in rows])


SCHEMA = "doc_id long, score double, restored array<string>"


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text, and the words that it rests on. A narrow map after two small fits."""
    plain = id_and_text(docs, id_col, text_col)
    counts, classifier = fit_toxicity(plain, labels)

    def work(batches):
        scorer = Scorer(CharacterModel(counts), classifier)
        for batch in slices(batches):
            made = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s for s, _ in made], pa.float64()), pa.array([sorted(w) for _, w in made], pa.list_(pa.string()))],
                names=["doc_id", "score", "restored"],
            )

    return plain.mapInArrow(work, SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that score under the threshold."""
    counts, classifier = fit_toxicity(id_and_text(docs), labels)

    def work():
        scorer = Scorer(CharacterModel(counts), classifier)
        return lambda texts: [None if scorer.score(t)[0] >= threshold else t for t in texts]

    return with_texts(docs, work)


class Scorer(dict):
    """Weighed words of each chunk; nearly all chunks have none, so a text costs one look-up a chunk."""

    def __init__(self, model: CharacterModel, classifier: Classifier):
        super().__init__()
        self.restorer, self.classifier = Restorer(model), classifier
        self.whole = [w for w in classifier.weight if not w.endswith("-") and len(w) >= 4]

    def __missing__(self, chunk: str) -> frozenset[str]:
        if len(self) >= WORD_ENTRIES:
            self.clear()
        words = self.restorer._words(chunk)
        out = self._weighed(words) | (self._inside(words) if _SPELLED.search(chunk) else _NONE)
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = out
        return out

    def _weighed(self, words) -> frozenset[str]:
        known = self.classifier.weight
        own = [k for w in words for k in (w, w[:4] + "-", w[:5] + "-") if k in known]
        return frozenset(own) if own else _NONE

    def _inside(self, words) -> frozenset[str]:
        """Weighed words within words that were spelled letter by letter, as the lattice doesn't find every edge."""
        return frozenset(k for w in words for k in self.whole if k in w)

    def score(self, text: str) -> tuple[float, set[str]]:
        found = set(map(self.__getitem__, text.split()))
        spelled = self.restorer.spaced(text)
        found.add(self._weighed(spelled) | self._inside(spelled))
        words = set().union(*found)
        return self.classifier.score(words), words


_NONE: frozenset[str] = frozenset()


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, labels).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "restored",
    )
