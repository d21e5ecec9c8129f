"""Operator 5: personal data - fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The tagger adds spans that the patterns miss: e-mail addresses written with words or brackets, phone
numbers without a plus sign, addresses and cards with unusual separators. It is trained in numpy, on the driver, from a fixed number of labelled
spans that a seeded generator writes into invented prose, so its cost does not depend on the input. Every kind holds a digit, an at-sign or a word
or bracket for one, so the windows around these hold every possible span; windows overlap by half, each is decoded by Viterbi, and each
character takes the tag, and the tag's marginal probability, of the window in which it lies furthest from an edge. A found span stays if
it touches no base span, if none of its characters is less likely than LEAST_SURE and if it can be of its kind at all (a check digit, parts
up to 255, a number of digits, something for "at" and "dot"), which a tagger can't count.

Edge cases: a null or empty text has no spans; offsets are code points over the whole text; digits of any length are read in
linear time; a null id is an id like others; repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import id_and_text, slices, table, with_texts

KINDS = ("email", "ip", "card", "phone")
#: What a base span of each kind looks like.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) << (n & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Works from each at-sign, so a long word without one costs nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, end)):
            end = m.end()
            out.append((0, start, end))
            free = end
        else:
            free = at + 1
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of every base span, by kind and start."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


# --- the tagger ---------------------------------------------------------------------------------------------------

WINDOW, STRIDE = 64, 32
HIDDEN, EMBED, SYMBOLS = 20, 12, 98
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
SEED, TRAIN_WINDOWS, STEPS, BATCH, RATE = 11, 4096, 300, 64, 0.025
#: A span with a character whose tag is less likely than this is not taken.
LEAST_SURE = 0.8
_SEEDS = re.compile(r"[0-9@]|[\[({] ?(?:at|dot|AT|DOT)\b|\b(?:dot|DOT)\b")


def _codes(text: str) -> np.ndarray:
    """0 is padding, 1 to 96 printable ASCII and newline, 97 the rest."""
    raw = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return np.where((raw >= 32) & (raw < 127), raw - 31, np.where(raw == 10, 96, 97))


def _writers(rng: np.random.Generator):
    """Functions that write a word, a span of each kind, and a look-alike that is no personal data."""
    letters, plain = np.array(list("abcdefghijklmnopqrstuvwxyzéèñüöß")), np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def one(*choices):
        return choices[rng.integers(len(choices))]

    def name(low, high):
        return "".join(rng.choice(plain, rng.integers(low, high)))

    def word():
        made = "".join(rng.choice(letters, rng.integers(1, 10))) if rng.random() < 0.7 else one("at", "dot", "the", "###", "&&&", "!!!", "==", "...")
        return made.capitalize() if rng.random() < 0.15 else made

    def digits(k):
        return "".join(map(str, rng.integers(0, 10, k)))

    def email():
        who, host, end = one(name(3, 9), f"{name(3, 7)}.{name(3, 7)}", f"{name(3, 8)}{digits(2)}"), name(3, 9), one("com", "org", "net", "example.com", "de", "edu")
        at, dot = one((" [at] ", " [dot] "), ("(at)", "."), (" {at} ", " {dot} "), (" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"), (" (at) ", "."), (" @ ", " . "), ("@", "."))
        return f"{who}{at}{host}{dot}{end}"

    def ip():
        return one(".", ".", " . ", "[.]", "(.)").join(str(rng.integers(1, 256)) for _ in range(4))

    def card():
        body = one("4", "5", "37", "6") + digits(14)
        full = next(body[:15] + str(c) for c in range(10) if luhn(body[:15] + str(c)))
        return one("", "-", " ", ".", "_", " - ", "/").join(re.findall("....", full))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return one(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+49 {a} {b}{c}", f"00 33 {a} {b} {c}", f"00{digits(2)} {a} {b}{c}", f"({a}) {b} {c}", f"{a}/{b}-{c}")

    small = lambda n: str(rng.integers(n))
    token = lambda: "".join(rng.choice(token_letters, rng.integers(12, 44)))
    token_letters = np.array(list("0123456789abcdefABCDEFxyzKQ"))
    decoys = (
        lambda: f"{small(9)}.{small(9)}", lambda: f"{small(9)}.{small(9)}.0.", lambda: small(3000), lambda: f"({small(99)})", lambda: f"AKIA{digits(6)}XQ{digits(8)}",
        lambda: f"password={digits(4)}ab{digits(5)}", lambda: f"{digits(2)}%", lambda: f"{small(9)}.", lambda: f'"{token()}"', lambda: f'token = "{token()}',
        lambda: f"{one('19', '20')}{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: digits(9),
        lambda: digits(5), lambda: f"{word()}@{word()}", lambda: digits(21), lambda: f"{word()} at {word()}", lambda: f"{word()} dot {word()}", lambda: f"{word()} (at {word()})",
        lambda: f"{digits(3)}-{digits(4)}", lambda: f"{small(99)},{digits(3)},{digits(3)}.{digits(2)}", lambda: f"x{digits(8)}", lambda: f"{digits(4)} {digits(2)}",
    )

    def decoy():
        return one(*decoys)()

    return word, (email, ip, card, phone), decoy


def labelled_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of invented prose with labelled spans in them, and look-alikes that are not personal data."""
    rng = np.random.default_rng(seed)
    word, make, decoy = _writers(rng)
    xs, ys = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for k in range(n):
        text, tags = "", []
        lead = rng.integers(0, 5)
        while len(text) < WINDOW + 40:
            pick = rng.random()
            kind = -1
            if lead > 0 or pick < 0.55:
                piece, lead = word(), lead - 1
            elif pick < 0.78:
                piece = decoy()
            else:
                kind = int(rng.choice(4, p=(0.4, 0.2, 0.15, 0.25)))
                piece = make[kind]()
            text += piece
            tags += [0] * len(piece) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
            gap = [" ", " ", " ", ", ", ".\n", " - "][rng.integers(6)]
            text += gap
            tags += [0] * len(gap)
        at = rng.integers(0, 30)
        xs[k], ys[k] = _codes(text)[at : at + WINDOW], tags[at : at + WINDOW]
    return xs, ys


def _init(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"emb": normal(SYMBOLS, EMBED) * 3, "out": normal(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for side in "fb":
        w[f"in_{side}"] = normal(EMBED, 4 * HIDDEN)
        w[f"rec_{side}"] = normal(HIDDEN, 4 * HIDDEN)
        w[f"gate_{side}"] = np.zeros(4 * HIDDEN, np.float32)
        w[f"gate_{side}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
    return w


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(w, side: str, e: np.ndarray):
    """States of one direction for inputs (time, window, feature), and what its gradient needs."""
    steps, n, _ = e.shape
    pre = e @ w[f"in_{side}"] + w[f"gate_{side}"]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ w[f"rec_{side}"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        was_c, was_h = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        kept.append((i, f, o, g, was_c, was_h, tc))
    return hs, kept


def _lstm_grad(w, side: str, e, kept, dhs, grad):
    steps, n, _ = e.shape
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dz_all = np.empty((steps, n, 4 * HIDDEN), np.float32)
    rec = np.zeros_like(w[f"rec_{side}"])
    for t in range(steps - 1, -1, -1):
        i, f, o, g, was_c, was_h, tc = kept[t]
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * was_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        rec += was_h.T @ dz
        dh, dc = dz @ w[f"rec_{side}"].T, dc * f
    grad[f"rec_{side}"] = rec
    grad[f"in_{side}"] = np.einsum("tne,tng->eg", e, dz_all)
    grad[f"gate_{side}"] = dz_all.sum((0, 1))
    return dz_all @ w[f"in_{side}"].T


def emissions(w, x: np.ndarray):
    """Tag scores (time, window, tag) of windows (window, time)."""
    e = w["emb"][x.T]
    hf, kf = _lstm(w, "f", e)
    hb, kb = _lstm(w, "b", e[::-1])
    h = np.concatenate([hf, hb[::-1]], axis=2)
    return h @ w["out"] + w["bias"], (e, h, kf, kb)


def _log_sum(a, axis):
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def _forward_backward(scores: np.ndarray, trans: np.ndarray):
    """Log sums over the tags before and after each place, and over all of a window."""
    steps = scores.shape[0]
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = scores[t] + _log_sum(alpha[t - 1][:, :, None] + trans[None], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    return alpha, beta, _log_sum(alpha[-1], 1)


def marginals(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of each tag at each place (time, window, tag)."""
    alpha, beta, z = _forward_backward(scores, trans)
    return np.exp(alpha + beta - z[None, :, None])


def crf_gradient(scores: np.ndarray, trans: np.ndarray, y: np.ndarray):
    """(mean negative log likelihood, gradient of scores, gradient of transitions), by forward and backward sums."""
    steps, n, k = scores.shape
    alpha, beta, z = _forward_backward(scores, trans)
    d_scores = np.exp(alpha + beta - z[None, :, None])
    pair = alpha[:-1][:, :, :, None] + trans + (scores[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]
    d_trans = np.exp(pair).sum((0, 1))
    yt, own = y.T, np.arange(n)
    gold = scores[0, own, yt[0]].copy()
    for t in range(steps):
        d_scores[t, own, yt[t]] -= 1
        if t:
            gold += scores[t, own, yt[t]] + trans[yt[t - 1], yt[t]]
            np.add.at(d_trans, (yt[t - 1], yt[t]), -1)
    return float((z - gold).mean()), d_scores / n, d_trans / n


@lru_cache(maxsize=1)
def trained_tagger(seed: int = SEED) -> tuple[tuple[str, np.ndarray], ...]:
    """Weights after a fixed number of Adam steps over a fixed number of labelled windows; the same on every run."""
    xs, ys = labelled_windows(TRAIN_WINDOWS, seed)
    w, rng = _init(seed), np.random.default_rng(seed + 1)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(xs), BATCH)
        x, y = xs[pick], ys[pick]
        scores, (e, h, kf, kb) = emissions(w, x)
        _, d_scores, d_trans = crf_gradient(scores, w["trans"], y)
        grad = {"trans": d_trans, "out": np.einsum("tnh,tnk->hk", h, d_scores), "bias": d_scores.sum((0, 1))}
        dh = d_scores @ w["out"].T
        de = _lstm_grad(w, "f", e, kf, dh[:, :, :HIDDEN], grad)
        de += _lstm_grad(w, "b", e[::-1], kb, dh[::-1, :, HIDDEN:], grad)[::-1]
        grad["emb"] = np.zeros_like(w["emb"])
        np.add.at(grad["emb"], x.T, de)
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for k in w:
            m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
            m2[k] = 0.99 * m2[k] + 0.01 * grad[k] ** 2
            w[k] = (w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tuple(w.items())


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (window, time)."""
    steps, n, _ = scores.shape
    best, back = scores[0], np.empty(scores.shape, np.int8)
    for t in range(1, steps):
        via = best[:, :, None] + trans[None]
        back[t] = via.argmax(1)
        best = via.max(1) + scores[t]
    tags = np.empty((n, steps), np.int8)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
    return tags


def window_starts(text: str) -> list[int]:
    """Starts, on a fixed grid, of the overlapping windows that hold a digit or a sign for "at", and of their neighbours."""
    grid: set[int] = set()
    for m in _SEEDS.finditer(text):
        cell = m.start() // STRIDE
        grid.update((cell - 2, cell - 1, cell, cell + 1))
    return [c * STRIDE for c in sorted(grid) if c * STRIDE < len(text) and c >= -1]


_AT, _DOT = re.compile(r"@|\bat\b", re.I), re.compile(r"\.|\bdot\b", re.I)


def possible(kind: int, piece: str) -> bool:
    """Whether a span can be of its kind at all; what it looks like, and where it begins and ends, is for the tagger to say."""
    digits = re.sub("[^0-9]", "", piece)
    if kind == 0:
        return len(piece) <= 120 and bool(_AT.search(piece) and _DOT.search(piece))
    if kind == 1:
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def tagged_spans(w: dict[str, np.ndarray], texts: list[str], most_windows: int = 512) -> list[list[tuple[Span, float]]]:
    """Spans that the tagger sees in each text, each with the probability of its least likely tag."""
    jobs = [(k, at) for k, t in enumerate(texts) for at in window_starts(t)]
    found: list[list[tuple[Span, float]]] = [[] for _ in texts]
    tags: dict[int, dict[int, tuple[int, int, float]]] = {}
    inner = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)).tolist()
    for first in range(0, len(jobs), most_windows):
        part = jobs[first : first + most_windows]
        x = np.zeros((len(part), WINDOW), np.int64)
        for row, (k, at) in enumerate(part):
            codes = _codes(texts[k][max(0, at) : at + WINDOW])
            x[row, max(0, -at) : max(0, -at) + codes.size] = codes
        scores = emissions(w, x)[0]
        best = viterbi(scores, w["trans"])
        some = np.flatnonzero(best.any(axis=1))  # only these windows hold spans
        sure = np.zeros(best.shape)
        if some.size:
            sure[some] = np.take_along_axis(marginals(scores[:, some], w["trans"]), best[some].T[:, :, None].astype(np.int64), 2)[:, :, 0].T
        for row, (k, at) in enumerate(part):
            own, length = tags.setdefault(k, {}), len(texts[k])
            for t, (tag, p) in enumerate(zip(best[row].tolist(), sure[row].tolist(), strict=True)):
                place = at + t
                if 0 <= place < length and inner[t] > own.get(place, (-1,))[0]:
                    own[place] = (inner[t], tag, p)
    for k, own in tags.items():
        run, least = None, 1.0
        for place in sorted(own):
            _, tag, p = own[place]
            kind, begins = (tag - 1) // 2, tag % 2 == 1
            if tag and run and run[2] == place and run[0] == kind and not begins:
                run, least = (kind, run[1], place + 1), min(least, p)
                continue
            if run:
                found[k].append((run, least))
            run, least = ((kind, place, place + 1), p) if tag else (None, 1.0)
        if run:
            found[k].append((run, least))
    return found


def find_spans(w: dict[str, np.ndarray], texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; an added span touches no base span."""
    out = []
    for text, base, more in zip(texts, map(base_spans, texts), tagged_spans(w, texts), strict=True):
        taken = np.zeros(len(text) + 1, bool) if more else None
        for _, a, b in base if more else ():
            taken[a:b] = True
        added = [s for s, sure in more if sure >= LEAST_SURE and not taken[s[1] : s[2]].any() and possible(s[0], text[s[1] : s[2]])]
        out.append((base, sorted(base + added)))
    return out


def write_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string"


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of spans that overlap, the earlier and longer one counts."""
    out, at = [], 0
    for start, end, kind in sorted((a, -b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
            at = -end
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = True) -> DataFrame:
    """Counts of base spans by kind, base and all spans in writing, and the redacted text. A narrow map."""
    weights = trained_tagger()

    def work(batches):
        w = dict(weights)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            made = find_spans(w, texts)
            counts = [[sum(s[0] == k for s in base) for base, _ in made] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([write_spans(base) for base, _ in made], pa.string()),
                    pa.array([write_spans(every) for _, every in made], pa.string()),
                    pa.array([redact(t, every) if with_redacted else None for t, (_, every) in zip(texts, made, strict=True)], pa.string()),
                ],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(work, SCHEMA)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with every span written as its kind."""
    weights = trained_tagger()

    def work():
        w = dict(weights)
        return lambda texts: [redact(t, every) for t, (_, every) in zip(texts, find_spans(w, texts), strict=True)]

    return with_texts(docs, work)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    return find_personal_data(table(spark, sf_dir, "documents"), with_redacted=False).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )
