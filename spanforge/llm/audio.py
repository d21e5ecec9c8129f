"""Operator 7: media columns - audio features of 8-bit sound held in a binary column.

A document's bytes, padded with zeros to a multiple of 64, are the samples of a mono 8-bit wave file, so nothing is lost.
Features come from the stored file alone: its samples are read back, resampled by a polyphase filter, cut into
overlapping frames, turned into log-mel energies and segmented by energy with hysteresis (a segment opens above the upper
threshold and closes below the lower one). Windows of frames are stored as fixed-shape Arrow tensors with their time spans.
Each row is worked on alone and in blocks, so equal bytes give equal values and memory follows the block, not the text.

Edge cases: a null or empty text is 64 zero bytes; the last window is filled up with the silence floor; repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import id_and_text, slices, table

RATE = 16_000
UP, DOWN = 1, 2
FRAME, HOP, MELS = 256, 128, 24
WINDOW_FRAMES = 64
BLOCK_FRAMES = 8192
#: Hysteresis on the frame energy relative to the mean of the recording, in decibels, and the shortest segment in frames.
OPEN_DB, CLOSE_DB, SHORTEST = 0.5, -0.5, 2
PAD = 64

STORED = "doc_id long, n_bytes long, payload_bytes long, media binary, payload binary, tensors binary, segments array<struct<start_s:double,end_s:double>>, n_frames long"


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A mono wave file of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def from_wave(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of such a file; its chunks are walked."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit mono samples are expected")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def low_pass(up: int, down: int, taps_a_phase: int = 16) -> np.ndarray:
    """Windowed-sinc prototype, one row for each phase."""
    n = taps_a_phase * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hamming(n)
    return (h * up / h.sum()).astype(np.float32).reshape(taps_a_phase, up).T.copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up/down: an output sample costs one phase's taps, and no zeros are multiplied."""
    phases = low_pass(up, down)
    taps = phases.shape[1]
    n_out = -(-x.size * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(taps, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n_out, np.float32)
    for first in range(min(up, n_out)):  # outputs of one phase are evenly spaced in the input
        start, phase = divmod(first * down, up)
        own = out[first::up]
        own[:] = views[start :: down][: own.size] @ phases[phase][::-1]
    return out


@lru_cache(maxsize=4)
def mel_bank(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters evenly spaced in mel."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(frame, 1 / rate)
    rise = (freq[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - freq[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32).T.copy()


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel energies, frame energies in decibels); frames overlap by half and are taken a block at a time."""
    n = max(1, 1 + -(-(x.size - FRAME) // HOP)) if x.size > FRAME else 1
    x = np.concatenate([x, np.zeros(max(0, FRAME + (n - 1) * HOP - x.size), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, BLOCK_FRAMES):
        part = frames[at : at + BLOCK_FRAMES] * window
        spectrum = np.fft.rfft(part, axis=1)
        mel[at : at + len(part)] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + np.float32(1e-6))
        energy[at : at + len(part)] = 10 * np.log10((part * part).mean(axis=1) + np.float32(1e-9))
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames [start, end) that open above one threshold and close below a lower one."""
    level = energy.mean()
    over, under = energy >= level + OPEN_DB, energy < level + CLOSE_DB
    mark = np.where(over, 1, np.where(under, -1, 0))
    known = np.maximum.accumulate(np.where(mark != 0, np.arange(mark.size), -1))
    state = np.where(known >= 0, mark[known] > 0, False)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], state.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2) if b - a >= SHORTEST]


TENSOR = pa.fixed_shape_tensor(pa.float32(), [WINDOW_FRAMES, MELS], dim_names=["frame", "mel"])
TENSOR_SCHEMA = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", TENSOR)])


def to_tensors(mel: np.ndarray, rate: int) -> bytes:
    """Windows of frames as an Arrow stream: a fixed-shape tensor with its time span in each row."""
    n = -(-len(mel) // WINDOW_FRAMES)
    full = np.full((n * WINDOW_FRAMES, MELS), np.log(np.float32(1e-6)), np.float32)
    full[: len(mel)] = mel
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), WINDOW_FRAMES * MELS)
    first = np.arange(n) * WINDOW_FRAMES
    last = np.minimum(first + WINDOW_FRAMES, len(mel)) - 1
    out = io.BytesIO()
    with pa.ipc.new_stream(out, TENSOR_SCHEMA) as writer:
        writer.write_batch(
            pa.record_batch(
                [pa.array(first * HOP / rate), pa.array((last * HOP + FRAME) / rate), pa.ExtensionArray.from_storage(TENSOR, storage)],
                schema=TENSOR_SCHEMA,
            )
        )
    return out.getvalue()


def from_tensors(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def features(media: bytes) -> tuple[bytes, bytes, list[tuple[float, float]], int]:
    """(samples read back, tensors, segments in seconds, frames) of a stored file."""
    rate, payload = from_wave(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    y, out_rate = resample(x), rate * UP // DOWN
    mel, energy = log_mel(y, out_rate)
    spans = [(a * HOP / out_rate, ((b - 1) * HOP + FRAME) / out_rate) for a, b in segments(energy)]
    return payload, to_tensors(mel, out_rate), spans, len(mel)


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored file, the samples read back from it, tensors and segments of every row. A narrow map."""

    def work(batches):
        for batch in slices(batches, 200):
            ids, raw = batch.column("doc_id").to_pylist(), [t.encode() for t in batch.column("text").to_pylist()]
            media = [to_wave(b + bytes(-len(b) % PAD if b else PAD)) for b in raw]
            made = [features(m) for m in media]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(b) for b in raw], pa.int64()),
                    pa.array([len(m[0]) for m in made], pa.int64()),
                    pa.array(media, pa.binary()),
                    pa.array([m[0] for m in made], pa.binary()),
                    pa.array([m[1] for m in made], pa.binary()),
                    pa.array(
                        [[{"start_s": a, "end_s": b} for a, b in m[2]] for m in made],
                        pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])),
                    ),
                    pa.array([m[3] for m in made], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "media", "payload", "tensors", "segments", "n_frames"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(work, STORED)


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored sound and of its features for every whole document."""
    made = audio_features(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, payload_bytes - {PAD - 1}, {PAD})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(
            F.lit("frames="),
            "n_frames",
            F.lit(";segments="),
            F.array_join(F.transform("segments", lambda s: F.format_string("%.3f-%.3f", s.start_s, s.end_s)), ","),
            F.lit(";log_mel_sha256="),
            F.sha2("tensors", 256),
        ).alias("feature"),
    )
