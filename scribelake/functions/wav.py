"""RIFF/WAVE headers and samples of one file, given as bytes or as anything with a length and slices."""

from __future__ import annotations

import re
import struct
from datetime import datetime

import numpy as np

# Encodings by (format code, bits), and the extensible subformat tail.
ENCODINGS = {
    (1, 16): "PCM16", (1, 24): "PCM24", (1, 32): "PCM32", (3, 32): "IEEE_FLOAT32", (3, 64): "IEEE_FLOAT64",
}
GUID_TAIL = bytes.fromhex("00001000800000aa00389b71")
EXTENSIBLE = 0xFFFE
MAX_CHANNELS, MAX_RATE, MAX_FORMAT_BYTES = 64, 768_000, 65_536
BEXT_CLOCK_AT, BEXT_MIN_BYTES = 320, 602
BLOCK_SECONDS, BLOCK_SAMPLES = 5, 1_048_576


class Refused(ValueError):
    """A file that cannot be read safely; the text is the reason code."""


def need(condition, reason: str) -> None:
    if not condition:
        raise Refused(reason)


def chunks(data: bytes):
    """(id, payload start, payload size) of each chunk; refuses a broken container."""
    need(len(data) >= 12 and data[:4] == b"RIFF" and data[8:12] == b"WAVE", "not_riff_wave")
    need(struct.unpack("<I", data[4:8])[0] + 8 == len(data), "riff_size_mismatch")
    at = 12
    while at < len(data):
        need(at + 8 <= len(data), "chunk_header_incomplete")
        name, size = struct.unpack("<4sI", data[at : at + 8])
        padded = size + (size & 1)
        need(at + 8 + padded <= len(data), "chunk_past_end")
        yield name, at + 8, size
        at += 8 + padded


def _format(raw: bytes) -> dict:
    tag, channels, rate, byte_rate, align, bits = struct.unpack_from("<HHIIHH", raw)
    if tag == EXTENSIBLE:
        need(len(raw) >= 40 and struct.unpack_from("<H", raw, 16)[0] >= 22, "extensible_incomplete")
        need(struct.unpack_from("<H", raw, 18)[0] == bits, "extensible_bits")
        need(raw[28:40] == GUID_TAIL, "extensible_guid")
        (tag,) = struct.unpack_from("<I", raw, 24)
    need((tag, bits) in ENCODINGS, "encoding_unsupported")
    need(0 < channels <= MAX_CHANNELS and 0 < rate <= MAX_RATE, "channels_or_rate")
    need(align * 8 == channels * bits and byte_rate == rate * align, "alignment_mismatch")
    return {"code": tag, "bits": bits, "encoding": ENCODINGS[tag, bits], "channels": channels, "rate": rate, "align": align}


def header(data: bytes) -> dict:
    """Format, frames, orphan bytes and chunk list of a file."""
    fmt = where = None
    listed = []
    for name, start, size in chunks(data):
        listed.append((name.decode("ascii", "replace"), size))
        if name == b"fmt ":
            need(fmt is None and 16 <= size <= MAX_FORMAT_BYTES, "format_chunk_invalid")
            fmt = _format(data[start : start + size])
        elif name == b"data":
            need(where is None, "multiple_data")
            where = (start, size)
    need(fmt is not None and where is not None, "missing_chunk")
    frames, orphan = divmod(where[1], fmt["align"])
    need(frames, "no_frames")
    return {**fmt, "at": where[0], "frames": frames, "orphan_bytes": orphan, "chunks": listed}


def embedded_clock(data: bytes) -> str | None:
    """The one well-formed origination clock; null when absent, malformed or ambiguous."""
    found = []
    try:
        for name, start, size in chunks(data):
            if name != b"bext":
                continue
            if size < BEXT_MIN_BYTES:
                return None
            text = data[start + BEXT_CLOCK_AT : start + BEXT_CLOCK_AT + 18].decode("ascii")
            parts = re.fullmatch(r"(\d{4}).(\d{2}).(\d{2})(\d{2}).(\d{2}).(\d{2})", text)
            if parts is None:
                return None
            found.append(datetime(*map(int, parts.groups())).isoformat())
    except (Refused, ValueError):
        return None
    return found[0] if len(found) == 1 else None


def samples(data: bytes, head: dict, first: int, last: int) -> np.ndarray:
    """Frames x channels in [-1, 1] of a frame range; refuses non-finite values."""
    raw = data[head["at"] + first * head["align"] : head["at"] + last * head["align"]]
    if head["code"] == 3:
        values = np.frombuffer(raw, f"<f{head['bits'] // 8}").astype(np.float64)
    elif head["bits"] == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        values = wide.reshape(-1).view("<i4") / float(1 << 31)
    else:
        values = np.frombuffer(raw, f"<i{head['bits'] // 8}") / float(1 << (head["bits"] - 1))
    need(np.isfinite(values).all(), "non_finite_samples")
    return values.reshape(-1, head["channels"])


def block_frames(head: dict) -> int:
    return min(head["rate"] * BLOCK_SECONDS, BLOCK_SAMPLES // head["channels"])
