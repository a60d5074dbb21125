"""Ladders of verdicts over stored signals of media, and segments of WAV sound by the standard library."""

from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineamark.operators.fingerprint import per_text

#: Confidences of the ladders.
EXACT, REMOVED, TAGGED, ALIKE, OTHER_TAG, PDF_REMOVED = 1.0, 0.99, 0.9, 0.85, 0.4, 0.95
#: The share of equal digits that is a partial match, and what it is worth.
PARTLY, PART_BASE, PART_SLOPE = 0.7, 0.7, 0.5


def digit_similarity(a: Column, b: Column) -> Column:
    """Share of equal characters of two hashes, by place, of the first one's length."""
    n = F.length(a)
    both = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.length(b))))
    differ = F.size(F.filter(both, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when((n > 0) & (F.length(b) > 0), 1 - differ / n)


def audio_confidence(match_after: Column, match_before: Column, tag_intact: Column, similarity: Column) -> Column:
    """similarity: of perceptual hashes, 1 if they are equal; null where there are none."""
    return F.when(match_after, EXACT).when(match_before, REMOVED).when(tag_intact, TAGGED).when(similarity == 1, ALIKE).when(
        similarity >= PARTLY,
        PART_BASE + (similarity - PARTLY) * PART_SLOPE,
    ).otherwise(0.0)


def video_confidence(match_after: Column, match_before: Column, tag_intact: Column, alike: Column, tag_present: Column) -> Column:
    return F.when(match_after, EXACT).when(match_before, REMOVED).when(tag_intact, TAGGED).when(alike, ALIKE).when(
        tag_present,
        OTHER_TAG,
    ).otherwise(0.0)


def pdf_confidence(match_after: Column, match_before: Column) -> Column:
    return F.when(match_after, EXACT).when(match_before, PDF_REMOVED).otherwise(0.0)


def wav(samples: Column, rate: int) -> Column:
    """Bytes as the samples (8 bits, one channel) of a WAV file."""
    n = F.octet_length(samples)

    def low_first(x: Column) -> Column:
        h = F.lpad(F.hex(x.cast("long")), 8, "0")
        return F.unhex(F.concat(*(F.substring(h, a, 2) for a in (7, 5, 3, 1))))

    fixed = b"WAVEfmt \x10\x00\x00\x00\x01\x00\x01\x00" + rate.to_bytes(4, "little") * 2 + b"\x01\x00\x08\x00data"
    return F.concat(F.lit(bytearray(b"RIFF")), low_first(n + 36), F.lit(bytearray(fixed)), low_first(n), samples)


SEGMENT = [
    ("segment_id", pa.string()),
    ("start_ms", pa.int64()),
    ("position", pa.int64()),
    ("duration_ms", pa.int64()),
    ("sha", pa.string()),
    ("entropy", pa.float64()),
    ("centroid", pa.float64()),
    ("flatness", pa.float64()),
]


def spectrum(data: bytes, width: int, channels: int, rate: int) -> dict:
    """Entropy of the amplitudes, centre of the frequencies and flatness; middling values for widths that numpy lacks."""
    kinds = {1: (np.uint8, 128, 128.0), 2: (np.int16, 0, 32768.0), 4: (np.int32, 0, 2147483648.0)}
    middling = {"entropy": 0.5, "centroid": rate / 2, "flatness": 0.5}
    if width not in kinds or len(data) % (width * channels):
        return middling
    kind, zero, scale = kinds[width]
    x = (np.frombuffer(data, kind).reshape(-1, channels).mean(axis=1) - zero) / scale
    tiny = 1e-10
    p = np.histogram(x, bins=256, range=(-1, 1))[0]
    p = p / (p.sum() + tiny)
    out = middling | {"entropy": min(1.0, max(0.0, float(-(p * np.log2(p + tiny)).sum()) / 8))}
    m = np.abs(np.fft.rfft(x))
    if m.sum() > 0:
        out["centroid"] = float((np.fft.rfftfreq(len(x), 1 / rate) * m).sum() / m.sum())
        out["flatness"] = min(1.0, max(0.0, float(np.exp(np.log(m + tiny).mean()) / (m.mean() + tiny))))
    return out


def segments_of(data: bytes | None, count: int, length_ms: int) -> list[dict]:
    """Evenly spread segments of a WAV file; none for what is no such file or has no frames."""
    try:
        with wave.open(io.BytesIO(data or b""), "rb") as f:
            rate, frames, width, channels = f.getframerate(), f.getnframes(), f.getsampwidth(), f.getnchannels()
            if frames <= 0:
                return []
            whole, out = int(frames / rate * 1000), []
            for k in range(count):
                start = int(whole * (k + 1) / (count + 1))
                first = int(start / 1000 * rate)
                f.setpos(first)
                part = f.readframes(int(length_ms / 1000 * rate))
                if not part:
                    break
                out.append(
                    {
                        "segment_id": f"audio_segment_{k}_{start}",
                        "start_ms": start,
                        "position": first,
                        "duration_ms": min(length_ms, whole - start),
                        "sha": hashlib.sha256(part).hexdigest(),
                    } | spectrum(part, width, channels, rate)
                )
            return out
    except (wave.Error, EOFError):
        return []


def wav_segments(df: DataFrame, key: str, data: str, count: int = 3, length_ms: int = 2000) -> DataFrame:
    """key and the fields of SEGMENT for each segment of each row's file."""
    kind = "array<struct<segment_id:string,start_ms:bigint,position:bigint,duration_ms:bigint,sha:string,entropy:double,centroid:double,flatness:double>>"
    found = per_text(df, key, data, "s", kind, pa.list_(pa.struct(SEGMENT)), lambda: lambda b: segments_of(b, count, length_ms))
    return found.select(key, F.inline("s"))
