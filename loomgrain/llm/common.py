"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: ASCII white space that separates words: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[list(SPACES)] = False


def texts(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), so that no other column of the input can clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of ``df``'s columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def slices(frames: Iterator[pd.DataFrame], column: str = "text", limit: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Arrow batches cut into runs of rows with at most ``limit`` characters (one longer row goes alone)."""
    for pdf in frames:
        if not len(pdf):
            continue
        ends = np.cumsum([len(t or "") for t in pdf[column]])
        at, base = 0, 0
        while at < len(pdf):
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield pdf.iloc[at:to]
            at, base = to, int(ends[to - 1])
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers are used again by later tasks, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lower_ascii(raw: bytes) -> bytes:
    """A-Z to a-z, everything else as it is."""
    return raw.translate(_LOWER)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n + 1, U64)
    out[0] = 1
    if n:
        out[1:] = U64(base)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
    return out


class Words:
    """Words of several byte strings, found and hashed together.

    ``start`` and ``end`` are byte places in ``buf``; words of string i are ``first[i]:first[i + 1]``;
    ``hash`` is a 64-bit polynomial hash of the bytes, mixed.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, raws: list[bytes]):
        joined = b" ".join(raws) + b" "
        self.buf = buf = np.frombuffer(joined, np.uint8)
        lens = np.fromiter((len(r) for r in raws), np.int64, len(raws))
        self.at = np.concatenate([[0], np.cumsum(lens + 1)])
        is_word = _WORD_BYTE[buf].view(np.int8)
        edges = np.diff(is_word, prepend=np.int8(0))
        self.start, self.end = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        self.first = np.searchsorted(self.start, self.at)

    def hashes(self) -> np.ndarray:
        """Word hashes by length class: a gather of 8 bytes at a time, whatever the word's length."""
        n = len(self.start)
        length = self.end - self.start
        out = length.astype(U64)
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        word8 = np.lib.stride_tricks.as_strided(padded, (len(self.buf), 8), (1, 1))
        live = np.arange(n)
        k = 0
        while len(live):
            rest = length[live] - k
            chunk = np.ascontiguousarray(word8[self.start[live] + k]).view(U64).ravel()
            keep = np.minimum(rest, 8).astype(U64)
            chunk = np.where(keep == 8, chunk, chunk & ((U64(1) << (keep * U64(8))) - U64(1)))
            out[live] = mix64(out[live] * U64(self.BASE) + chunk)
            live = live[rest > 8]
            k += 8
        return out
