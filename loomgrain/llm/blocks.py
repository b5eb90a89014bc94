"""Compressed blocks of sorted hashes that tasks send to shards, and the memory-mapped files shards leave."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

from loomgrain.llm.common import U64
from loomgrain.operators.shared import new_folder


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash, so shards in turn are in hash order."""
    return (((h >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int32)


def squeezed(x: np.ndarray, delta: bool = False) -> bytes:
    if delta and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) + x.size.to_bytes(8, "little")


def opened(raw: bytes, dtype: str, delta: bool = False) -> np.ndarray:
    n = int.from_bytes(raw[-8:], "little")
    x = np.frombuffer(pa.decompress(raw[:-8], decompressed_size=n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)
    return np.cumsum(x, dtype=dtype) if delta else x


def save(folder: str, name: str, x: np.ndarray) -> None:
    """Whole or not at all, so a task that runs again or twice leaves the same file."""
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        np.save(f, x)
    os.replace(temporary, f"{folder}/{name}.npy")


def local_folder(spark: SparkSession, label: str) -> str:
    """A folder under the shared one, as a path that every machine opens; the share must be a mounted file system."""
    root = new_folder(spark, label)
    scheme, _, path = root.rpartition("://")
    if scheme not in ("", "file") and not root.startswith("file:"):
        raise ValueError(f"the arrays are memory-mapped, so spark.checkpoint.dir must be a mounted folder, not {root}")
    folder = (path or root).removeprefix("file:")
    os.makedirs(folder)
    return folder


def drop_local(folder: str) -> None:
    """Delete arrays that nothing reads any more."""
    shutil.rmtree(folder, ignore_errors=True)


def fill_absent(folder: str, shards: int, written: set[int], *arrays: tuple[str, np.ndarray]) -> None:
    """Leave empty arrays (``{}`` in a name is the shard) for shards that got no rows, so that a file that isn't there is always an error."""
    for s in set(range(shards)) - written:
        for name, x in arrays:
            save(folder, name.format(s), x)


class Mapped:
    """The arrays of a folder, memory-mapped when first asked for. A missing file raises: every shard leaves one."""

    def __init__(self, folder: str, most: int = 4000):
        self.folder, self.most, self.open = folder, most, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.open:
            if len(self.open) > self.most:
                self.open.clear()
            path = f"{self.folder}/{name}.npy"
            try:
                self.open[name] = np.load(path, mmap_mode="r")
            except ValueError:  # an empty array can't be mapped
                self.open[name] = np.load(path)
        return self.open[name]


def places_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted value in the sorted ``keys``, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def rows_of(parts: Iterator[tuple], at_once: int = 400, columns: tuple[str, ...] = ("shard", "a", "b", "n")) -> Iterator[pd.DataFrame]:
    held = []
    for part in parts:
        held.append(part)
        if len(held) == at_once:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)
