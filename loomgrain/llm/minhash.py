"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomgrain.llm.common import U64, Words, lower_ascii, mix64, slices, utf8
from loomgrain.llm.order import in_id_order

FINGERPRINT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class OnePermutation:
    """Fingerprints of ``bins`` values of ``bits`` low-order bits each, over shingles of ``words`` words.

    Each shingle is hashed once: the high bits choose the bin, the rest is the value, and a bin keeps its
    least value. An empty bin takes the value of the first non-empty bin in a fixed random order of its
    own (optimal densification: the choice is uniform and the same for every text). Words are runs
    between ASCII white space with A-Z lower-cased; a text of fewer words is one shingle, an empty text
    the shingle of no words. So equal texts have equal fingerprints and two empty texts are alike.
    """

    def __init__(self, bins: int = 512, bits: int = 4, words: int = 5, seed: int = 7):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two and bits 1, 2, 4 or 8")
        self.bins, self.bits, self.words = bins, bits, words
        rng = np.random.default_rng(seed)
        self.probe = np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.int32)
        self.salt = rng.integers(0, 2**63, bins).astype(U64)
        self.rank = np.argsort(self.probe, axis=1).astype(np.int32)

    def shingles(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text index, shingle hash) pairs."""
        found = Words(raws)
        h, k, base = found.hashes(), self.words, U64(Words.BASE)
        count = np.diff(found.first)
        n = max(0, len(h) - k + 1)
        sh = np.zeros(n, U64)
        for j in range(k):
            sh = sh * base + h[j : j + n]
        owner = np.repeat(np.arange(len(raws)), count)
        whole = owner[:n] == owner[k - 1 : k - 1 + n]
        short = np.nonzero(count < k)[0]
        extra = np.zeros(len(short), U64)
        for i, d in enumerate(short):
            acc = U64(count[d] + 1)
            for x in h[found.first[d] : found.first[d + 1]]:
                acc = acc * base + x
            extra[i] = acc
        return np.concatenate([owner[:n][whole], short]), mix64(np.concatenate([sh[whole], extra]))

    def packed(self, raws: list[bytes]) -> np.ndarray:
        """A row of packed bytes for each text."""
        if not raws:
            return np.zeros((0, self.bins * self.bits // 8), np.uint8)
        with np.errstate(over="ignore"):
            owner, h = self.shingles(raws)
        cut = U64(64 - int(self.bins).bit_length() + 1)
        none = U64(2**64 - 1)
        flat = np.full(len(raws) * self.bins, none, U64)
        np.minimum.at(flat, owner * self.bins + (h >> cut).astype(np.int64), h & ((U64(1) << cut) - U64(1)))
        low = flat.reshape(len(raws), self.bins)
        full = low != none
        d, e = np.nonzero(~full)
        source = np.zeros(len(d), np.int64)
        left = np.arange(len(d))
        for a in range(min(12, self.bins)):
            at = self.probe[e[left], a]
            hit = full[d[left], at]
            source[left[hit]] = at[hit]
            left = left[~hit]
        for lo in range(0, len(left), 4096):  # sparse texts: the same rule, all places at once
            part = left[lo : lo + 4096]
            source[part] = np.where(full[d[part]], self.rank[e[part]], self.bins).argmin(axis=1)
        low[d, e] = low[d, source]
        with np.errstate(over="ignore"):  # bits of the value and the bin: values that fill many bins agree by chance in each bin anew
            value = (mix64(low ^ self.salt) & U64((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        out = np.zeros((len(raws), self.bins // per), np.uint8)
        for j in range(per):
            out |= value[:, j::per] << np.uint8(self.bits * (per - 1 - j))
        return out

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated Jaccard likeness of rows of packed bytes, corrected for low bits that agree by chance."""
        x, agree = a ^ b, 0
        for j in range(8 // self.bits):
            agree = agree + ((x >> np.uint8(self.bits * j)) & np.uint8((1 << self.bits) - 1) == 0).sum(axis=1)
        chance = 0.5**self.bits
        return np.clip((agree / self.bins - chance) / (1 - chance), 0.0, 1.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much, or all, of the start of ``following``."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprint_documents(docs: DataFrame, bins: int = 512, bits: int = 4, words: int = 5) -> DataFrame:
    """Fingerprint every document and its edited text; compare with the edited text and the next document.

    Null texts are empty. Null ids come first, rows of one id follow one another by a hash of the text (rows that are
    alike in both: one after the other), the last row's next is the first, a lone row's next is itself, an empty table
    gives an empty result. Texts of any length are read whole; other columns are ignored. An id of -2**63 counts as null.
    """
    ordered = in_id_order(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker, carry, carry_fp = OnePermutation(bins, bits, words), None, None
        for pdf in slices(frames, limit=3_000_000):
            rows = list(zip(pdf["text"], pdf["block"], pdf["halo"], pdf["doc_id"], pdf["times"], strict=True))
            fp = maker.packed([lower_ascii(utf8(r[0])) for r in rows])
            if carry is not None:
                rows, fp = [carry, *rows], np.concatenate([carry_fp, fp])
            carry, carry_fp = rows[-1], fp[-1:]
            pairs = []  # (row, the row that follows it, how many such)
            for i, ((_, block, halo, _, times), after) in enumerate(zip(rows, rows[1:])):
                if not halo and block == after[1]:
                    pairs += [(i, i, times - 1)] * (times > 1) + [(i, i + 1, 1)]
            if not pairs:
                continue
            own, following, times = (np.array(x) for x in zip(*pairs, strict=True))
            raws = [utf8(edited(rows[i][0], rows[j][0])) for i, j in zip(own, following, strict=True)]
            fp_changed = maker.packed([lower_ascii(r) for r in raws])
            fp_own, fp_next = fp[own], fp[following]
            out = pd.DataFrame({
                "doc_id": pd.array([None if pd.isna(rows[i][3]) else int(rows[i][3]) for i in own], "Int64"),
                "n_chars": [len(rows[i][0]) for i in own],
                "edited_sha256": [hashlib.sha256(r).hexdigest() for r in raws],
                "fingerprint": [x.tobytes().hex() for x in fp_own],
                "edited_fingerprint": [x.tobytes().hex() for x in fp_changed],
                "near_edited": maker.likeness(fp_own, fp_changed),
                "near_next": maker.likeness(fp_own, fp_next),
            })
            yield out.loc[np.repeat(np.arange(len(out)), times)] if (times > 1).any() else out

    return ordered.mapInPandas(run, FINGERPRINT_SCHEMA)
