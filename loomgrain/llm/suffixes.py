"""Suffix-array dedup: repeated windows found by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.blocks import Mapped, fill_absent, local_folder, opened, places_in, rows_of, save, shard_of, squeezed
from loomgrain.llm.common import U64, mix64, slices, utf8

REMOVAL_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_COLUMNS = ("shard", "kind", "doc", "at", "more")
_BLOCKS = "shard int, kind int, doc binary, at binary, more binary"
_SPANS, _CONTEXTS, _WINDOWS = 0, 1, 2
_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
CHUNK = 400_000  # characters whose hashes are held at once, eight bytes each in several arrays
LAST = 2**63 - 1  # a null id's place in the order


def rolling(x: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hashes of all ``n`` bytes in a row along the last axis, built by doubling."""

    def _power(n: int) -> np.uint64:
        return U64(pow(base, n, 2**64))

    out, have = None, 0
    piece, size = x.astype(U64) + U64(1), 1
    while True:
        if n & size:
            if out is None:
                out, have = piece, size
            else:
                width = x.shape[-1] - have - size + 1
                out = out[..., :width] * _power(size) + piece[..., have : have + width]
                have += size
        if size * 2 > n:
            return out
        width = x.shape[-1] - 2 * size + 1
        piece = piece[..., :width] * _power(size) + piece[..., size : size + width]
        size *= 2


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


@dataclass(frozen=True)
class Depth:
    """``window`` bytes decide; the first pass looks at ``gram`` of them, by ``bits`` of their hash."""

    window: int = 50
    gram: int = 24
    bits: int = 64

    @property
    def slack(self) -> int:
        return self.window - self.gram

    @property
    def cut(self) -> np.uint64:
        return U64(64 - self.bits)

    @property
    def context(self) -> int:
        return self.window + self.slack


def anchors_of(raws: list[bytes], depth: Depth) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, where each text begins, places, hashes): of every window the gram of least hash.

    Which gram that is depends on the window's bytes alone, so equal windows have it at equal offsets, and
    a window repeats only if its gram does. Equal least grams all count.
    """
    gap = bytes(depth.context)
    joined = np.frombuffer(gap + b"".join(r + gap for r in raws), np.uint8)
    size = np.array([len(r) for r in raws], np.int64)
    begin = len(gap) + np.concatenate([[0], np.cumsum(size + len(gap))])[:-1]
    h = mix64(rolling(joined, depth.gram))
    least = _sliding_min(h, depth.slack + 1)
    inside = np.zeros(len(joined) + 1, np.int8)
    long = size >= depth.window
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, (begin + size - depth.window + 1)[long], -1)
    starts = np.cumsum(inside[: len(least)]) > 0  # places where a window begins
    most = U64(2**64 - 1)
    wanted = np.where(starts, least, U64(0))
    pad = np.zeros(depth.slack, U64)
    around = ~_sliding_min(~np.concatenate([pad, wanted, pad]), depth.slack + 1)  # the largest of the windows' minima round a gram
    chosen = np.nonzero((around[: len(h)] == h[: len(around)]) & (h[: len(around)] != most))[0]
    own = np.searchsorted(begin, chosen, side="right") - 1
    ok = (own >= 0) & (chosen + depth.gram <= (begin + size)[own]) & (size[own] >= depth.window)
    return joined, begin, chosen[ok], mix64(~h[chosen[ok]]) >> depth.cut << depth.cut  # least hashes are small: mixed anew, they are dealt evenly


def first_pass(docs: DataFrame, depth: Depth, folder: str, shards: int, crowd: int) -> None:
    """Keep the grams that occur in two documents or more, as sorted arrays; those in over ``crowd`` apart.

    A task sends each shard its distinct gram hashes and in how many documents each is; texts don't move.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, pending = [], 0

        def blocks() -> Iterator[tuple]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
            for s in np.nonzero(np.diff(ends))[0]:
                yield int(s), squeezed(h[ends[s] : ends[s + 1]] >> depth.cut, True), squeezed(n[ends[s] : ends[s + 1]].astype(np.uint32))

        for pdf in slices(frames, limit=CHUNK):
            _, begin, at, h = anchors_of([utf8(t) for t in pdf["text"]], depth)
            doc = np.searchsorted(begin, at, side="right") - 1
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            held.append(h[new])
            pending += len(held[-1])
            if pending > 1_000_000:
                yield from rows_of(blocks(), columns=("shard", "h", "n"))
                held, pending = [], 0
        if pending:
            yield from rows_of(blocks(), columns=("shard", "h", "n"))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, hs, ns, pending = None, [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h = np.concatenate(hs)
            order = np.argsort(h, kind="stable")
            h, n = h[order], np.concatenate(ns)[order]
            at = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
            return h[at], np.add.reduceat(n, at)

        for pdf in frames:
            for s, h, n in zip(pdf["shard"], pdf["h"], pdf["n"], strict=True):
                shard = int(s)
                hs.append(opened(h, "<u8", True) << depth.cut)
                ns.append(opened(n, "<u4").astype(np.int64))
                pending += len(hs[-1])
                if pending > 1_500_000 and pending > 2 * len(hs[0]):
                    h, n = merged()
                    hs, ns, pending = [h], [n], len(h)
        if pending:
            h, n = merged()
            save(folder, f"repeated-{shard}", h[n > 1])
            save(folder, f"crowded-{shard}", h[n > crowd])
            yield pd.DataFrame({"shard": [shard]})

    grams = docs.select("text").mapInPandas(count, "shard int, h binary, n binary").repartitionById(shards, F.col("shard"))
    done = {r["shard"] for r in grams.mapInPandas(merge, "shard int").collect()}  # a row for each shard
    fill_absent(folder, shards, done, ("repeated-{}", np.zeros(0, U64)), ("crowded-{}", np.zeros(0, U64)))


def known(arrays: Mapped, shards: int, name: str, h: np.ndarray) -> np.ndarray:
    """Which hashes are in the first pass's arrays."""
    order = np.argsort(h, kind="stable")
    q, found = h[order], np.zeros(len(h), bool)
    ends = np.searchsorted(shard_of(q, shards), np.arange(shards + 1))
    for s in np.nonzero(np.diff(ends))[0]:
        own = order[ends[s] : ends[s + 1]]
        found[own] = places_in(arrays[f"{name}-{s}"], h[own])[1]
    return found


@dataclass
class Entries:
    """Grams that repeat, each with the bytes round it: ``left`` and ``right`` say how many are the text's own."""

    doc: np.ndarray  # id
    text: np.ndarray  # hash of the text: rows that share an id stay apart
    at: np.ndarray  # place of the gram in its text
    left: np.ndarray
    right: np.ndarray
    h: np.ndarray
    context: np.ndarray

    FIELDS = ("doc", "text", "at", "left", "right", "h", "context")

    def pick(self, i: np.ndarray) -> Entries:
        return Entries(*[getattr(self, f)[i] for f in self.FIELDS])

    @classmethod
    def join(cls, parts: list[Entries]) -> Entries:
        return cls(*[np.concatenate([getattr(p, f) for p in parts]) for f in cls.FIELDS])

    def windows(self, depth: Depth) -> np.ndarray:
        """Which of the windows that hold the gram lie in the text; column j begins j bytes before it."""
        j = np.arange(depth.slack + 1)
        return (j <= self.left[:, None]) & (depth.window - j <= self.right[:, None])

    def window_hashes(self, depth: Depth, base: int) -> np.ndarray:
        return mix64(rolling(self.context, depth.window, base)[:, depth.slack :: -1])

    def span(self, j_most: np.ndarray, j_least: np.ndarray, depth: Depth) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold one gram overlap, so what several cover is one span."""
        return self.doc, self.text, self.at - j_most, self.at - j_least + depth.window


def _first_of_equal(keys: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """For each row, the number of a row with equal keys and the least ``doc``."""
    order = np.lexsort((doc, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    head = np.empty(len(order), np.int64)
    head[order] = order[np.nonzero(new)[0]][np.cumsum(new) - 1]
    return head


def radix_order(suffix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in order of group and bytes, how many bytes each shares with the row before it; -1 where a group begins).

    Most significant digit first, eight bytes a digit: a pass orders the rows of each class by their next digit and
    splits the class where digits differ. A class of one row is in its place and takes no part in later passes.
    """
    n, width = suffix.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = suffix
    digits = padded.view(">u8").astype(U64)
    order = np.argsort(group, kind="stable")
    new = np.ones(n, bool)
    new[1:] = group[order[1:]] != group[order[:-1]]
    shared = np.where(new, -1, width)
    for d in range(digits.shape[1]):
        of = np.cumsum(new) - 1
        live = np.nonzero(np.bincount(of)[of] > 1)[0]
        if not len(live):
            break
        digit, own = digits[order[live], d], of[live]
        by = np.lexsort((digit, own))
        order[live], digit = order[live[by]], digit[by]
        apart = digit[1:] ^ digit[:-1]
        cut = np.nonzero((own[1:] == own[:-1]) & (apart != 0))[0]
        new[live[cut + 1]] = True
        shared[live[cut + 1]] = 8 * d + sum((apart[cut] < U64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
    return order, shared


def second_pass(docs: DataFrame, depth: Depth, folder: str, shards: int) -> DataFrame:
    """Blocks of entries for the shard of their gram's hash, windows for the shard of theirs, spans for their text's.

    Entries with equal bytes around them meet in their own task first: only the least document's travel, the
    others are covered already. Windows round a crowded gram travel one by one, the least document's only, under two
    independent 64-bit hashes of their bytes. Spans of one text that touch travel as one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays, held, pending = Mapped(folder), [], 0

        def blocks() -> Iterator[tuple]:
            e = Entries.join(held)
            fit = e.windows(depth).any(axis=1)
            e = e.pick(np.nonzero(fit)[0])
            if not len(e.doc):
                return
            # equal contexts
            words = np.zeros((len(e.doc), -(-depth.context // 8) * 8), np.uint8)
            words[:, : depth.context] = e.context
            key = e.left.astype(U64) << U64(32) | e.right.astype(U64)
            for column in words.view(U64).T:
                key = mix64(key * U64(_BASE) + column)
            head = _first_of_equal([key], e.doc)
            equal = (e.context == e.context[head]).all(axis=1) & (e.left == e.left[head]) & (e.right == e.right[head])
            done = equal & (e.doc > e.doc[head])
            spans = [_extent(e.pick(np.nonzero(done)[0]), None, depth)]
            e = e.pick(np.nonzero(~done)[0])
            crowded = known(arrays, shards, "crowded", e.h)
            if crowded.any():
                yield from single_windows(e.pick(np.nonzero(crowded)[0]), spans)
                e = e.pick(np.nonzero(~crowded)[0])
            shard = shard_of(e.h, shards)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.nonzero(np.diff(ends))[0]:
                x = e.pick(order[ends[s] : ends[s + 1]])
                yield (int(s), _CONTEXTS, squeezed(np.concatenate([x.doc.view(U64), x.text.view(U64)])), squeezed(np.concatenate([x.at.view(U64), x.left.astype(U64) << U64(32) | x.right.astype(U64), x.h])), squeezed(x.context))
            yield from span_blocks(spans)

        def single_windows(e: Entries, spans: list) -> Iterator[tuple]:
            for lo in range(0, len(e.doc), 20_000):
                x = e.pick(np.arange(lo, min(lo + 20_000, len(e.doc))))
                covered = x.windows(depth)
                r, j = np.nonzero(covered)
                first, second = (x.window_hashes(depth, base)[r, j] for base in (_BASE, _OTHER_BASE))
                head = _first_of_equal([second, first], x.doc[r])
                done = x.doc[r] > x.doc[r][head]
                start = x.at[r] - j
                covered[r, j] = done
                spans.append(_extent(x, covered, depth))  # one span an entry, not one a window
                keep = np.nonzero(~done)[0]
                shard = shard_of(first[keep], shards)
                order = keep[np.argsort(shard, kind="stable")]
                ends = np.searchsorted(np.sort(shard), np.arange(shards + 1))
                for s in np.nonzero(np.diff(ends))[0]:
                    i = order[ends[s] : ends[s + 1]]
                    yield (int(s), _WINDOWS, squeezed(np.concatenate([x.doc[r[i]].view(U64), x.text[r[i]].view(U64)])), squeezed(start[i].view(U64)), squeezed(np.concatenate([first[i], second[i]])))

        def span_blocks(spans: list) -> Iterator[tuple]:
            doc, text, start, end = _joined(*(np.concatenate(c) for c in zip(*spans, strict=True)))
            shard = _place_of(doc, text, shards)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.nonzero(np.diff(ends))[0]:
                i = order[ends[s] : ends[s + 1]]
                yield int(s), _SPANS, squeezed(np.concatenate([doc[i].view(U64), text[i].view(U64)])), squeezed(np.concatenate([start[i], end[i]]).view(U64)), b""

        for pdf in slices(frames, limit=CHUNK):
            joined, begin, at, h = anchors_of([utf8(t) for t in pdf["text"]], depth)
            hit = np.nonzero(known(arrays, shards, "repeated", h))[0]
            at, h = at[hit], h[hit]
            own = np.searchsorted(begin, at, side="right") - 1
            size = np.array([len(utf8(t)) for t in pdf["text"]], np.int64)
            place = at - begin[own]
            context = joined[at[:, None] + np.arange(-depth.slack, depth.window)]
            doc, text = pdf["key"].to_numpy(np.int64), pdf["text_hash"].to_numpy(np.int64)
            held.append(Entries(doc[own], text[own], place, np.minimum(place, depth.slack), np.minimum(size[own] - place, depth.window), h, context))
            pending += len(at)
            if pending > 200_000:
                yield from rows_of(blocks(), columns=_COLUMNS)
                held, pending = [], 0
        if pending:
            yield from rows_of(blocks(), columns=_COLUMNS)

    return docs.select("key", "text_hash", "text").mapInPandas(run, _BLOCKS)


def _extent(e: Entries, covered: np.ndarray | None, depth: Depth) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The spans of entries with a covered window (None: all windows of theirs)."""
    covered = e.windows(depth) if covered is None else covered
    some = np.nonzero(covered.any(axis=1))[0]
    e, covered = e.pick(some), covered[some]
    width = covered.shape[1]
    return e.span(width - 1 - covered[:, ::-1].argmax(axis=1), covered.argmax(axis=1), depth)


def covered_windows(e: Entries, depth: Depth) -> np.ndarray:
    """Which windows of entries, sorted by gram, also begin in a document of a smaller id.

    The bytes from the gram on are put in order through the window's end, and so are those before it, read backwards.
    Neighbours in either order tell how many bytes they share, so rows are of one class at a depth if no pair of
    neighbours between them shares less. The window that begins j bytes before the gram is equal in two rows if they
    are of one class j bytes to the left and window - j bytes to the right: bytes decide, a hash only brought them here.
    """
    ok, n = e.windows(depth), len(e.h)
    group = np.cumsum(np.concatenate([[0], (e.h[1:] != e.h[:-1]).astype(np.int64)])) if n else np.zeros(0, np.int64)
    right, right_shared = radix_order(e.context[:, depth.slack :], group)
    left, left_shared = radix_order(e.context[:, : depth.slack][:, ::-1], group)

    def classes(order: np.ndarray, shared: np.ndarray, at_least: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(shared < at_least)
        return out

    out = np.zeros(ok.shape, bool)
    for j in range(depth.slack + 1):
        r = np.nonzero(ok[:, j])[0]
        both = classes(right, right_shared, depth.window - j)[r] * (n + 1) + classes(left, left_shared, j)[r]
        out[r, j] = e.doc[r] > e.doc[r][_first_of_equal([both], e.doc[r])]
    return out


def _place_of(doc: np.ndarray, text: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a document's spans: copies of one text are dealt over all."""
    return shard_of(mix64(text.view(U64) ^ mix64(doc.view(U64))), shards)


def spans_of(docs: DataFrame, depth: Depth, crowd: int = 2_000) -> DataFrame:
    """``(key, text_hash, spans)`` of texts with bytes to remove; spans are pairs of long, in order, none touching.

    ``docs(key, text_hash, text)``: ``key`` orders the documents. Suffixes are taken at one gram of each window, which
    one depends on the window's bytes alone. The first pass brings equal grams together and drops those of one
    document; then what is left is put in order through the window's end, eight bytes a pass. The groups of equal
    windows are exactly the repeated ones.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 2 * parts  # a shard is held whole, so they are small
    size = docs.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0.0
    depth = replace(depth, bits=min(64, 8 + math.ceil(math.log2(2 + size / 8))))  # of 256 grams that occur once, one at most seems to repeat by chance, at any size
    folder = local_folder(spark, "suffixes")
    first_pass(docs, depth, folder, shards, crowd)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spans, entries, windows = [], [], []
        for pdf in frames:
            for kind, doc, at, more in zip(pdf["kind"], pdf["doc"], pdf["at"], pdf["more"], strict=True):
                d, t = opened(doc, "<i8").reshape(2, -1)
                if kind == _SPANS:
                    spans.append((d, t, *opened(at, "<i8").reshape(2, -1)))
                elif kind == _CONTEXTS:
                    p, sides, h = opened(at, "<u8").reshape(3, -1)
                    entries.append(Entries(d, t, p.astype(np.int64), (sides >> U64(32)).astype(np.int64), (sides & U64(0xFFFFFFFF)).astype(np.int64), h, opened(more, "|u1").reshape(len(d), -1)))
                else:
                    windows.append((d, t, opened(at, "<i8"), *opened(more, "<u8").reshape(2, -1)))
        if entries:
            e = Entries.join(entries)
            entries.clear()
            order = np.argsort(e.h, kind="stable")
            h = e.h[order]
            cuts = np.concatenate([np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0], [len(h)]])
            lo = 0
            while lo < len(h):  # whole groups, some thousands of rows at a time
                hi = int(cuts[max(np.searchsorted(cuts, lo + 10_000, side="right") - 1, np.searchsorted(cuts, lo, side="right"))])
                part = e.pick(order[lo:hi])
                spans.append(_extent(part, covered_windows(part, depth), depth))
                lo = hi
        if windows:
            d, t, start, first, second = (np.concatenate(c) for c in zip(*windows, strict=True))
            done = d > d[_first_of_equal([second, first], d)]
            spans.append((d[done], t[done], start[done], start[done] + depth.window))
        if spans:
            d, t, a, b = _joined(*(np.concatenate(c) for c in zip(*spans, strict=True)))
            to = _place_of(d, t, parts)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(parts + 1))
            blobs = ((int(s), squeezed(np.concatenate([d[i], t[i]]).view(U64)), squeezed(np.concatenate([a[i], b[i]]).view(U64))) for s in np.nonzero(np.diff(ends))[0] for i in (order[ends[s] : ends[s + 1]],))
            yield from rows_of(blobs, columns=("shard", "doc", "at"))

    def by_text(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(*opened(doc, "<i8").reshape(2, -1), *opened(at, "<i8").reshape(2, -1)) for pdf in frames for doc, at in zip(pdf["doc"], pdf["at"], strict=True)]
        if not held:
            return
        d, t, a, b = _joined(*(np.concatenate(c) for c in zip(*held, strict=True)))
        first = np.nonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))[0]
        ends, spans = np.append(first[1:], len(d)), np.stack([a, b], axis=1)
        for lo in range(0, len(first), 5000):
            i = range(lo, min(lo + 5000, len(first)))
            yield pd.DataFrame({"key": d[first[lo : lo + 5000]], "text_hash": t[first[lo : lo + 5000]], "spans": [spans[first[x] : ends[x]].tobytes() for x in i]})

    blocks = second_pass(docs, depth, folder, shards).repartitionById(shards, F.col("shard"))
    found = blocks.mapInPandas(merge, "shard int, doc binary, at binary").repartitionById(parts, F.col("shard"))
    return found.mapInPandas(by_text, "key long, text_hash long, spans binary")


def _joined(doc: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans in order of document, text and start; those of one text that touch are made one."""
    order = np.lexsort((a, text, doc))
    doc, text, a, b = doc[order], text[order], a[order], b[order]
    if not len(a):
        return doc, text, a, b
    own = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
    far = (np.cumsum(own) - 1) * (int(b.max()) + 2)  # so that no span reaches the next text's
    reach = np.maximum.accumulate(b + far)
    at = np.nonzero(np.concatenate([[True], (a + far)[1:] > reach[:-1]]))[0]
    last = np.append(at[1:], len(a)) - 1
    return doc[at], text[at], a[at], (reach - far)[last]


def _all_spans(spans: bytes | None) -> np.ndarray:
    return np.zeros((0, 2), np.int64) if spans is None else np.frombuffer(spans, np.int64).reshape(-1, 2)


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _whole_characters(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans drawn in to the borders of characters."""
    out = []
    for a, b in spans.tolist():
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _with_spans(docs: DataFrame, keep: list[str], depth: Depth) -> DataFrame:
    """Columns ``keep`` as c_0, c_1, ..., the text (null or not) once, and its spans."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(keep)], F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), "text", F.xxhash64(whole).alias("text_hash"))
    return rows.join(spans_of(rows.select("key", "text_hash", F.coalesce("text", F.lit("")).alias("text")), depth), ["key", "text_hash"], "left")


def removals(docs: DataFrame, window: int = 50, gram: int = 24) -> DataFrame:
    """What goes from each text, as UTF-8 bytes (null: empty): every byte that a repeated window covers.

    A window is repeated if it also begins in a document of a smaller id, overlaps included, judged on the
    input. Null ids come after all others; rows that share an id don't count as smaller for one another. Texts of any
    length are read whole; other columns are ignored; an empty table gives an empty result.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(frames):
            raws = [utf8(t or "") for t in pdf["text"]]
            spans = [_all_spans(p) for p in pdf["spans"]]
            yield pd.DataFrame({
                "doc_id": pdf["c_0"].astype("Int64"), "n_bytes": [len(r) for r in raws], "n_removed": [int((s[:, 1] - s[:, 0]).sum()) for s in spans],
                "n_spans": [len(s) for s in spans], "kept_sha256": [hashlib.sha256(_kept(r, s)).hexdigest() for r, s in zip(raws, spans)],
            })

    return _with_spans(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], Depth(window, gram)).mapInPandas(run, REMOVAL_SCHEMA)


def deduplicate(docs: DataFrame, window: int = 50, gram: int = 24) -> DataFrame:
    """``docs`` with the removed bytes gone from ``text`` (a character goes only as a whole); null texts stay null.

    Other columns are as they were.
    """
    others = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(frames):
            texts = []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                if text is not None and spans is not None:
                    raw = utf8(text)
                    text = _kept(raw, _whole_characters(raw, _all_spans(spans))).decode("utf-8", "surrogatepass")
                texts.append(text)
            yield pdf[[f"c_{i}" for i in range(len(others))]].assign(text=texts)

    schema = ", ".join([*(f"c_{i} {kinds[c]}" for i, c in enumerate(others)), "text string"])
    return _with_spans(docs, others, Depth(window, gram)).mapInPandas(run, schema).toDF(*others, "text").select(*docs.columns)
