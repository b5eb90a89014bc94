"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie, with byte fallback."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgrain.llm.common import U64, mix64, texts, utf8

UNKNOWN_PENALTY = 10.0
NORMAL, USER_DEFINED, BYTE = 1, 4, 6  # piece types of the model format
MARK = "▁"  # stands for a blank within pieces
ENCODED_SCHEMA = "doc_id long, ids array<int>, n_ids int, n_byte_pieces int, log_score double, decoded_sha256 string, round_trip boolean"


class DoubleArray:
    """A trie over bytes: the child of node s by byte c is ``t = base[s] + c + 1`` if ``check[t] == s``."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in zip(keys, values, strict=True):
            at = 0
            for c in key:
                to = children[at].get(c)
                if to is None:
                    to = children[at][c] = len(children)
                    children.append({})
                at = to
            ends[at] = value
        window = 4096
        size = 4 * len(children) + 64 * window
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[:258] = False  # a base is never negative
        place, queue = {0: 0}, [0]
        one, many = 258, 258  # where to look on: for nodes with one child, with several
        for node in queue:  # breadth first; queue grows
            kids = children[node]
            if not kids:
                continue
            codes = np.fromiter(kids, np.int64, len(kids)) + 1
            if len(codes) == 1:
                while not free[one]:
                    one += 1
                base = one - int(codes[0])
            else:
                while True:
                    bases = many + np.arange(window) - int(codes.min())
                    ok = free[bases + codes[0]].copy()
                    for c in codes[1:]:
                        ok &= free[bases + c]
                    if ok.any():
                        base = int(bases[ok.argmax()])
                        break
                    many += window  # what is left here goes to single children
            self.base[place[node]] = base
            for c, kid in kids.items():
                at = base + c + 1
                free[at] = False
                self.check[at] = place[node]
                self.value[at] = ends.get(kid, -1)
                place[kid] = at
                queue.append(kid)
        size = int(np.nonzero(self.check >= 0)[0].max(initial=0)) + 258  # any child of any node stays inside
        self.base, self.check, self.value = self.base[:size].copy(), self.check[:size].copy(), self.value[:size].copy()

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child nodes, -1 where there is none."""
        to = np.minimum(self.base[node] + byte + 1, len(self.check) - 1)
        return np.where(self.check[to] == node, to, -1)


@dataclass
class Vocabulary:
    """Pieces with log scores. In ``surface`` a blank stands for the white-space mark and byte pieces are their byte."""

    surface: list[bytes]
    score: np.ndarray
    kind: np.ndarray
    add_dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a SentencePiece model file; its scores are taken as the pieces' log scores, whatever trained it."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = np.array([p.type for p in model.pieces], np.int32)
        surface = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else utf8(p.piece.replace(MARK, " ")) for p in model.pieces]
        return cls(surface, np.array([p.score for p in model.pieces]), kind, model.normalizer_spec.add_dummy_prefix)


class Unigram:
    """Encoder and decoder. Texts are cut into units at the start of each run of blanks (no piece of the
    vocabulary crosses such a place, else a text is one unit); equal units of a batch are solved once."""

    WIDE = 64  # longer units are solved one at a time

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        used = [i for i, k in enumerate(v.kind) if k in (NORMAL, USER_DEFINED) and v.surface[i]]
        self.v, self.trie = v, DoubleArray([v.surface[i] for i in used], used)
        self.unknown = float(v.score[used].min()) - UNKNOWN_PENALTY if used else -UNKNOWN_PENALTY
        self.byte_id = np.full(256, -1, np.int32)
        for i in np.nonzero(v.kind == BYTE)[0]:
            self.byte_id[v.surface[i][0]] = i
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks byte pieces")
        self.crosses = any(a != 32 and b == 32 for i in used for a, b in zip(v.surface[i], v.surface[i][1:]))
        self.flat = np.frombuffer(b"".join(v.surface), np.uint8)
        self.size = np.array([len(s) for s in v.surface], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]

    def _prepared(self, text: str) -> bytes:
        raw = utf8(text.replace(MARK, " "))
        return b" " + raw if self.v.add_dummy_prefix and raw else raw

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end, log score of each text)."""
        raws = [self._prepared(t) for t in batch]
        lens = np.array([len(r) for r in raws], np.int64)
        buf = np.frombuffer(b"".join(raws), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lens)])
        cut = np.zeros(len(buf) + 1, bool)
        cut[begin] = True
        if not self.crosses and len(buf):
            cut[1:-1] |= (buf[1:] == 32) & (buf[:-1] != 32)
        edges = np.nonzero(cut)[0]
        start, end = edges[:-1], edges[1:]
        kept, inverse = self._distinct(buf, start, end)
        ids, where, score = self._solve(buf, start[kept], end[kept])
        count = np.diff(where)[inverse]
        out = ids[_ranges(where[inverse], count)]
        ends = np.concatenate([[0], np.cumsum(count)])
        unit = np.searchsorted(start, begin)
        return out, ends[unit], np.diff(np.concatenate([[0.0], np.cumsum(score[inverse])])[unit])

    def _distinct(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representatives of equal units and, for each unit, its representative's number; compared byte by byte."""
        h = _unit_hashes(buf, start, end)
        _, kept, inverse = np.unique(h, return_index=True, return_inverse=True)
        same = _equal_units(buf, start, end, kept[inverse])
        odd = np.nonzero(~same)[0]
        if len(odd):  # two units share a hash: they go by themselves
            inverse = inverse.copy()
            inverse[odd] = len(kept) + np.arange(len(odd))
            kept = np.concatenate([kept, odd])
        return kept, inverse

    def _solve(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = end - start
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.zeros(len(start))
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order) and size[order[lo]] <= self.WIDE:
            width = int(size[order[lo]])
            hi = int(np.searchsorted(size[order], max(width, min(width + width // 4, self.WIDE)), side="right"))
            hi = min(hi, lo + 50_000)
            some = order[lo:hi]
            ids, count, score[some] = self._viterbi(buf, start[some], size[some])
            parts.append((some, ids, count))
            lo = hi
        for i in order[lo:]:
            ids, score[i] = self._viterbi_one(buf[start[i] : end[i]])
            parts.append((np.array([i]), ids, np.array([len(ids)])))
        count = np.zeros(len(start), np.int64)
        for some, _, n in parts:
            count[some] = n
        where = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(where[-1], np.int32)
        for some, ids, n in parts:
            out[_ranges(where[some], n)] = ids
        return out, where, score

    def _viterbi(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All units at once, one start place after another; the earlier start wins a tie."""
        n, width = len(start), int(size.max())
        place = np.minimum(start[:, None] + np.arange(width + 4), len(buf) - 1)
        text = buf[place].astype(np.int32)
        text[np.arange(width + 4) >= size[:, None]] = 0
        inside = (text & 0xC0) == 0x80
        best = np.full((n, width + 5), -np.inf)
        best[:, 0] = 0
        back_id = np.empty((n, width + 5), np.int32)
        back_id[:, 1:] = self.byte_id[text]
        back_len = np.ones((n, width + 5), np.int32)
        value, score = self.trie.value, self.v.score
        for i in range(width):
            rows = np.nonzero((size > i) & ~inside[:, i])[0]
            if not len(rows):
                continue
            char = 1 + inside[rows, i + 1] * (1 + inside[rows, i + 2] * (1 + inside[rows, i + 3].astype(np.int64)))
            char = np.minimum(char, size[rows] - i)
            single = np.zeros(n, bool)
            char_of = np.zeros(n, np.int64)
            char_of[rows] = char
            live, node, t = rows, np.zeros(len(rows), np.int32), 0
            while len(live) and i + t < width:
                node = self.trie.step(node, text[live, i + t])
                ok = (node >= 0) & (size[live] > i + t)
                live, node = live[ok], node[ok]
                t += 1
                piece = value[node]
                hit = piece >= 0
                if hit.any():
                    who, what = live[hit], piece[hit]
                    single[who[char_of[who] == t]] = True
                    total = best[who, i] + score[what]
                    better = total > best[who, i + t]
                    who, what = who[better], what[better]
                    best[who, i + t] = total[better]
                    back_id[who, i + t] = what
                    back_len[who, i + t] = t
            lone = rows[~single[rows]]
            if len(lone):
                to = i + char_of[lone]
                total = best[lone, i] + self.unknown
                better = total > best[lone, to]
                who, to = lone[better], to[better]
                best[who, to] = total[better]
                back_id[who, to] = self.byte_id[text[who, to - 1]]  # the bytes before it lead back one by one
                back_len[who, to] = 1
        at, alive, steps = size.astype(np.int64).copy(), np.arange(n), []
        while len(alive):
            steps.append((alive, back_id[alive, at[alive]]))
            at[alive] -= back_len[alive, at[alive]]
            alive = alive[at[alive] > 0]
        who, what = np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])
        turn = np.concatenate([np.full(len(s[0]), k) for k, s in enumerate(steps)])
        order = np.lexsort((-turn, who))
        return what[order], np.bincount(who, minlength=n), best[np.arange(n), size]

    def _viterbi_one(self, raw: np.ndarray) -> tuple[np.ndarray, float]:
        """The same for one long unit, in plain Python over the same trie."""
        text, n = raw.tobytes(), len(raw)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.v.score
        best, back, came = array("d", [-np.inf]) * (n + 1), array("i", [0]) * (n + 1), array("q", [0]) * (n + 1)  # 20 bytes a byte of text
        best[0] = 0.0
        for i in range(n):
            if text[i] & 0xC0 == 0x80:
                continue
            char = 1
            while char < 4 and i + char < n and text[i + char] & 0xC0 == 0x80:
                char += 1
            node, single, here = 0, False, best[i]
            for k in range(i, n):
                to = int(base[node]) + text[k] + 1
                if check[to] != node:
                    break
                node = to
                piece = int(value[node])
                if piece >= 0:
                    single = single or k + 1 - i == char
                    total = here + float(score[piece])
                    if total > best[k + 1]:
                        best[k + 1], back[k + 1], came[k + 1] = total, piece, i
            if not single and here + self.unknown > best[i + char]:
                best[i + char], back[i + char], came[i + char] = here + self.unknown, -1, i
        out, at = [], n
        while at > 0:
            piece, frm = back[at], came[at]
            out += [piece] if piece >= 0 else [int(self.byte_id[b]) for b in reversed(text[frm:at])]
            at = frm
        return np.array(out[::-1], np.int32), best[n]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes ids stand for, without the dummy prefix; control and unknown pieces stand for nothing."""
        ids = ids[np.isin(self.v.kind[ids], (NORMAL, USER_DEFINED, BYTE))]
        raw = self.flat[_ranges(self.at[ids], self.size[ids])].tobytes()
        return raw[1:] if self.v.add_dummy_prefix and raw[:1] == b" " else raw

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each of the counts, joined."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def _words8(buf: np.ndarray) -> np.ndarray:
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(buf) + 1, 8), (1, 1))


def _chunk(w: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(w[at]).view(U64).ravel()
    keep = np.minimum(rest, 8).astype(U64)
    return np.where(keep == 8, x, x & ((U64(1) << (keep * U64(8))) - U64(1)))


def _unit_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    w, size, k = _words8(buf), end - start, 0
    out, live = size.astype(U64), np.arange(len(start))
    while len(live):
        out[live] = mix64(out[live] * U64(0x9E3779B97F4A7C15) + _chunk(w, start[live] + k, size[live] - k))
        k += 8
        live = live[size[live] > k]
    return out


def _equal_units(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    w, size, k = _words8(buf), end - start, 0
    same = size == size[other]
    live = np.nonzero(same)[0]
    while len(live):
        rest = size[live] - k
        same[live] &= _chunk(w, start[live] + k, rest) == _chunk(w, start[other[live]] + k, rest)
        k += 8
        live = live[(rest > 8) & same[live]]
    return same


def _batches(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(np.fromiter((len(t) for t in batch.column("text").to_pylist()), np.int64, batch.num_rows))
    at, base = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at, base = to, int(ends[to - 1])


def encode_documents(docs: DataFrame, model: str, limit: int = 3_000_000) -> DataFrame:
    """Encode every whole text and decode it again.

    ``round_trip`` says that decoding gave the text back; it can't for texts that hold the white-space mark
    itself, which decodes as a blank. Null texts are empty and have no ids; null ids and repeated rows stay; texts of
    any length are encoded whole; other columns are ignored; an empty table gives an empty result. Work is per batch of ``limit``
    characters, so memory doesn't grow with the table; the vocabulary (fixed size) goes with the function.
    """
    coder = Unigram(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _batches(batch, limit):
                part = batch.slice(a, b - a)
                text = part.column("text").to_pylist()
                ids, ends, score = coder.encode(text)
                is_byte = np.concatenate([[0], np.cumsum(coder.v.kind[ids] == BYTE)])
                sha, back = [], []
                for i, t in enumerate(text):
                    raw = coder.decode_bytes(ids[ends[i] : ends[i + 1]])
                    sha.append(hashlib.sha256(raw).hexdigest())
                    back.append(raw == utf8(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(np.diff(ends).astype(np.int32)),
                        pa.array(np.diff(is_byte[ends]).astype(np.int32)), pa.array(score), pa.array(sha), pa.array(back),
                    ],
                    ["doc_id", "ids", "n_ids", "n_byte_pieces", "log_score", "decoded_sha256", "round_trip"],
                )

    return texts(docs).mapInArrow(run, ENCODED_SCHEMA)
