"""Exact top-k search by vector-approximation files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.blocks import Mapped, fill_absent, local_folder, save
from loomgrain.llm.common import give_back

RESULT_SCHEMA = "query_id long, vec_id long, score long, size double"
HUGE = float(np.finfo(np.float64).max)
AT_ONCE = 256  # queries whose bounds are held at once


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x array<double>)`` without null ids and vectors that are null, empty or hold a null or non-finite component."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def integers(x: pd.Series, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * component), as doubles; shorter vectors end in zeros. What leaves the range of doubles counts as its end."""
    out = np.zeros((len(x), width))
    lengths = np.array([len(v) for v in x])
    out[np.arange(width) < lengths[:, None]] = np.concatenate(x.to_list()) if len(x) else 0
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -HUGE, HUGE) + 0.0  # no negative zero: equal vectors have equal bytes


class Cells:
    """For each component 256 equal cells of whole numbers over [low, high]: a value lies in [low + code * width, low + (code + 1) * width - 1]."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high
        self.width = np.maximum(1.0, np.ceil((high / 256 - low / 256) + 1 / 256))
        size = np.maximum(np.abs(low), np.abs(high))
        with np.errstate(over="ignore"):
            self.most = float((size * size).sum())  # no inner product is larger
        self.size = size

    def codes(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor((v - self.low) / self.width), 0, 255).astype(np.uint8)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights, base, gap) of queries: an upper bound is weights @ codes + base, the lower one is less by the gap.

        Doubles give small products exactly; beyond that the bounds are widened by more than what rounding can take,
        and products past the range of doubles are not bounded at all.
        """
        if not np.isfinite(8 * self.most):
            return np.zeros(q.shape), np.full(len(q), HUGE), np.full(len(q), np.inf)
        reach = self.width - 1
        slack = np.zeros(len(q)) if self.most < 2**50 else np.abs(q) @ (2 * self.size + self.width) * 1e-12 + np.abs(q) @ self.width
        return q * self.width, q @ self.low + np.maximum(q, 0) @ reach + slack, np.abs(q) @ reach + 2 * slack

    def scores(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles, in 64-bit integers or in whole numbers of any size."""
        if self.most < 2**53:
            return v @ q
        if self.most < 2**62:
            return v.astype(np.int64) @ q.astype(np.int64)
        whole = [int(c) for c in q]
        return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in v.tolist()], object)


def near(score: float | int) -> float:
    """An exact score as a double, within the range of doubles."""
    return float(score) if abs(score) <= int(HUGE) else math.copysign(HUGE, score > 0 or -1)


class Search:
    """A batch of queries against all blocks: bounds from the cells first, then exact vectors in order of their bound.

    ``top`` holds each query's k largest upper bounds so far. A vector can only count if its upper bound
    reaches the kth of them less the gap, the kth lower bound. Exact vectors are read best bound first, in growing
    runs, until the kth exact score is above every bound left; vectors whose bound equals it are read too, so ties go to
    the smaller id. If so many bounds are tied that they fill ``room``, those are settled before the scan goes on.
    """

    def __init__(self, files: Mapped, cells: Cells, ids: np.ndarray, q: np.ndarray, k: int, room: int = 2_000_000):
        self.files, self.cells, self.ids, self.q, self.k, self.room = files, cells, ids, q, k, room
        self.weights, self.base, self.gap = cells.bounds(q)
        self.top = np.full((len(q), k), -np.inf)
        self.found: list[list[tuple]] = [[] for _ in q]  # (score, id), best first
        self.pending: list[tuple[np.ndarray, ...]] = []  # query, block, row, upper bound
        self.held = 0

    def floor(self) -> np.ndarray:
        """What an upper bound must reach."""
        floor = self.top[:, -1] - self.gap
        exact = np.array([near(f[-1][0]) if len(f) == self.k else -np.inf for f in self.found])
        return np.maximum(floor, np.where(np.isfinite(exact), exact - np.abs(exact) * 1e-15, exact) if self.cells.most >= 2**50 else exact)

    def scan(self, block: int, codes: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> None:
        upper = self.weights @ codes.T + self.base[:, None]
        own = np.nonzero((least[None, :] == greatest[None, :]) & (least[None, :] == self.ids[:, None]))
        upper[own] = -np.inf
        best = np.concatenate([self.top, upper if upper.shape[1] <= self.k else np.partition(upper, upper.shape[1] - self.k, axis=1)[:, -self.k :]], axis=1)
        self.top = -np.sort(-best, axis=1)[:, : self.k]
        last = np.array([f[-1][1] if len(f) == self.k else 2**63 - 1 for f in self.found])
        exact = np.array([near(f[-1][0]) if len(f) == self.k else -np.inf for f in self.found])
        wanted = (upper >= self.floor()[:, None]) & np.isfinite(upper)
        if self.cells.most < 2**50:  # a bound that only equals the kth score needs a smaller id
            wanted &= (upper > exact[:, None]) | (least[None, :] < last[:, None])
        i, row = np.nonzero(wanted)
        self.pending.append((i, np.full(len(i), block), row, upper[i, row]))
        self.held += len(i)
        if self.held > self.room:
            self.prune()
            if self.held > self.room // 2:
                self.settle()

    def prune(self) -> None:
        i, block, row, upper = (np.concatenate(c) for c in zip(*self.pending, strict=True))
        live = upper >= self.floor()[i]
        self.pending = [(i[live], block[live], row[live], upper[live])]
        self.held = int(live.sum())

    def settle(self) -> None:
        if not self.pending:
            return
        self.prune()
        i, block, row, upper = self.pending[0]
        order = np.lexsort((-upper, i))
        ends = np.searchsorted(i[order], np.arange(len(self.q) + 1))
        for n in np.nonzero(np.diff(ends))[0]:
            mine = order[ends[n] : ends[n + 1]]
            self.read(int(n), block[mine], row[mine], upper[mine])
        self.pending, self.held = [], 0

    def read(self, n: int, block: np.ndarray, row: np.ndarray, upper: np.ndarray) -> None:
        at, run = 0, 4 * self.k
        while at < len(row):
            hits = self.found[n]
            for b in np.unique(block[at : at + run]):
                rows = np.sort(row[at : at + run][block[at : at + run] == b])
                score = self.cells.scores(self.files[f"exact-{b}"][rows], self.q[n])
                ends, ids = self.files[f"ends-{b}"], self.files[f"ids-{b}"]
                for s, lo, hi in zip(score.tolist(), np.where(rows > 0, ends[rows - 1], 0).tolist(), ends[rows].tolist(), strict=True):
                    hits += [(s, x) for x in ids[lo:hi].tolist() if x != self.ids[n]]
            hits.sort(key=lambda p: (-p[0], p[1]))
            self.found[n] = hits[: self.k]
            at, run = at + run, run * 2
            if at < len(row) and len(self.found[n]) == self.k and near(self.found[n][-1][0]) > upper[at]:
                break


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block: int = 16_384, query_block: int = 2048, scale: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k largest inner products over all rows but those of its own id.

    Rows are dealt into blocks by their vector's hash, once; a block leaves its cells (one byte a component), exact
    vectors and ids as arrays in the shared folder. Queries are dealt into blocks too, and each reads the cells of all
    blocks and the few exact vectors its bounds ask for, so the shuffle is one row a vector and one a query.
    Equal vectors are one row with their ids: of an id's copies of a vector the first k can count, of a vector's rows
    the 2k of least id, so a vector that a third of the table repeats is one row, and so are its queries.
    Repeated rows count as often as they occur; the rows of a query id make one list. A shorter vector is multiplied
    over the components it has. Scores past 64 bits are returned as the end of the range, in the order of their doubles.
    Null ids and vectors that are null, empty or hold a null or non-finite component take no part; an empty table or one
    without queries gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    sized = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("x")).alias("width")).first()
    if not sized["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, n_rows, n_queries = sized["width"], -(-sized["n"] // block), -(-sized["q"] // query_block)
    n_queries = max(n_queries, min(sized["q"], int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def extent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for pdf in frames:
            if len(pdf):
                v = integers(pdf["x"], width, scale)
                low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        if np.isfinite(low).all():
            yield pd.DataFrame({"low": [low.tobytes()], "high": [high.tobytes()]})

    extents = rows.select("x").mapInPandas(extent, "low binary, high binary").collect()  # a row a task
    cells = Cells(np.min([np.frombuffer(r["low"]) for r in extents], axis=0), np.max([np.frombuffer(r["high"]) for r in extents], axis=0))
    folder = local_folder(spark, "vectors")

    def gathered(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids sorted within each group, groups), without what can't count: an id's copies from the k-th on, ids from the 2k-th on."""
        for most, keys in ((k, (ids, group)), (2 * k, (group,))):
            order = np.lexsort((ids, group))
            ids, group = ids[order], group[order]
            keys = [x[order] for x in keys] if len(keys) > 1 else [group]
            new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)])
            start = np.nonzero(new)[0]
            keep = np.arange(len(ids)) - start[np.cumsum(new) - 1] < most
            ids, group = ids[keep], group[keep]
        return ids, group

    def pack(ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """Distinct vectors with their ids."""
        kinds, group = np.unique(np.ascontiguousarray(v).view(f"V{8 * width}").ravel(), return_inverse=True)
        ids, group = gathered(ids, group.ravel())
        ends = np.searchsorted(group, np.arange(len(kinds) + 1))
        for i, raw in enumerate(kinds.tolist()):
            yield raw, ids[ends[i] : ends[i + 1]].tobytes()

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame(pack(pdf["vec_id"].to_numpy(np.int64), integers(pdf["x"], width, scale)), columns=["v", "ids"])

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, vs, ids = None, [], []

        def merged() -> None:
            each = [np.frombuffer(x, np.int64) for x in ids]
            got = list(pack(np.concatenate(each), np.repeat(np.frombuffer(b"".join(vs)).reshape(-1, width), [len(x) for x in each], axis=0)))
            vs[:], ids[:] = [g[0] for g in got], [g[1] for g in got]

        least = block
        for pdf in frames:
            if len(pdf):
                number = int(pdf["b"].iloc[0])
                vs += pdf["v"].tolist()
                ids += pdf["ids"].tolist()
                if len(vs) > 2 * least:  # copies of one vector meet a batch at a time
                    merged()
                    least = max(block, len(vs))
        if number is not None:
            merged()
            each = [np.frombuffer(x, np.int64) for x in ids]
            v = np.frombuffer(b"".join(vs)).reshape(-1, width)
            for name, x in (("code", cells.codes(v)), ("exact", v), ("ids", np.concatenate(each)), ("ends", np.cumsum([len(x) for x in each])), ("least", np.array([x[0] for x in each])), ("greatest", np.array([x[-1] for x in each]))):
                save(folder, f"{name}-{number}", x)
            yield pd.DataFrame({"b": [number]})
        give_back()

    hashed = rows.select("vec_id", "x").mapInPandas(deal, "v binary, ids binary").withColumn("b", F.pmod(F.xxhash64("v"), F.lit(n_rows)).cast("int"))
    done = {r["b"] for r in hashed.repartitionById(n_rows, F.col("b")).mapInPandas(keep, "b int").collect()}  # a row for each block
    none, one = np.zeros((0, width)), np.zeros(0, np.int64)
    fill_absent(folder, n_rows, done, ("code-{}", none.astype(np.uint8)), ("exact-{}", none), *((f"{n}-{{}}", one) for n in ("ids", "ends", "least", "greatest")))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = Mapped(folder)
        for pdf in frames:
            for lo in range(0, len(pdf), query_block):
                part = pdf.iloc[lo : lo + query_block]
                ids, q = part["vec_id"].to_numpy(np.int64), integers(part["x"], width, scale)
                batches = [Search(files, cells, ids[a : a + AT_ONCE], q[a : a + AT_ONCE], k) for a in range(0, len(ids), AT_ONCE)]
                for b in range(n_rows):
                    if len(files[f"least-{b}"]):
                        codes = files[f"code-{b}"].astype(np.float64)
                        for batch in batches:
                            batch.scan(b, codes, files[f"least-{b}"], files[f"greatest-{b}"])
                out = []
                for batch in batches:
                    batch.settle()
                    out += [[(int(i), x, max(-(2**63), min(2**63 - 1, int(s))), near(s)) for s, x in f] for i, f in zip(batch.ids, batch.found, strict=True)]
                yield pd.DataFrame([r for rows, t in zip(out, part["times"].tolist(), strict=True) for r in rows for _ in range(t)], columns=["query_id", "vec_id", "score", "size"])
        give_back()

    asked = rows.where("asks").groupBy("vec_id", "x").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    found = asked.repartition(n_queries, "vec_id", "x").mapInPandas(search, RESULT_SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
