"""Exact top-k inner products over norm-sorted vectors.

Every component x becomes floor(scale * x) as a whole number; the score is the whole-number inner
product. Both sides are packed into blocks of bounded size, written to the shared folder: candidates
(GROUP rows of one dimension) sorted by descending length, with the block's right singular vectors, and
queries (QUERY_BLOCK rows). Blocks meet blocks, as a stated query set asks: Spark broadcasts the query
blocks while they are under its own size limit and otherwise pairs the partitions of both sides, so
no more than one pair of blocks need be in a task and the driver holds none. Within a pair the
candidates are rotated, so that the first coordinates carry most of the length. For chunk after chunk, a
query is left out once its length times the chunk's longest length can't reach its k-th score; for the
others the first HEAD rotated coordinates give a partial sum, and by Cauchy-Schwarz the product of the
residual lengths bounds the rest. Only pairs whose bound reaches the k-th score are multiplied out
exactly. Each task keeps its best of each query it meets; a window ranks what the tasks kept.

Vectors that are null or empty, or that hold null or non-finite components, and rows without an id take
no part; vectors of different sizes don't meet. Ties go to the smaller id. With ``own``, queries are
rows of ``vectors`` and the query's own row alone is no candidate: an equal row, or another row of its
id, is one. A query that stands in several rows is answered once for each. Scores are exact while they
stay under 2**53; beyond that, whole-number arithmetic of any size is used and scores outside a long
become the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import stored

QUERY_BLOCK = 1024
GROUP = 8192
CHUNK = 1024
HEAD = 16
SAFE = float(2**53)


def _whole(column: pa.Array, ids: np.ndarray, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors that take part, by size: {dim: (ids, whole-number matrix as float64)}."""
    values = column.values
    offsets = column.offsets.to_numpy()
    flat = np.array(values.to_numpy(zero_copy_only=False), dtype=np.float64)  # null components become NaN
    sizes = np.diff(offsets)
    there = ~np.array(column.is_null().to_numpy(zero_copy_only=False), dtype=bool) & (sizes > 0)
    out = {}
    for dim in np.unique(sizes[there]).tolist():
        rows = np.flatnonzero(there & (sizes == dim))
        m = flat[offsets[rows][:, None] + np.arange(dim)[None, :]]
        good = np.isfinite(m).all(axis=1)
        out[dim] = (ids[rows[good]], np.floor(m[good] * scale))
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products of whole-number vectors, as Python ints if they may pass 2**53."""
    if len(q) and (np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1)).max() >= SAFE:
        exact = (sum(int(a) * int(b) for a, b in zip(u.tolist(), v.tolist())) for u, v in zip(q, x))
        return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], dtype=np.int64)
    return np.einsum("ij,ij->i", q, x).astype(np.int64)


class _Best:
    """k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.there = np.zeros((n, k), bool)

    def floor(self) -> np.ndarray:
        """k-th score of each query, minus infinity while it has fewer."""
        return np.where(self.there[:, -1], self.score[:, -1].astype(np.float64), -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
        for a, b in zip(first, np.r_[first[1:], len(q)] if len(q) else []):
            i, b = int(q[a]), min(b, a + self.k)
            s = np.concatenate([self.score[i][self.there[i]], score[a:b]])
            d = np.concatenate([self.id[i][self.there[i]], ids[a:b]])
            keep = np.lexsort((d, -s))[: self.k]
            self.score[i, : len(keep)], self.id[i, : len(keep)], self.there[i, : len(keep)] = s[keep], d[keep], True


class _Group:
    """A block of candidates, rotated once for all queries that meet it."""

    def __init__(self, dim: int, ids: bytes, x: bytes, basis: bytes) -> None:
        self.ids, self.x = np.frombuffer(ids, "<i8"), _matrix(x, dim)
        self.basis = np.frombuffer(basis, "<f8").reshape(dim, dim)
        self.head = min(HEAD, dim)
        rotated = self.x @ self.basis.T
        self.norm = np.linalg.norm(self.x, axis=1)
        self.first, self.rest = rotated[:, : self.head], np.linalg.norm(rotated[:, self.head :], axis=1)

    def search(self, q: np.ndarray, best: _Best) -> None:
        turned = q @ self.basis.T
        q_rest, q_norm = np.linalg.norm(turned[:, self.head :], axis=1), np.linalg.norm(q, axis=1)
        for at in range(0, len(self.x), CHUNK):
            floor = best.floor()
            slack = 1e-9 * q_norm * self.norm[at] + 1e-6  # rounding of the rotated sums
            live = np.flatnonzero(q_norm * self.norm[at] + slack >= floor)
            if not len(live):
                break
            part = slice(at, at + CHUNK)
            bound = turned[live, : self.head] @ self.first[part].T + np.outer(q_rest[live], self.rest[part])
            i, j = np.nonzero(bound + slack[live, None] >= floor[live, None])
            for a in range(0, len(i), 1 << 18):
                ia, ja = live[i[a : a + (1 << 18)]], j[a : a + (1 << 18)] + at
                best.add(ia, _exact(q[ia], self.x[ja]), self.ids[ja])


def _bytes(m: np.ndarray) -> bytes:
    """A whole-number matrix in the narrowest of three forms; the first byte tells which."""
    most = np.abs(m).max() if m.size else 0
    form = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return bytes([form]) + m.astype(("<i2", "<i4", "<f8")[form]).tobytes()


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, ("<i2", "<i4", "<f8")[raw[0]], offset=1).reshape(-1, dim).astype(np.float64)


def _blocks(rows: DataFrame, scale: int, size: int, candidates: bool) -> DataFrame:
    """Rows (id, v) as blocks (dim, ids, m[, basis]) of at most ``size`` rows; candidates by descending length."""
    names = ["dim", "ids", "m"] + ["basis"] * candidates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, m = (np.concatenate(x) for x in zip(*held.pop(dim)))
            out = [pa.array([dim], pa.int32())]
            if candidates:
                order = np.argsort(-np.linalg.norm(m, axis=1), kind="stable")
                ids, m = ids[order], m[order]
                unit = m / max(1.0, np.abs(m).max())  # the rotation has no need of the scale, whose squares might overflow
                _, _, basis = np.linalg.svd(unit.T @ unit)  # the right singular vectors of m
            out += [pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([_bytes(m)], pa.binary())]
            return pa.RecordBatch.from_arrays(out + ([pa.array([basis.astype("<f8").tobytes()], pa.binary())] if candidates else []), names)

        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                for dim, (ids, m) in _whole(part.column(1), part.column(0).to_numpy(zero_copy_only=False), scale).items():
                    if not len(ids):
                        continue
                    if sum(len(a) for a, _ in held.get(dim, ())) + len(ids) > size:
                        yield block(dim)
                    held.setdefault(dim, []).append((ids, m))
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, "dim int, ids binary, m binary" + ", basis binary" * candidates)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, key: str = "vec_id", value: str = "embedding", own: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row; ``own``: queries are rows of vectors."""
    pick = lambda df: df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{value}`").cast("array<double>").alias("v")).where("id is not null and v is not null")
    kept = k + own  # one more, since the query's own row is among the candidates
    groups = stored(_blocks(pick(vectors), scale, GROUP, True), "candidates", codec="none")
    # a query row is known by its block and its place there: both are written, so they stay the same when a task is run again
    asked = stored(_blocks(pick(queries), scale, QUERY_BLOCK, False), "queries", codec="none")
    asked = stored(asked.select(F.monotonically_increasing_id().alias("block"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("m").alias("q")), "queries", codec="none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, _Best]] = {}
        last, group = None, None
        for b in batches:
            for row in range(b.num_rows):
                dim, ids, m, basis, block, q_dim, q_ids, q = (c[row].as_py() for c in b.columns)
                if dim != q_dim:
                    continue
                if last != (ids, m):
                    last, group = (ids, m), _Group(dim, ids, m, basis)
                if block not in best:
                    qid = np.frombuffer(q_ids, "<i8")
                    best[block] = qid, _matrix(q, dim), _Best(len(qid), kept)
                group.search(best[block][1], best[block][2])
        for block, (qid, q, found) in best.items():
            i, j = np.nonzero(found.there)
            itself = _exact(q, q)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block)), pa.array(i), pa.array(qid[i]), pa.array(itself[i]), pa.array(found.id[i, j]), pa.array(found.score[i, j])], ["block", "place", "query_id", "itself", "vec_id", "score"])

    # blocks of the query set against blocks of all rows, never rows against rows; sizes are compared in the task, since a join on them would send all blocks of one size to it
    pairs = groups.crossJoin(asked).select("dim", "ids", "m", "basis", "block", "q_dim", "q_ids", "q")
    found = pairs.mapInArrow(run, "block long, place long, query_id long, itself long, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    query = Window.partitionBy("block", "place")
    found = found.withColumn("rank", F.row_number().over(query.orderBy(*order))).where(F.col("rank") <= kept)
    if own:
        # the first entry that equals the query's own row in id and score stands for it; entries beyond it move up
        mine = F.expr("vec_id = query_id and score = itself")
        at = F.coalesce(F.min(F.when(mine, F.col("rank"))).over(query), F.lit(kept))
        found = found.withColumn("at", at).where("rank <> at").withColumn("rank", F.expr("rank - if(rank > at, 1, 0)"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
