"""Approximate nearest neighbours: one navigable small-world hierarchy per shard, results merged.

A shard's graph is flat neighbour arrays, one per layer. Inner product becomes a metric
by one more coordinate that gives all vectors of a shard the same norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARD_ROWS, QUERY_ROWS, PART_BLOCKS = 8192, 4096, 8
LINKS, BUILD, EF, EXPAND = 32, 96, 128, 4


class Graph:
    """Layers from 0 up: member rows (ascending) and, per member, neighbour rows padded with -1."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = 42):
        x = vectors.astype(np.float32)
        norm = (x.astype(np.float64) ** 2).sum(1)
        self.x = np.concatenate([x, np.sqrt(np.maximum(0, norm.max() - norm)).astype(np.float32)[:, None]], 1)
        n = len(x)
        level = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links / 2)).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(level.max() + 1):
            rows = np.flatnonzero(level >= k)
            self.layers.append((rows, self._linked(rows, links if k == 0 else links // 2, build)))

    def _linked(self, rows: np.ndarray, links: int, build: int) -> np.ndarray:
        """Diverse nearest neighbours of each member, and the links back. The shard's size bounds the work."""
        n, x = len(rows), self.x[rows]
        c = min(build, n - 1)
        out = np.full((n, links), -1, np.int32)
        if c < 1:
            return out
        near = np.empty((n, c), np.int32)
        for s in range(0, n, 512):
            sim = x[s : s + 512] @ x.T
            sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
            top = np.argpartition(-sim, c - 1, 1)[:, :c]
            near[s : s + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), 1, "stable"), 1)
        keep = np.zeros((n, c), bool)
        for s in range(0, n, 256):
            v = x[near[s : s + 256]]
            own = np.einsum("nd,ncd->nc", x[s : s + 256], v)
            between = np.einsum("ncd,nkd->nck", v, v)
            taken = np.zeros(own.shape, bool)
            for j in range(c):  # farther from all taken ones than from the point itself
                rival = np.where(taken, between[:, j], -np.inf).max(1)
                taken[:, j] = (rival < own[:, j]) & (taken.sum(1) < links // 2 + 2)
            keep[s : s + 256] = taken
        a, j = np.nonzero(keep)
        b = near[a, j]
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        sim = np.einsum("nd,nd->n", x[src], x[dst])
        order = np.lexsort((-sim, src))
        src, dst = src[order], dst[order]
        new = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
        src, dst = src[new], dst[new]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        ok = place < links
        out[src[ok], place[ok]] = rows[dst[ok]]
        spare = (out < 0)
        fill = spare.any(1)
        if fill.any():  # free places take the nearest
            for i in np.flatnonzero(fill):
                have = set(out[i][out[i] >= 0].tolist())
                extra = [r for r in rows[near[i]].tolist() if r not in have][: int(spare[i].sum())]
                out[i, links - int(spare[i].sum()) : links - int(spare[i].sum()) + len(extra)] = extra
        return out

    def search(self, queries: np.ndarray, ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
        """Rows found (padded with -1) and their inner products, for queries in blocks."""
        q = np.concatenate([queries.astype(np.float32), np.zeros((len(queries), 1), np.float32)], 1)
        parts = [self._search(q[s : s + 256], min(ef, len(self.x))) for s in range(0, len(q), 256)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _sims(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        sim = np.matmul(self.x[rows], q[:, :, None])[:, :, 0]
        sim[rows < 0] = -np.inf
        return sim

    def _search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        m, all_rows = len(q), np.arange(len(q))
        cur = np.full(m, self.layers[-1][0][0])
        best = np.einsum("nd,nd->n", q, self.x[cur])
        for rows, nb in self.layers[:0:-1]:
            live = all_rows
            while len(live):
                near = nb[np.searchsorted(rows, cur[live])]
                sim = self._sims(q[live], near)
                top = sim.argmax(1)
                val = sim[np.arange(len(live)), top]
                up = val > best[live]
                live, top, val, near = live[up], top[up], val[up], near[up]
                cur[live], best[live] = near[np.arange(len(live)), top], val
        ids = np.full((m, ef), -1, np.int64)
        sims = np.full((m, ef), -np.inf, np.float32)
        done = np.ones((m, ef), bool)
        seen = np.zeros((m, len(self.x) + 1), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = cur, best, False
        seen[all_rows, cur] = True
        nb, live = self.layers[0][1], all_rows
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            k = min(EXPAND, ef)
            at = np.argpartition(-open_, k - 1, 1)[:, :k]
            ok = np.take_along_axis(open_, at, 1) > -np.inf
            go = ok.any(1)
            live, at, ok = live[go], at[go], ok[go]
            if not len(live):
                break
            done[live[:, None], at] = True
            grown = np.where(ok[:, :, None], nb[ids[live[:, None], at]], -1).reshape(len(live), -1)
            grown.sort(1)
            grown[:, 1:][grown[:, 1:] == grown[:, :-1]] = -1
            grown[seen[live[:, None], grown]] = -1
            seen[live[:, None], grown] = True
            seen[:, -1] = False
            s = np.concatenate([sims[live], self._sims(q[live], grown)], 1)
            i = np.concatenate([ids[live], grown], 1)
            d = np.concatenate([done[live], grown < 0], 1)
            top = np.argpartition(-s, ef - 1, 1)[:, :ef]
            sims[live], ids[live], done[live] = (np.take_along_axis(y, top, 1) for y in (s, i, d))
        return ids, sims

    def packed(self) -> tuple[bytes, list[bytes], list[bytes]]:
        return self.x.tobytes(), [r.astype(np.int32).tobytes() for r, _ in self.layers], [n.tobytes() for _, n in self.layers]

    @classmethod
    def unpacked(cls, n: int, x: bytes, rows: list[bytes], links: list[bytes]) -> Graph:
        out = cls.__new__(cls)
        out.x = np.frombuffer(x, np.float32).reshape(n, -1)
        out.layers = []
        for r, b in zip(rows, links, strict=True):
            r = np.frombuffer(r, np.int32)
            out.layers.append((r, np.frombuffer(b, np.int32).reshape(len(r), -1)))
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that isn't null, empty or zero and has only finite components."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.cast("array<float>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))


def search(vectors: DataFrame, is_query, k: int = 20, ef: int = EF, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest ``k`` found for every row where ``is_query`` holds.

    Equal vectors are indexed once with their k + 1 smallest ids, which is all
    that any answer can hold, so a vector that many rows share fills no shard. Repeated rows of an
    id are rows of their own. Vectors of other lengths than the query's aren't candidates.
    """
    # One representation of zero, so that equal vectors are equal keys.
    rows = usable(vectors).withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x)))
    own = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= k + 1)
    unique = materialise(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    n = unique.count()
    shards = max(1, -(-n // shard_rows))
    dealt = unique.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")).withColumn("dim", F.size("embedding"))

    def build(pdf):
        import pandas as pd

        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
        packed, layer_rows, links = Graph(x).packed()
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [x.shape[1]], "n": [len(x)], "x": [packed], "rows": [layer_rows], "links": [links], "ids": [pdf["ids"].tolist()]})

    index = materialise(dealt.groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, n int, x binary, rows array<binary>, links array<binary>, ids array<array<bigint>>"), "hnsw")
    asked = rows.where(is_query).distinct().withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    packs = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    packs = packs.select("dim", F.col("queries.vec_id").alias("query_ids"), F.flatten(F.col("queries.embedding")).alias("q")).repartition(-(-blocks // PART_BLOCKS))
    # Parts of the index meet parts of the queries where these are read. Copies of the queries for all
    # shards are never made: Spark takes such copies for as small as the queries and broadcasts them.
    jobs = index.join(packs.hint("shuffle_replicate_nl"), "dim").select("dim", "n", "x", "rows", "links", "ids", "query_ids", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim, n, x, layer_rows, links, ids, query_ids = (b.column(i)[r].as_py() for i in range(7))
                q = b.column(7)[r].values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(query_ids), dim)
                g = Graph.unpacked(n, x, layer_rows, links)
                found, _ = g.search(q, max(ef, k + 1))
                exact = np.einsum("qkd,qd->qk", g.x[found][:, :, :dim].astype(np.float64), q.astype(np.float64)) if len(q) * found.shape[1] < 400_000 else np.stack(
                    [g.x[f][:, :dim].astype(np.float64) @ v for f, v in zip(found, q.astype(np.float64), strict=True)])
                exact[found < 0] = -np.inf
                out = []
                for query, f, s in zip(query_ids, found, exact, strict=True):
                    own, kept, took = False, 0, []
                    for i in np.argsort(-s, kind="stable"):
                        if f[i] < 0 or (kept > k and s[i] < took[-1][2]):
                            break
                        for v in ids[f[i]]:
                            if v == query and not own:
                                own = True
                                continue
                            took.append((query, v, float(s[i])))
                            kept += 1
                    took.sort(key=lambda t: (-t[2], t[1]))
                    out += took[:k]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = jobs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
