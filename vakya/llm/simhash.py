"""SimHash fingerprints and their exact linking by segment popcounts.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds their Hamming distance. The
segments are dealt into groups; fingerprints within d differing bits
agree on the counts of all but d groups, so they meet in a grid cell of
one of the choices of groups. Pairs of a cell are filtered by the Manhattan
distance and verified on the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise
from .components import connected

MAX_DISTANCE, GROUPS, SHINGLE = 4, 7, 4
#: A cell with more distinct fingerprints is compared in pairs of blocks of about this size.
BLOCK = 8192
_LOW = 0x5555555555555555
_BATCH = 400_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence where there are fewer words; none without words."""
    import xxhash

    ws = (text or "").encode("utf-8", "replace").lower().split()
    h = xxhash.xxh64_intdigest
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) <= shingle:
        return np.array([h(b" ".join(ws), 42)], np.uint64)
    buf = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    return np.array([h(buf[a:b], 42) for a, b in zip(starts, stops, strict=False)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is set if set in over half the hashes of all shingles, repeats included."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed long; zero for none."""
    if len(hashes) < 2:
        return int(hashes.astype(np.int64)[0]) if len(hashes) else 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every whole text; texts without words have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_masks(distance: int, groups: int) -> list[int]:
    """A mask for each choice of ``groups - distance`` groups of segments."""
    if not 0 <= distance < groups <= 32:
        raise ValueError("groups must exceed the distance and be at most 32")
    cuts = [round(32 * i / groups) for i in range(groups + 1)]
    own = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(own, groups - distance)]


def segment_counts(fp: Column) -> Column:
    """The embedding in one long: two bits for each segment's count of 0, 1 or 2."""
    a, b = fp.bitwiseAND(_LOW), F.shiftrightunsigned(fp, 1).bitwiseAND(_LOW)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _counts(x: np.ndarray) -> np.ndarray:
    a, b = x & np.uint64(_LOW), (x >> np.uint64(1)) & np.uint64(_LOW)
    return (a ^ b) | ((a & b) << np.uint64(1))


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings."""
    z = x ^ y
    low, high = z & np.uint64(_LOW), (z >> np.uint64(1)) & np.uint64(_LOW)
    return np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count(high & ~low).astype(np.int16)


def _near(x: np.ndarray, ex: np.ndarray, y: np.ndarray, ey: np.ndarray, distance: int) -> np.ndarray:
    ok = manhattan(ex, ey) <= distance
    ok[ok] = np.bitwise_count(np.broadcast_to(x, ok.shape)[ok] ^ np.broadcast_to(y, ok.shape)[ok]) <= distance
    return ok


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same components as all near pairs of one cell; fewer than there are rows."""
    left, el = fps, _counts(fps)
    front: list[tuple[np.uint64, np.uint64]] = []
    a, b = [], []
    while len(left):
        if not front:
            front.append((left[0], el[0]))
            left, el = left[1:], el[1:]
        x, ex = front.pop()
        ok = _near(x, ex, left, el, distance)
        if ok.any():
            hit = left[ok]
            a.append(hit)
            b.append(np.full(len(hit), x))
            front += list(zip(hit, el[ok], strict=True))
            left, el = left[~ok], el[~ok]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a) if a else none, np.concatenate(b) if b else none)


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of a batch of links as stars."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _cell_links(cell: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted cells: short runs by shifts of the whole batch, long ones by search."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(starts, len(cell)))
    a, b = [], []
    for s, n in zip(starts[size > 64], size[size > 64], strict=True):
        p, q = spanning_links(fps[s : s + n], distance)
        a.append(p)
        b.append(q)
    keep = np.repeat((size <= 64) & (size > 1), size)
    cell, fps = cell[keep], fps[keep]
    e = _counts(fps)
    at = np.arange(len(fps))
    for d in range(1, 64):
        at = at[at + d < len(fps)]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            break
        ok = _near(fps[at], e[at], fps[at + d], e[at + d], distance)
        a.append(fps[at[ok]])
        b.append(fps[at[ok] + d])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a) if a else none, np.concatenate(b) if b else none)


def links(distinct: DataFrame, distance: int = MAX_DISTANCE, groups: int = GROUPS) -> DataFrame:
    """(a, b) links with the same components as all pairs of ``fp`` at ``distance`` or fewer bits.

    ``distinct`` has each fingerprint once. Within a batch, links are
    contracted to stars, so a large group of near copies gives about as many
    links as it has fingerprints. Cells over BLOCK rows aren't gathered: they
    are dealt into pairs of blocks in a second pass.
    """
    masks = cell_masks(distance, groups)
    e = distinct.select("fp", segment_counts(F.col("fp")).alias("e"))
    cells = e.select("fp", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))

    def emit(a, b, t, key) -> pa.RecordBatch:
        n, m = len(a), len(t)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([a.view(np.int64), np.zeros(m, np.int64)])), pa.array(np.concatenate([b.view(np.int64), np.zeros(m, np.int64)])),
            pa.array([None] * n + list(t), pa.int32()), pa.array([None] * n + list(key), pa.int64())], ["a", "b", "t", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        hot: tuple[int, int] | None = None

        def settle(last: bool):
            """Links of the cells that are complete; the last one stays open."""
            nonlocal held, n, hot
            t, key, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            cell = np.cumsum(np.concatenate([[0], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]))
            if hot is not None:
                own = (t == hot[0]) & (key == hot[1])
                t, key, fp, cell = t[~own], key[~own], fp[~own], cell[~own]
                hot = hot if not len(t) else None
            out_t, out_key = [], []
            if len(cell):
                cut = len(cell) if last else int(np.searchsorted(cell, cell[-1]))
                sizes = np.bincount(cell - cell[0])
                large = np.flatnonzero(sizes > BLOCK) + cell[0]
                for c in large:
                    i = int(np.searchsorted(cell, c))
                    out_t.append(int(t[i]))
                    out_key.append(int(key[i]))
                    if c == cell[-1] and not last:
                        hot = (int(t[i]), int(key[i]))
                        cut = len(cell)
                ok = ~np.isin(cell, large)
                ok[cut:] = False
                a, b = _cell_links(cell[ok], fp[ok], distance) if ok.any() else (fp[:0], fp[:0])
                if len(a):
                    a, b = _contracted(a, b)
                held = [(t[cut:], key[cut:], fp[cut:])] if cut < len(cell) else []
                n = len(cell) - cut
                return emit(a, b, out_t, out_key)
            held, n = [], 0
            return emit(fp[:0], fp[:0], [], [])

        for batch in batches:
            t, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append((t, key, fp.view(np.uint64) if fp.flags.c_contiguous else fp.copy().view(np.uint64)))
            n += len(t)
            if n >= _BATCH:
                yield settle(False)
        if held:
            yield settle(True)

    dealt = cells.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    found = materialise(dealt.mapInArrow(run, "a bigint, b bigint, t int, key bigint"), "links")
    near = found.where("t is null").select("a", "b")
    large = found.where("t is not null").select("t", "key").distinct()
    if large.isEmpty():
        return near
    return near.unionByName(_block_links(cells, large, distance))


def _block_links(cells: DataFrame, large: DataFrame, distance: int) -> DataFrame:
    own = cells.join(large, ["t", "key"])
    sizes = own.groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    dealt = own.join(sizes, ["t", "key"]).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("t", "key", "fp", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"))

    def linked(pdf):
        import pandas as pd

        a, b = spanning_links(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64), distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pairs.groupBy("t", "key", "i", "j").applyInPandas(linked, "a bigint, b bigint")


def components(docs: DataFrame, distance: int = MAX_DISTANCE, groups: int = GROUPS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links; every row stays.

    Null texts are empty. Null ids are rows like others but never a component's id.
    """
    own = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    root = connected(links(distinct.select("fp"), distance, groups))
    rooted = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    found = hot_join(rooted.select("fp", "root", F.col("n").alias("copies")), lowest, "root", distinct.count())
    return hot_join(own, found.select("fp", "component_id", F.col("copies").alias("n")), "fp", own.count()).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
