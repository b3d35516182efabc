"""Groups of texts that are near by fingerprint or by their shingles.

A 64-bit fingerprint can't tell a Jaccard similarity of 0.8 from chance: such
pairs differ in 5 to 15 bits. So beside the fingerprints' own links, texts that
share a sample of shingles (the SAMPLE lowest of all under one of ORDERS hash
orders) are verified by their exact similarity. A pair of similarity s shares
a given sample with about s ** SAMPLE; for u shingles of which i are common it is
C(i, SAMPLE) / C(u, SAMPLE), less than that for small texts. So texts of up to
EXACT shingles have single shingles as keys instead, the first of them in the
order of their hashes: a pair of the similarity has one of them in common.

In each group of one sample all members are verified against the smallest; the
ones that fail form the group again, up to ROUNDS times. That joins most of a
group, but a member that failed may still be near one that was verified. So
every group whose members aren't all connected by then is compared whole, but
for pairs that are connected already: groups of up to FEW members directly,
larger ones in pairs of blocks, where a pair goes to verification unless sizes
or parity bits prove that it's below the similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import hot_join, materialise
from .components import connected

SIMILARITY, SHINGLE = 0.8, 5
ORDERS, SAMPLE, ROUNDS = 20, 5, 4
#: Texts of up to so many shingles lose no pair; the others' keys are samples.
EXACT = 96
#: Members of a group that are verified in one task, and rows of a block.
BLOCK = 4096
#: Groups of up to so many members are compared by a join.
FEW = 32
#: Most parity bits of a text; a text has two to four a shingle.
MOST_BITS = 1 << 17
_CHUNK = 65_536
_ODD = np.random.default_rng(7).integers(0, 1 << 63, ORDERS, np.uint64) * np.uint64(2) + np.uint64(1)


def sample_keys(distinct: np.ndarray) -> np.ndarray:
    """A key for each order: the sum of its SAMPLE lowest values (all, if fewer)."""
    low = np.zeros((ORDERS, 0), np.uint64)
    for i in range(0, len(distinct), _CHUNK):
        low = np.concatenate([low, distinct[None, i : i + _CHUNK] * _ODD[:, None]], axis=1)
        if low.shape[1] > SAMPLE:
            low = np.partition(low, SAMPLE - 1, axis=1)[:, :SAMPLE]
    return low.sum(axis=1, dtype=np.uint64)


def prefix_keys(distinct: np.ndarray, similarity: float) -> np.ndarray:
    """The lowest of the sorted shingles, as many as a similar text can't all be without."""
    n = len(distinct)
    return distinct[: n - math.ceil(similarity * n - 1e-9) + 1]


def text_keys(distinct: np.ndarray, similarity: float) -> np.ndarray:
    """Prefix keys of small texts, samples of large ones; both of those that are near small and large ones."""
    n = len(distinct)
    if not n:
        return distinct
    parts = [prefix_keys(distinct, similarity)] if n * similarity <= EXACT + 1e-9 else []
    if n > EXACT:
        parts.append(sample_keys(distinct))
    return np.concatenate(parts)


def sketches(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, fp, keys) of every whole text; no keys for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = [], []
            for text in b.column(1).to_pylist():
                h = simhash.shingle_hashes(text, shingle)
                fps.append(simhash.majority(h))
                keys.append(text_keys(np.unique(h), similarity).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "keys"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp bigint, keys array<bigint>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, hashes): the distinct shingles of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(simhash.shingle_hashes(t, shingle)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "hashes"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, hashes array<bigint>")


def parity_bits(distinct: np.ndarray) -> bytes:
    """A bit for each residue of the shingles, set if an odd number of them has it.

    Two texts differ in at least as many shingles as bits; the upper half of
    the bits folded onto the lower is the same for half as many residues.
    """
    n = min(MOST_BITS, 1 << max(6, (2 * len(distinct) - 1).bit_length()))
    return np.packbits((np.bincount((distinct & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8), bitorder="little").tobytes()


def parities(sets: DataFrame) -> DataFrame:
    """(doc_id, size, bits) of every shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.array(x.as_py(), np.int64).view(np.uint64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([parity_bits(x) for x in own], pa.binary())], ["doc_id", "size", "bits"])

    return sets.mapInArrow(run, "doc_id bigint, size bigint, bits binary")


def possible_pairs(size: np.ndarray, bits: list[bytes], similarity: float, apart: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (r, c) whose sizes and parity bits allow the similarity and that differ in every array of ``apart``."""
    order = np.argsort(size, kind="stable")
    n, words = size[order], [np.frombuffer(bits[i], np.uint64) for i in order]
    apart = [x[order] for x in apart]
    width = np.array([len(w) for w in words], np.int64)
    # |x ^ y| <= (|x| + |y|) * (1 - s) / (1 + s)
    most = (1 - similarity) / (1 + similarity)
    last = np.searchsorted(n, np.floor(n / similarity + 1e-6), side="right")
    left, right = [], []
    for w in np.unique(width):
        lo, hi = np.searchsorted(width, [w, w + 1])
        m = np.stack([np.bitwise_xor.reduce(x.reshape(-1, w), axis=0) for x in words[lo : last[hi - 1]]])
        for r in range(lo, hi):
            c = np.arange(r + 1, last[r])
            for x in apart:
                c = c[x[c] != x[r]]
            for k in range(0, len(c), 1024):
                part = c[k : k + 1024]
                differ = np.bitwise_count(m[part - lo] ^ m[r - lo]).sum(axis=1, dtype=np.int64)
                hit = part[differ <= (n[part] + n[r]) * most + 1e-6]
                left.append(np.full(len(hit), order[r]))
                right.append(order[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets have at least this Jaccard similarity.

    A b that many pairs share is dealt to one copy for BLOCK pairs, so no task
    gets all of them.
    """
    heads = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    dealt = pairs.join(heads, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("s"))
    right = heads.join(sets.withColumnRenamed("doc_id", "b"), "b").select("b", F.col("hashes").alias("y"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    both = F.size(F.array_intersect("x", "y"))
    size = F.size("x") + F.size("y")
    # |x & y| / |x | y| >= s, with the sizes alone deciding first.
    fits = F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * similarity
    near = F.when(fits, both >= (size - both) * similarity).otherwise(False)
    return dealt.join(right, ["b", "s"]).join(left, "a").where(near).select("a", "b").distinct()


def _stars(rows: DataFrame) -> DataFrame:
    """(key, a, b): each member of a group but the smallest, and that."""
    least = rows.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b < most").select("key", "b")
    return rows.join(least, "key").where("a > b").select("key", "a", "b")


def _open_groups(rows: DataFrame, root: DataFrame) -> DataFrame:
    """(key, a, root, n): the groups, of n members, whose members aren't all connected."""
    own = rows.join(root.select(F.col("node").alias("a"), "root"), "a", "left").select("key", "a", F.coalesce("root", "a").alias("root"))
    mixed = own.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "n")
    return own.join(mixed, "key")


def _few_pairs(groups: DataFrame) -> DataFrame:
    """(a, b) of one small group that aren't connected."""
    few = groups.where(F.col("n") <= FEW)
    other = few.select("key", F.col("a").alias("b"), F.col("root").alias("r"))
    return few.join(other, "key").where("a > b and root <> r").select("a", "b")


def _block_pairs(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of one large group that aren't connected and may be similar, groups being compared in pairs of blocks."""
    large = groups.where(F.col("n") > FEW)
    bits = parities(sets.join(large.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi")).withColumnRenamed("doc_id", "a")
    k = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = large.withColumn("k", k).withColumn("s", F.pmod(F.xxhash64("a"), F.col("k")).cast("int"))
    own = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("key", "a", "root", "s", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"))

    def near(pdf):
        import pandas as pd

        ids, apart = pdf["a"].to_numpy(), [pdf["root"].to_numpy()]
        if pdf["i"].iat[0] < pdf["j"].iat[0]:
            apart.append(pdf["s"].to_numpy())
        r, c = possible_pairs(pdf["size"].to_numpy(), pdf["bits"].tolist(), similarity, apart)
        return pd.DataFrame({"a": np.maximum(ids[r], ids[c]), "b": np.minimum(ids[r], ids[c])})

    return own.join(bits, "a").groupBy("key", "i", "j").applyInPandas(near, "a bigint, b bigint")


def similar_components(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable; every row with an id stays.

    Null texts are empty, and empty texts are one group. Rows with a null id
    are left out; rows that repeat an id are one node.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    own = materialise(sketches(docs, shingle, similarity), "sketches")
    nodes = materialise(own.groupBy("fp").agg(F.min(F.struct("doc_id", "keys")).alias("least"), F.count("*").alias("n")).select("fp", "least.doc_id", "least.keys", "n"), "nodes")
    by_bits = connected(simhash.links(nodes.select("fp")))
    edges = [nodes.join(by_bits, nodes["fp"] == by_bits["node"]).select("doc_id", "root").join(
        nodes.select(F.col("fp").alias("root"), F.col("doc_id").alias("b")), "root").select(F.col("doc_id").alias("a"), "b"),
        # Fingerprints of one id, where rows repeat it, and ids of one fingerprint.
        hot_join(own, nodes.select("fp", F.col("doc_id").alias("b"), "n"), "fp", own.count()).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()]

    rows = nodes.select(F.col("doc_id").alias("a"), F.explode("keys").alias("key")).distinct()
    stars = materialise(_stars(rows), "stars")
    if not stars.isEmpty():
        ids = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct()
        sets = materialise(shingle_sets(docs.join(ids, "doc_id", "left_semi"), shingle), "sets")
        tested = []
        for _ in range(ROUNDS):
            near = materialise(verified(stars.select("a", "b").distinct(), sets, similarity), "verified")
            edges.append(near)
            tested.append(stars.select("a", "b"))
            rest = materialise(stars.join(near, ["a", "b"], "left_anti").select("key", "a"), "rest")
            stars = materialise(_stars(rest), "stars")
            if stars.isEmpty():
                break
        root = connected(reduce(DataFrame.unionByName, edges))
        edges = [root.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        groups = materialise(_open_groups(rows, root), "open")
        pairs = _few_pairs(groups).unionByName(_block_pairs(groups, sets, similarity)).distinct()
        pairs = materialise(pairs.join(reduce(DataFrame.unionByName, tested).distinct(), ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            edges.append(materialise(verified(pairs, sets, similarity), "verified"))
    root = connected(reduce(DataFrame.unionByName, edges))
    return own.join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "fp", F.coalesce("root", "doc_id").alias("component_id"))
