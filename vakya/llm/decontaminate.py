"""Benchmark decontamination by latent semantic retrieval.

Documents are read once: their words become numbers of the benchmark's words,
and the passages with each word are counted. Overlapping passages are weighted by TF-IDF
and embedded by a randomised SVD whose sketch is gathered from all passages.
Passages whose embedding is close to an item's are checked: by the longest
common subsequence with the item's words, and by the item's rarest words, which stand
for its answer. An item's embedding may be weak or drowned by the words around
it, so passages that hold enough of its rarest words are checked as
well, whatever their cosine.

An item is found if the subsequence has SUBSEQUENCE of its words and the
passage ANSWER of its rarest; or if the subsequence alone has STRONG of its words; or,
for an item whose halves changed places, if the subsequences of its two
halves have MOVED of its words together and the passage ANSWER of its rarest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .licenses import words

#: A passage is two halves of so many words; it starts at every half.
HALF = 32
RANK, OVERSAMPLE = 128, 16
#: A word in more than this share of all passages doesn't count in the vectors; it still counts in the subsequence.
COMMON = 0.02
COSINE, SUBSEQUENCE, ANSWER, ANSWER_WORDS = 0.35, 0.6, 0.6, 6
STRONG, MOVED = 0.65, 0.8
#: An item whose vector keeps less than this share of its norm in the space is looked for by its rarest words alone.
FAINT = 0.3
#: Items are searched in blocks of so many, each with a space of its own.
ITEMS = 20_000
#: Texts are worked on together up to so many characters; a longer one is worked on alone.
TOGETHER = 1 << 19
#: Passages and items of one cosine product.
TILE = 2048


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one bit per element of ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = where.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Space:
    """Word numbers, weights and right singular vectors; bounded by a block of items."""

    ids: list
    items: list[np.ndarray]
    number: dict[bytes, int]
    idf: np.ndarray
    #: The weights with those of common words.
    rare: np.ndarray | None = None
    vectors: np.ndarray | None = None


def _together(batches: Iterator[pa.RecordBatch], column: int, most: int = TOGETHER) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of batches whose texts or byte strings are bounded together, and these."""
    for b in batches:
        start, size, texts = 0, 0, []
        for i, t in enumerate(b.column(column)):
            texts.append(t.as_py())
            size += len(texts[-1] or "")
            if size >= most:
                yield b.slice(start, i + 1 - start), texts
                start, size, texts = i + 1, 0, []
        if texts:
            yield b.slice(start), texts


def _halves(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and half of every word of the benchmark; first half of each text, and one more."""
    # An empty half follows each text, so that passages end with it.
    first = np.cumsum([0, *(-(-len(k) // HALF) + 1 for k in codes)])
    at = [np.flatnonzero(k >= 0) for k in codes]
    none = [np.zeros(0, np.int64)]
    numbers = np.concatenate([k[x] for k, x in zip(codes, at, strict=True)] or none).astype(np.int64)
    return numbers, np.concatenate([x // HALF + n for x, n in zip(at, first[:-1], strict=True)] or none), first


def _passages(numbers: np.ndarray, halves: np.ndarray, n: int, idf: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Embedded TF-IDF vectors of the passages that start at each half."""
    out = np.zeros((n + 1, vectors.shape[1]), np.float32)
    if len(numbers):
        starts = np.flatnonzero(np.concatenate([[True], halves[1:] != halves[:-1]]))
        out[halves[starts]] = np.add.reduceat(vectors[numbers] * idf[numbers, None], starts, axis=0)
    return out[:-1] + out[1:]


def _item_space(items: list[tuple[int, str]]) -> Space:
    listed = [(i, words(t)) for i, t in items]
    listed = [(i, w) for i, w in listed if w]
    number = {w: k for k, w in enumerate(sorted({w for _, ws in listed for w in ws}))}
    return Space([i for i, _ in listed], [np.array([number[w] for w in ws], np.int64) for _, ws in listed], number, np.ones(len(number), np.float32))


def coded(docs: DataFrame, space: Space) -> DataFrame:
    """(doc_id, codes, df): the word numbers of every text, four bytes each, -1 for words that no item has.

    Texts without a word of the benchmark are left out. Each task adds rows with null
    ``codes``, which hold numbers of passages by word, and of all passages under -1.
    """
    size, number = len(space.number), space.number
    kind = docs.schema["doc_id"].dataType
    pair = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, key = np.zeros(size, np.int64), 0, None
        for b, texts in _together(batches, 1):
            key, codes = b.column(0).type, []
            for t in texts:
                ws = words(t)
                codes.append(np.fromiter(map(number.get, ws, repeat(-1)), np.int32, len(ws)))
            numbers, halves, first = _halves(codes)
            found = np.unique(np.concatenate([halves * size + numbers, np.maximum(halves - 1, 0) * size + numbers]))
            df += np.bincount(found % size, minlength=size)
            total += int(first[-1]) - len(codes)
            keep = [i for i, k in enumerate(codes) if len(k) and k.max() >= 0]
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([codes[i].tobytes() for i in keep], pa.binary()), pa.nulls(len(keep), pair)], ["doc_id", "codes", "df"])
        if key is not None:
            own = np.flatnonzero(df)
            counts = [{"word": int(w), "n": int(n)} for w, n in zip(np.append(own, -1), np.append(df[own], total), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.nulls(1, pa.binary()), pa.array([counts], pair)], ["doc_id", "codes", "df"])

    return materialise(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, codes binary, df array<struct<word:bigint,n:bigint>>"), "coded")


def weigh(codes: DataFrame, space: Space) -> None:
    """Weights from document frequencies over all passages; words of more than the COMMON share lose theirs."""
    df, total = np.zeros(len(space.number)), 0
    for r in codes.where("codes is null").select(F.explode("df").alias("x")).groupBy("x.word").agg(F.sum("x.n").alias("n")).collect():
        if r["word"] < 0:
            total = r["n"]
        else:
            df[r["word"]] = r["n"]
    idf = np.log((total + 1) / (df + 1)) + 1
    space.rare = idf.astype(np.float32)
    space.idf = np.where(df > COMMON * total, 0, idf).astype(np.float32)


def fit(codes: DataFrame, space: Space, seed: int = 42) -> None:
    """Randomised SVD of the passage matrix A by one pass: the sketch A'AΩ is summed over all passages.

    Each task sends a row per word it met; the sums per word are reduced
    on the executors, and only the sketch, as large as the item block's
    vocabulary, comes to the driver. The items are passages as well.
    """
    size = len(space.number)
    rank = min(RANK + OVERSAMPLE, size)
    test = np.random.default_rng(seed).standard_normal((size, rank)).astype(np.float32)
    idf = space.idf

    def sketch(numbers: np.ndarray, halves: np.ndarray, n: int, out: np.ndarray) -> None:
        ok = idf[numbers] > 0
        numbers, halves = numbers[ok], halves[ok]
        if not len(numbers):
            return
        p = _passages(numbers, halves, n, idf, test)
        near = p + np.concatenate([np.zeros((1, rank), np.float32), p[:-1]])
        order = np.argsort(numbers, kind="stable")
        k = numbers[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out[k[starts]] += np.add.reduceat(near[halves[order]], starts, axis=0) * idf[k[starts], None]

    def rows(out: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(out.any(1))
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array([x.tobytes() for x in out[own]], pa.binary())], ["word", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, rank))
        for _, found in _together(batches, 0):
            numbers, halves, first = _halves([np.frombuffer(x, np.int32) for x in found])
            sketch(numbers, halves, int(first[-1]), out)
        yield rows(out)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, rank))
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out[k] += np.frombuffer(part.as_py(), np.float64)
        yield rows(out)

    y = np.zeros((size, rank))
    parts = codes.where("codes is not null").select("codes").mapInArrow(run, "word bigint, part binary").repartition("word").mapInArrow(reduce, "word bigint, part binary")
    for r in parts.collect():
        y[r["word"]] += np.frombuffer(r["part"], np.float64)
    sketch(np.concatenate(space.items), np.repeat(np.arange(len(space.items)) * 2, [len(ws) for ws in space.items]), 2 * len(space.items), y)
    # Nystrom: A'A ~ Y (Ω'Y)^-1 Y'
    core = test.astype(np.float64).T @ y
    core = (core + core.T) / 2
    val, vec = np.linalg.eigh(core)
    ok = val > max(val.max(), 0) * 1e-9
    left = y @ (vec[:, ok] / np.sqrt(val[ok]))
    u = np.linalg.svd(left, full_matrices=False)[0] if ok.any() else np.zeros((size, 1))
    space.vectors = np.ascontiguousarray(u[:, :RANK], np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def item_vectors(space: Space) -> tuple[np.ndarray, np.ndarray]:
    """The items in the space, and the share of its norm that each keeps there (0 for an item without a word that counts)."""
    out, kept = np.zeros((len(space.items), space.vectors.shape[1]), np.float32), np.zeros(len(space.items))
    for i, ws in enumerate(space.items):
        k, n = np.unique(ws, return_counts=True)
        weight = n * space.idf[k]
        out[i] = weight @ space.vectors[k]
        kept[i] = np.linalg.norm(out[i]) / max(np.linalg.norm(weight), 1e-12)
    return out, kept


def _rare_postings(space: Space, answers: list[set]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items, and the bits of their rarest words, by word: where each word's rows start, their number, item and bit."""
    rows = sorted((w, i, k) for i, own in enumerate(answers) for k, w in enumerate(sorted(own)))
    word, item, bit = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    n = np.bincount(word, minlength=len(space.number))
    return np.cumsum(n) - n, n, item, 1 << bit


def _holding(numbers: np.ndarray, halves: np.ndarray, first: np.ndarray, postings: tuple, rare: np.ndarray, reach: np.ndarray, need: np.ndarray) -> set[tuple[int, int]]:
    """(half, item) of every passage that may hold the share ``need`` of the item's rarest words in its region of ``reach`` halves."""
    starts, n, items, bits = postings
    k = n[numbers]
    at = np.repeat(starts[numbers] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    if not len(at):
        return set()
    span = int(first[-1]) + 1
    key, inverse = np.unique(items[at] * span + np.repeat(halves, k), return_inverse=True)
    own = np.zeros(len(key), np.int64)
    np.bitwise_or.at(own, inverse, bits[at])
    item, half = key // span, key % span
    doc = np.searchsorted(first, half, side="right") - 1
    held = own.copy()
    for j in range(1, min(int(reach.max()), len(key))):
        near = (item[j:] == item[:-j]) & (doc[j:] == doc[:-j]) & (half[j:] - half[:-j] < reach[item[:-j]])
        held[:-j] |= np.where(near, own[j:], 0)
    # ``half`` is the first with such a word; passages whose region starts there or before it.
    ok = np.flatnonzero(np.bitwise_count(held) / rare[item] >= need[item])
    return {(s, i) for i, h, d in zip(item[ok].tolist(), half[ok].tolist(), doc[ok].tolist(), strict=True) for s in range(max(int(first[d]), h + 2 - int(reach[i])), h + 2)}


def _agrees(item: list[int], answers: set[int], region: list[int], subsequence: float, answer: float) -> tuple[float, float] | None:
    """Share of the item's words in the common subsequence, and of its rarest words in the region, if it counts as found."""
    held = set(region)
    n = len(item)
    told = len(answers & held) / len(answers)
    most = sum([w in held for w in item]) / n
    if most < subsequence or (told < answer and most < STRONG):
        return None
    share = common_subsequence(item, region) / n
    if share >= STRONG or (share >= subsequence and told >= answer):
        return share, told
    if told >= answer and most >= MOVED:
        moved = (common_subsequence(item[: n // 2], region) + common_subsequence(item[n // 2 :], region)) / n
        if moved >= MOVED:
            return moved, told
    return None


def _search(codes: DataFrame, space: Space, cosine: float, subsequence: float, answer: float) -> DataFrame:
    answers = [set(sorted(set(ws.tolist()), key=lambda w: (-space.rare[w], w))[:ANSWER_WORDS]) for ws in space.items]
    vectors, kept = item_vectors(space)
    # A faint item has no direction to trust: it is checked wherever one of its rarest words stands.
    faint = kept < FAINT
    targets = _unit(np.where(faint[:, None], 0, vectors)).T.copy()
    need = np.where(faint, 1e-9, answer)
    postings, rare = _rare_postings(space, answers), np.array([len(x) for x in answers])
    # A region is three halves and as many words as the item has, or a half.
    reach = np.array([3 - (-max(HALF, len(ws)) // HALF) for ws in space.items])
    listed = [ws.tolist() for ws in space.items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _together(batches, 1):
            keys, texts = b.column(0).to_pylist(), [np.frombuffer(x, np.int32) for x in found]
            numbers, halves, first = _halves(texts)
            pairs = _holding(numbers, halves, first, postings, rare, reach, need)
            weighty = space.idf[numbers] > 0
            p = _passages(numbers[weighty], halves[weighty], int(first[-1]), space.idf, space.vectors)
            live = np.flatnonzero(p.any(1))
            for s in range(0, len(live), TILE):
                unit = _unit(p[live[s : s + TILE]])
                for t in range(0, targets.shape[1], TILE):
                    at, item = np.nonzero(unit @ targets[:, t : t + TILE] >= cosine)
                    pairs.update(zip(live[s : s + TILE][at].tolist(), (item + t).tolist(), strict=True))
            best: dict[tuple[int, int], tuple[float, float]] = {}
            owner = np.searchsorted(first, np.array([x for x, _ in pairs], np.int64), side="right") - 1
            for (half, i), d in zip(pairs, owner.tolist(), strict=True):
                item = listed[i]
                start = (half - int(first[d])) * HALF
                region = texts[d][max(0, start - HALF) : start + 2 * HALF + max(HALF, len(item))].tolist()
                shares = _agrees(item, answers[i], region, subsequence, answer)
                if shares:
                    best[d, i] = max(best.get((d, i), (0.0, 0.0)), shares)
            if best:
                yield pa.RecordBatch.from_arrays([
                    pa.array([keys[d] for d, _ in best], b.column(0).type), pa.array([space.ids[i] for _, i in best], pa.int64()),
                    pa.array([x[0] for x in best.values()], pa.float64()), pa.array([x[1] for x in best.values()], pa.float64())], ["doc_id", "item_id", "lcs_share", "answer_share"])

    src = codes.where("codes is not null").select("doc_id", "codes")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id bigint, lcs_share double, answer_share double")


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, subsequence: float = SUBSEQUENCE, answer: float = ANSWER, block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer_share) of every item found in a document; one row per input row and item.

    Null and empty texts match nothing, and so do null item ids; repeated items
    are items of their own. The benchmark is read in blocks of ``block`` items,
    so what is sent to executors is bounded whatever its size.
    """
    listed = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    found = None
    part: list[tuple[int, str]] = []

    def one(items: list[tuple[int, str]]) -> DataFrame | None:
        space = _item_space(items)
        if not space.items:
            return None
        codes = coded(docs, space)
        weigh(codes, space)
        fit(codes, space)
        return materialise(_search(codes, space, cosine, subsequence, answer), "leaks")

    def joined(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
        return b if a is None else a if b is None else a.unionByName(b)

    for r in listed.orderBy("item_id", "text").toLocalIterator():
        part.append((r["item_id"], r["text"]))
        if len(part) == block:
            found, part = joined(found, one(part)), []
    found = joined(found, one(part)) if part else found
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found if found is not None else docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id bigint, lcs_share double, answer_share double")
