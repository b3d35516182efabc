"""Bracket scoring by sentence, its summary, and a randomisation test of two systems."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of at most this many words are summarised a second time (fixed value).
CUTOFF = 40
ITERATIONS = 10_000
#: Rows, and iterations, whose coins are made at once, so that they stay in a core's cache.
BLOCK = 256


def _spans(spans: DataFrame, name: str) -> DataFrame:
    one = F.struct("l", "r", "label")
    return spans.groupBy("sent_id").agg(F.collect_list(one).alias(name))


def bracket_scores(gold: DataFrame, test: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per sentence: words, gold, produced, matched, crossing, recall, precision.

    ``gold`` and ``test`` are span tables, ``lengths`` has sent_id and words. A
    bracket crosses if it overlaps some gold one and neither holds the other.
    A sentence without spans on a side has zero of them, and a share of 1 there
    if the other side has none either, else 0. A sentence's spans are bounded by
    its words, so they are held in one row.
    """
    both = lengths.join(_spans(gold, "g"), "sent_id", "left").join(_spans(test, "t"), "sent_id", "left")
    none = F.expr("array()").cast("array<struct<l:int,r:int,label:string>>")
    both = both.withColumns({"g": F.coalesce("g", none), "t": F.coalesce("t", none)})
    # Matches are those of multisets: the k-th equal bracket matches if the other side has k of it.
    matched = F.expr("aggregate(array_distinct(t), 0, (n, x) -> n + least(size(filter(t, y -> y = x)), size(filter(g, y -> y = x))))")
    crossing = F.expr("size(filter(t, x -> exists(g, y -> (x.l < y.l and y.l <= x.r and x.r < y.r) or (y.l < x.l and x.l <= y.r and y.r < x.r))))")
    out = both.select("sent_id", "words", F.size("g").alias("gold"), F.size("t").alias("produced"), matched.alias("matched"), crossing.alias("crossing"))

    def share(of: str, other: str):
        return F.when(F.col(of) > 0, F.col("matched") / F.col(of)).when(F.col(other) > 0, 0.0).otherwise(1.0)

    return out.withColumns({"recall": share("gold", "produced"), "precision": share("produced", "gold")})


def bracket_summary(scores: DataFrame, cutoff: int = CUTOFF, n: str | None = None) -> DataFrame:
    """Two rows, ``all`` and ``short``: recall, precision, F, complete matches and crossing rates of sentences.

    A row stands for one sentence, or for as many as its column ``n`` says.
    """
    scores = scores.withColumn("_n", F.lit(1) if n is None else F.col(n))
    both = scores.withColumn("part", F.explode(F.when(F.col("words") <= cutoff, F.array(F.lit("all"), F.lit("short"))).otherwise(F.array(F.lit("all")))))

    def mean(x: str):
        return F.sum(F.expr(f"({x}) * _n")) / F.sum("_n")

    s = both.groupBy("part").agg(F.sum("_n").alias("sentences"), *[F.sum(F.col(c) * F.col("_n")).alias(c) for c in ("gold", "produced", "matched")],
                                 mean("cast(matched = gold and matched = produced as int)").alias("complete"), mean("crossing").alias("average_crossing"),
                                 mean("cast(crossing = 0 as int)").alias("no_crossing"), mean("cast(crossing <= 2 as int)").alias("two_or_less_crossing"))
    rates = {"recall": F.try_divide("matched", "gold"), "precision": F.try_divide("matched", "produced"), "f1": F.try_divide(2 * F.col("matched"), F.col("gold") + F.col("produced"))}
    return s.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in rates.items()})


def _coins(ids: np.ndarray, first: int, n: int) -> np.ndarray:
    """A fair bit for each id and iteration, from a mixing of both."""
    with np.errstate(over="ignore"):
        z = ids[:, None] + np.arange(first + 1, first + n + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
        t = z >> np.uint64(30)
        for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
            z ^= t
            z *= np.uint64(factor)
            np.right_shift(z, np.uint64(shift), out=t)
    z ^= t
    z &= np.uint64(1)
    return z.astype(bool)


def randomisation_test(first: DataFrame, second: DataFrame, iterations: int = ITERATIONS, seed: int = 0) -> DataFrame:
    """measure, difference, as_large, p of recall and precision between two systems' ``bracket_scores``.

    In each iteration every sentence's rows are swapped or not by a fair coin of
    its id and the seed, so results don't depend on the partitioning. Tasks
    return sums for each iteration, never sentences. Without rows, p is 1.
    """
    cols = ["gold", "produced", "matched"]
    a, b = (d.select("sent_id", *[F.col(c).cast("double").alias(f"{c}{n}") for c in cols]) for n, d in ((1, first), (2, second)))
    return paired_randomisation_test(a.join(b, "sent_id"), iterations, seed)


def paired_randomisation_test(pairs: DataFrame, iterations: int = ITERATIONS, seed: int = 0) -> DataFrame:
    """``randomisation_test`` of rows that hold both systems' gold, produced and matched (doubles; gold1 to matched2) by sent_id."""
    cols = ["gold", "produced", "matched"]
    rows = pairs.select(F.xxhash64("sent_id", F.lit(seed)).alias("h"), *[f"{c}{n}" for n in (1, 2) for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((iterations + 1, 6))
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            v = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            sums += v.sum(0)
            # A swap moves the second system's surplus to the first; where both score the same it changes nothing.
            gap = v[:, 3:] - v[:, :3]
            moves = gap.any(1)
            h, gap = h[moves], gap[moves]
            for i in range(0, len(h), BLOCK):
                x = gap[i : i + BLOCK].T
                # Small whole numbers add up exactly in single precision.
                kind = np.float32 if (x == np.rint(x)).all() and np.abs(x).sum() < 1 << 24 else np.float64
                x = x.astype(kind)
                for k in range(0, iterations, BLOCK):
                    n = min(BLOCK, iterations - k)
                    moved = (x @ _coins(h[i : i + BLOCK], k, n).astype(kind)).T
                    sums[k + 1 : k + n + 1, :3] += moved
                    sums[k + 1 : k + n + 1, 3:] -= moved
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations + 1)), *[pa.array(sums[:, j]) for j in range(6)]], ["i", *[f"{c}{n}" for n in (1, 2) for c in cols]])

    s = rows.mapInArrow(run, "i bigint, " + ", ".join(f"{c}{n} double" for n in (1, 2) for c in cols)).groupBy("i").agg(*[F.sum(f"{c}{n}").alias(f"{c}{n}") for n in (1, 2) for c in cols])
    gaps = s.select("i", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), (F.coalesce(F.try_divide("matched2", f"{w}2"), F.lit(0.0)) - F.coalesce(F.try_divide("matched1", f"{w}1"), F.lit(0.0))).alias("d"))
                                             for m, w in (("recall", "gold"), ("precision", "produced"))])).alias("x")).select("i", "x.*")
    seen = gaps.where("i = 0").select("measure", F.col("d").alias("difference"))
    beyond = F.when(F.col("difference") >= 0, F.col("d") >= F.col("difference")).otherwise(F.col("d") <= F.col("difference"))
    found = gaps.where("i > 0").join(F.broadcast(seen), "measure").groupBy("measure", "difference").agg(F.sum(beyond.cast("bigint")).alias("as_large"))
    return found.withColumn("p", (F.col("as_large") + 1) / (iterations + 1))
