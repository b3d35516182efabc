"""Licensed reorderings of preverbal constituents, paired with their reference sentence."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..plans.barrier import settled
from .cascade import bigrams, deprels

#: All orders are enumerated up to so many constituents; beyond, orders are sampled.
EXHAUSTIVE, SAMPLES, ATTEMPTS = 8, 500, 100_000
#: Orders of so few constituents are made in array functions, unless there may be more of them than stay.
NATIVE = 4


def licensed_pairs(passed: DataFrame) -> DataFrame:
    """Distinct adjacent relation pairs of passed sentences."""
    return settled(passed, _d=deprels()).select(F.explode(bigrams("_d")).alias("p")).select("p.a", "p.b").distinct()


def _orders(labels: list[str], licence: set[str] | None, seed: int, sent_id: str, cap: int) -> list[list[int]]:
    """Licensed orders of one sentence in index order: all of them or a sample, at most ``cap`` drawn by the sentence's own seed."""
    n = len(labels)
    base = tuple(range(n))
    ok = {(a, b): licence is None or f"{labels[a]}\t{labels[b]}" in licence for a, b in itertools.permutations(base, 2)}
    every, rng = all(ok.values()), random.Random(f"{seed}:{sent_id}")

    def licensed(p: tuple[int, ...]) -> bool:
        return p != base and (every or all(ok[a, b] for a, b in zip(p, p[1:], strict=False)))

    if n <= EXHAUSTIVE:
        found = [p for p in itertools.permutations(base) if licensed(p)]
    else:
        seen: set[tuple[int, ...]] = set()
        for _ in range(ATTEMPTS):
            p = tuple(rng.sample(base, n))
            if p not in seen and licensed(p):
                seen.add(p)
                if len(seen) == SAMPLES:
                    break
        found = list(seen)
    if len(found) > cap:
        found = rng.sample(sorted(found), cap)
    return sorted(map(list, found))


def permutations(passed: DataFrame, licence: list[str] | None, cap: int = 99, seed: int = 42) -> DataFrame:
    """Add perms: all orders but the given one, in index order, whose adjacent pairs are licensed.

    Up to NATIVE constituents the orders grow in array functions; more, and those of which over
    ``cap`` orders might be left, are enumerated or sampled per sentence in Arrow batches and
    cut to ``cap`` there by the sentence's own draw.
    """
    # A sentence grows into many rows: few input files must not mean few tasks.
    d = settled(passed.repartition("sent_id"), _d=deprels())
    if licence is None:
        step = "filter(sequence(0, n - 1), x -> not array_contains(p, x))"
    else:
        d = settled(d, _l=F.array(*map(F.lit, licence)) if licence else F.expr("cast(array() as array<string>)"))
        step = "filter(sequence(0, n - 1), x -> not array_contains(p, x) and (size(p) = 0 or array_contains(_l, concat(_d[element_at(p, -1)], '\\t', _d[x]))))"
    grown = (f"filter(aggregate(sequence(1, n), array(cast(array() as array<int>)), (acc, _) -> flatten(transform(acc, p -> transform(if(size(p) < n, {step}, cast(array() as array<int>)), x -> array_append(p, x))))), "
             "p -> p <> sequence(0, n - 1))")
    known = set(licence) if licence is not None else None

    @pandas_udf("array<array<int>>")
    def sampled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for labels, ids in batches:
            yield pd.Series([_orders(list(x), known, seed, i, cap) for x, i in zip(labels, ids, strict=True)])

    d = d.withColumn("n", F.size("constituents"))
    native = max((n for n in range(NATIVE + 1) if math.factorial(n) - 1 <= cap), default=0)
    short = d.where(f"n between 1 and {native}")
    short = settled(short, perms=grown)
    long = d.where(f"n > {native}").withColumn("perms", sampled("_d", "sent_id"))
    return short.unionByName(long).drop("_d", "_l", "n")


def generate(passed: DataFrame, licence: list[str] | None, max_variants: int = 99, seed: int = 42) -> DataFrame:
    """One row per variant: doc_id, k, Sent_ID, Variant_ID, v, perm, Reference_Sentence, Variant_Sentence, n.

    Of over ``max_variants`` orders a draw seeded by the sentence id stays. ``n`` is the sentence's number of variants.
    """
    if max_variants < 1:
        raise ValueError("max_variants must be at least 1")
    p = permutations(passed, licence, max_variants, seed)
    p = settled(p, _ids="transform(flatten(constituents), t -> t.id)")
    p = settled(p, prefix="filter(tokens, t -> t.id < root_id and not array_contains(_ids, t.id))", suffix="filter(tokens, t -> t.id >= root_id and not array_contains(_ids, t.id))")
    rows = p.select("doc_id", "k", "sent_id", "tokens", "root_id", "constituents", "prefix", "suffix", F.size("perms").alias("n"), F.posexplode("perms").alias("v0", "perm"))
    surface = "array_join(transform(concat(prefix, flatten(transform(perm, i -> constituents[i])), suffix), t -> t.form), ' ')"
    return rows.select("doc_id", "k", F.col("sent_id").alias("Sent_ID"), F.expr("concat(sent_id, '_v', v0 + 1)").alias("Variant_ID"), F.expr("v0 + 1").alias("v"), "perm",
                       F.expr("array_join(transform(tokens, t -> t.form), ' ')").alias("Reference_Sentence"), F.expr(surface).alias("Variant_Sentence"),
                       "n", "tokens", "root_id", "constituents", "prefix", "suffix")


def labelled(variants: DataFrame) -> DataFrame:
    """Add ML_Label, alternating 1, 0, 1, ... inside every document in corpus order.

    It starts anew with every document, so no task numbers the corpus.
    """
    w = Window.partitionBy("doc_id").orderBy("k", "v")
    return variants.withColumn("ML_Label", (F.row_number().over(w) % 2).cast("int"))
