"""Word surprisal and best trees under a grammar without unary rules.

Prefix probabilities are exact: the mass of all sentences that begin with a
prefix comes from inside probabilities and the closure of left corners. The
last word is charged for the sentence ending there, so a sentence's surprisals
add up to -log2 of its probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grammar

#: Categories of a model; a chart's size grows with them.
MAX_LABELS = 2_000
#: Sentences of one length that share a chart.
TOGETHER = 256


class Chart:
    """Binary rules and root shares of a grammar, as arrays."""

    def __init__(self, rules: pd.DataFrame):
        roots, binary = rules[rules["kind"] == "Cr"], rules[rules["kind"] == "CC"]
        tags = rules[rules["kind"] == "tag"]["parent"]
        self.labels = sorted(set(binary["parent"]) | set(binary["a"]) | set(binary["b"]) | set(roots["a"]) | set(tags))
        if len(self.labels) > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} labels")
        self.at = {x: i for i, x in enumerate(self.labels)}
        k = len(self.labels)
        self.up, self.left, self.right = (binary[c].map(self.at).to_numpy(dtype=int) for c in ("parent", "a", "b"))
        self.p = binary["p"].to_numpy(dtype=float)
        self.root = np.zeros(k)
        for a, p in zip(roots["a"], roots["p"]):
            self.root[self.at[a]] += p
        step = np.zeros((k, k))
        np.add.at(step, (self.up, self.left), self.p)
        self.corner = np.linalg.inv(np.eye(k) - step)
        # Pairs of labels that some rule joins, and what each gives to a rule's label.
        self.pairs, row = np.unique(self.left * k + self.right, return_inverse=True)
        self.weights = np.zeros((len(self.pairs), k))
        np.add.at(self.weights, (row, self.up), self.p)

    def _words(self, lexicon: list[list[tuple[str, float]]]) -> np.ndarray:
        out = np.zeros((len(lexicon), len(self.labels)))
        for i, row in enumerate(lexicon):
            for label, p in row:
                if label in self.at:
                    out[i, self.at[label]] += p
        return out

    def surprisals(self, words: np.ndarray) -> np.ndarray:
        """Bits of every word of sentences of one length, from their words' masses by label; see ``surprisal``."""
        count, n, k = words.shape
        inside = np.zeros((count, n, n, k))
        # Of each start, for the words read so far: the inside mass, and the prefix mass beside it.
        both = np.zeros((count, n, 2, k))
        mass = np.zeros((count, n))
        for t in range(n):
            inside[:, t, t] = both[:, t, 0] = words[:, t]
            both[:, t, 1] = words[:, t] @ self.corner.T
            for i in range(t - 1, -1, -1):
                # Sum over split points of the products of two parts' masses, then over rules.
                pairs = inside[:, i, i:t].transpose(0, 2, 1) @ both[:, i + 1 : t + 1].reshape(count, t - i, 2 * k)
                made = pairs.reshape(count, k, 2, k).transpose(0, 2, 1, 3).reshape(2 * count, k * k)[:, self.pairs] @ self.weights
                made = made.reshape(count, 2, k)
                inside[:, i, t] = both[:, i, 0] = made[:, 0]
                both[:, i, 1] = made[:, 1] @ self.corner.T
            mass[:, t] = (inside[:, 0, t] if t == n - 1 else both[:, 0, 1]) @ self.root
        before = np.concatenate([np.ones((count, 1)), mass[:, :-1]], 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(before <= 0, np.nan, np.where(mass <= 0, np.inf, np.log2(before) - np.log2(mass)))

    def surprisal(self, lexicon: list[list[tuple[str, float]]]) -> list[float]:
        """Bits of every word; infinite where no sentence goes on like this, NaN after that."""
        return self.surprisals(self._words(lexicon)[None])[0].tolist() if lexicon else []

    def best(self, words: list[str], lexicon: list[list[tuple[str, float]]]) -> str | None:
        """Most likely tree, binarisation undone; None where there is none."""
        n, w = len(lexicon), self._words(lexicon)
        if not n:
            return None
        score, back = np.zeros((n, n, len(self.labels))), {}
        for t in range(n):
            score[t, t] = w[t]
            for i in range(t - 1, -1, -1):
                every = self.p * score[i, i:t][:, self.left] * score[i + 1:t + 1, t][:, self.right]
                split = every.argmax(0) if len(self.p) else np.zeros(0, int)
                value = every.max(0) if len(self.p) else np.zeros(0)
                for r in np.lexsort((np.arange(len(value)), -value)):
                    if value[r] <= 0:
                        break
                    if value[r] > score[i, t, self.up[r]]:
                        score[i, t, self.up[r]] = value[r]
                        back[i, t, self.up[r]] = (i + int(split[r]), self.left[r], self.right[r])
        final = self.root * score[0, n - 1]
        if final.max() <= 0:
            return None

        def parts(i, t, c) -> list[str]:
            """The phrase, or its children where its label was made by binarisation."""
            if (i, t, c) not in back:
                return [f"({self.labels[c]} {words[i]})"]
            k, a, b = back[i, t, c]
            kids = parts(i, k, a) + parts(k + 1, t, b)
            return kids if self.labels[c].endswith("|") else [f"({self.labels[c]} {' '.join(kids)})"]

        return " ".join(parts(0, n - 1, int(final.argmax())))


def _with_lexicon(sentences: DataFrame, rules: DataFrame) -> DataFrame:
    """sent_id, words and per word its (label, p); words without a rule take their signature's.

    Words meet the lexicon in a join, as it grows with the corpus; a sentence is
    gathered again by its id.
    """
    lexicon = rules.where("kind = 'X'").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("parent", "p"))).alias("entry")).select(F.col("a").alias("key"), "entry")
    w = sentences.select("sent_id", F.posexplode("words").alias("pos", "word"))
    kinds = w.select("word").distinct().withColumn("sig", grammar.suffix_signature("word"))
    known = kinds.join(lexicon, kinds["word"] == lexicon["key"], "left").select("word", "sig", "entry")
    unknown = lexicon.select(F.col("key").alias("sig"), F.col("entry").alias("other"))
    known = known.join(unknown, "sig", "left").select("word", F.coalesce("entry", "other").alias("entry"))
    rows = w.join(known, "word").groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "entry"))).alias("x"))
    return rows.select("sent_id", F.expr("transform(x, y -> y.word)").alias("words"), F.to_json(F.expr("transform(x, y -> transform(coalesce(y.entry, array()), e -> array(e.parent, cast(e.p as string))))")).alias("lex"))


def _chart(rules: DataFrame) -> Chart:
    """Rules between labels, gathered after a check of their number; the lexicon stays distributed."""
    small = rules.where("kind in ('Cr', 'CC')").unionByName(rules.where("kind = 'X'").select(F.lit("tag").alias("kind"), "parent", F.lit("-").alias("a"), F.lit("-").alias("b"), F.lit(0.0).alias("p")).distinct())
    made = small.limit(grammar.MAX_RULES + 1).toPandas()
    if len(made) > grammar.MAX_RULES:
        raise ValueError(f"more than {grammar.MAX_RULES} rules between labels")
    return Chart(made)


def parse(sentences: DataFrame, rules: DataFrame, trees: bool = True) -> DataFrame:
    """sent_id, tree (null where there is none) and bits, an array of one value a word.

    ``sentences`` has sent_id, unique, and words; sentences that are null or empty are left out.
    """
    import json

    chart = sentences.sparkSession.sparkContext.broadcast(_chart(rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s, words, lex in zip(batch["sent_id"], batch["words"], batch["lex"]):
                lexicon = [[(label, float(p)) for label, p in row] for row in json.loads(lex)]
                out.append((s, chart.value.best(list(words), lexicon) if trees else None, chart.value.surprisal(lexicon)))
            yield pd.DataFrame(out, columns=["sent_id", "tree", "bits"])

    return _with_lexicon(sentences, rules).mapInPandas(run, "sent_id string, tree string, bits array<double>")


def _imputed_totals(bits: np.ndarray) -> np.ndarray:
    """Sums of rows after what ``imputed`` replaces."""
    finite = np.isfinite(bits)
    some = finite.any(1)
    top = np.where(some, np.max(np.where(finite, bits, -np.inf), 1), 10.0)
    mean = np.where(some, np.where(finite, bits, 0.0).sum(1) / np.maximum(finite.sum(1), 1), 10.0)
    return np.where(finite, bits, np.where(np.isnan(bits), mean[:, None], top[:, None] + 1.5)).sum(1)


def totals(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Sentence, bits and n, its words, of distinct texts (column ``text``): sums of imputed surprisals.

    Words meet the lexicon in a join and come back under two hashes of their text, 128 bits in all, which
    is put together again from them. Sentences of one length share array operations.
    """
    chart = texts.sparkSession.sparkContext.broadcast(_chart(rules))
    lexicon = rules.where("kind = 'X'").groupBy("a").agg(F.collect_list(F.struct("parent", "p")).alias("entry")).select(F.col("a").alias("word"), "entry")
    w = texts.select(F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("g"), F.posexplode(F.split("text", " ")).alias("pos", "word"))
    # A word without a rule of its own takes its signature's: there are few signatures.
    others = F.broadcast(lexicon.select(F.col("word").alias("sig"), F.col("entry").alias("other")).where(F.col("sig").isin(*grammar.signatures())))
    kinds = w.select("word").distinct().join(lexicon, "word", "left").withColumn("sig", grammar.suffix_signature("word")).join(others, "sig", "left")
    known = kinds.select("word", F.coalesce("entry", "other").alias("entry"))
    rows = w.join(known, "word").groupBy("h", "g").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "entry"))).alias("x"))
    rows = rows.select(F.expr("array_join(transform(x, y -> y.word), ' ')").alias("text"), F.expr("transform(x, y -> size(coalesce(y.entry, array())))").alias("sizes"),
                       F.expr("flatten(transform(x, y -> coalesce(y.entry, array())))").alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chart.value
        for batch in batches:
            sizes, entries = batch.column(1), batch.column(2).flatten()
            n = pc.list_value_length(sizes).to_numpy()
            names = pc.dictionary_encode(entries.field("parent"))
            at = np.array([c.at.get(x, -1) for x in names.dictionary.to_pylist()], np.int64)
            label = at[names.indices.to_numpy()] if len(entries) else np.zeros(0, np.int64)
            word = np.repeat(np.arange(int(n.sum())), sizes.flatten().to_numpy())
            masses = np.zeros((int(n.sum()), len(c.labels)))
            np.add.at(masses, (word[label >= 0], label[label >= 0]), entries.field("p").to_numpy()[label >= 0])
            start, out = np.cumsum(n) - n, np.zeros(len(n))
            for length in np.unique(n).tolist():
                same = np.flatnonzero(n == length)
                for i in range(0, len(same), TOGETHER):
                    x = same[i : i + TOGETHER]
                    out[x] = _imputed_totals(c.surprisals(masses[start[x][:, None] + np.arange(length)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(n.astype(np.int64))], ["Sentence", "bits", "n"])

    return rows.mapInArrow(run, "Sentence string, bits double, n bigint")


def imputed(bits: DataFrame, value: str = "bits", sentence: str = "sent_id") -> DataFrame:
    """Replace infinite values by the sentence's largest finite one plus 1.5 and NaN by its finite mean.

    A sentence without a finite value counts as one whose only value is 10.
    """
    w = Window.partitionBy(sentence)
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    top, mean = F.coalesce(F.max(finite).over(w), F.lit(10.0)), F.coalesce(F.avg(finite).over(w), F.lit(10.0))
    return bits.withColumn(value, F.when(F.isnan(value) | F.col(value).isNull(), mean).when(F.abs(value) == float("inf"), top + 1.5).otherwise(F.col(value)))


def surprisal_scores(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Add Surprisal_Reference, Surprisal_Variant and Delta_Surprisal to variant rows; every text is parsed once."""
    from .scorers import delta

    texts = pairs.select(F.explode(F.array("Reference_Sentence", "Variant_Sentence")).alias("sent_id")).distinct()
    bits = parse(texts.withColumn("words", F.split("sent_id", " ")), rules, trees=False)
    total = imputed(bits.select("sent_id", F.explode("bits").alias("bits"))).groupBy("sent_id").agg(F.sum("bits").alias("s"))
    for side in ("Reference", "Variant"):
        pairs = pairs.join(total.select(F.col("sent_id").alias(f"{side}_Sentence"), F.col("s").alias(f"Surprisal_{side}")), f"{side}_Sentence", "left")
    return pairs.withColumn("Delta_Surprisal", delta("Surprisal_Reference", "Surprisal_Variant"))
