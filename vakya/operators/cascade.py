"""The seven-stage sentence filter cascade in one pass, passed-sentence features and the corpus summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.barrier import settled

#: Root tags that pass by default (fixed values).
ROOT_POS = ("VERB", "AUX", "VM", "VAUX")
STAGES = ("Question", "Negative Sentence", "Ghost IDs", "Non-Projective Tree", "Bad Root", "Punctuation Constituent", "Fewer than")


def crossing(tokens: str = "tokens") -> Column:
    """True if two arcs of tokens with whole ids cross; root arcs don't count."""
    return F.expr(f"""exists(filter({tokens}, t -> t.id is not null and t.head <> 0), a -> exists({tokens}, b -> b.id is not null and b.head <> 0 and
        least(a.id, a.head) < least(b.id, b.head) and least(b.id, b.head) < greatest(a.id, a.head) and greatest(a.id, a.head) < greatest(b.id, b.head)))""")


def with_constituents(s: DataFrame) -> DataFrame:
    """Add root_id, root_pos and constituents: subtrees of the root's dependents to its left, in token order.

    Every token climbs to its ancestor below the root by pointer doubling; a
    token on a head cycle reaches none and belongs to no constituent.
    """
    s = settled(s, _root="try_element_at(filter(tokens, t -> t.head = 0), 1)", _ids="transform(tokens, t -> t.id)")
    s = s.withColumn("root_id", F.col("_root.id"))
    s = settled(s, _up="transform(tokens, (t, j) -> if(t.head = root_id or t.head = 0 or array_position(_ids, t.head) = 0, j + 1, cast(array_position(_ids, t.head) as int)))")
    s = settled(s, _top="aggregate(sequence(1, cast(ceil(log2(size(tokens) + 1)) as int)), _up, (a, _) -> transform(a, x -> a[x - 1]))")
    s = settled(s, constituents="""transform(filter(sequence(1, size(tokens)), p -> tokens[p - 1].head = root_id and tokens[p - 1].id < root_id),
        p -> filter(tokens, (t, j) -> _top[j] = p and t.id <> root_id))""")
    return s.withColumn("root_pos", F.col("_root.upos")).withColumn("has_root", F.col("_root").isNotNull()).drop("_root", "_ids", "_up", "_top")


def classify(sentences: DataFrame, root_pos: tuple[str, ...] = ROOT_POS, min_phrases: int = 2) -> DataFrame:
    """Add stage (1 to 7) and reason of the first filter that rejects a sentence; both null where it passes."""
    if min_phrases < 1:
        raise ValueError("min_phrases must be at least 1")
    s = with_constituents(sentences)
    allowed = "/".join(root_pos)
    cheap = [
        F.col("text").contains("?") | F.expr("exists(tokens, t -> t.upos = 'WQ' or t.feats['PronType'] = 'Int')"),
        F.expr("exists(tokens, t -> t.upos = 'NEG' or t.feats['Polarity'] = 'Neg')"),
        F.expr("exists(tokens, t -> t.id is null)"),
    ]
    early = F.lit(None).cast("int")
    for k, test in reversed(list(enumerate(cheap, 1))):
        early = F.when(F.coalesce(test, F.lit(False)), k).otherwise(early)
    # Arcs are compared pair by pair only where the flat tests reject nothing, and once.
    s = settled(s, _early=early)
    s = settled(s, _crossed=F.when(F.col("_early").isNull(), crossing()))
    tests = [*((F.col("_early") == k, F.lit(name)) for k, name in enumerate(STAGES[:3], 1)),
        (F.col("_crossed"), F.lit("Non-Projective Tree")),
        (~F.col("has_root") | ~F.coalesce(F.col("root_pos").isin(*root_pos), F.lit(False)),
         F.when(~F.col("has_root"), "Bad Root: No root token found").otherwise(F.concat(F.lit("Bad Root: Root POS is '"), F.coalesce("root_pos", F.lit("None")), F.lit(f"', expected {allowed}")))),
        (F.expr("exists(flatten(constituents), t -> t.head = root_id and t.deprel = 'punct')"), F.lit("Punctuation Constituent")),
        (F.size("constituents") < min_phrases, F.lit(f"Fewer than {min_phrases} preverbal phrase{'' if min_phrases == 1 else 's'}")),
    ]
    stage = reason = None
    for k, (test, text) in enumerate(tests, 1):
        hit = F.coalesce(test, F.lit(False))
        stage = F.when(hit, k) if stage is None else stage.when(hit, k)
        reason = F.when(hit, text) if reason is None else reason.when(hit, text)
    return s.withColumn("stage", stage).withColumn("reason", reason).drop("_early", "_crossed")


def rejected(classified: DataFrame) -> DataFrame:
    return classified.where("stage is not null").select(F.col("sent_id").alias("Sent_ID"), F.col("text").alias("Sentence"), F.col("reason").alias("Reason"), "stage")


def deprels(constituents: str = "constituents", root: str = "root_id") -> Column:
    """Relation of each constituent's first token that attaches to the root, else UNKNOWN."""
    return F.expr(f"transform({constituents}, c -> coalesce(try_element_at(filter(c, t -> t.head = {root}), 1).deprel, 'UNKNOWN'))")


def bigrams(labels: str) -> Column:
    return F.expr(f"if(size({labels}) < 2, cast(array() as array<struct<a:string,b:string>>), zip_with(slice({labels}, 1, greatest(size({labels}) - 1, 0)), slice({labels}, 2, greatest(size({labels}) - 1, 0)), (a, b) -> named_struct('a', a, 'b', b)))")


def passed_features(classified: DataFrame) -> DataFrame:
    p = settled(classified.where("stage is null"), _d=deprels())
    return p.select(
        F.col("sent_id").alias("Sent_ID"), F.col("text").alias("Sentence"), F.col("root_id").alias("Root_ID"), F.size("constituents").alias("Phrase_Count"),
        F.length("text").alias("Character_Length"), F.expr("size(filter(tokens, t -> t.id is not null))").alias("Sentence_Length"),
        F.expr("transform(constituents, c -> size(c))").alias("Constituent_Lengths"), F.col("_d").alias("Deprel_Tags"), bigrams("_d").alias("Grammatical_Pairs"))


def rendered(features: DataFrame) -> DataFrame:
    """Feature arrays as the text that a CSV sink shows."""
    q = "concat('[', array_join(transform({0}, x -> concat('''', x, '''')), ', '), ']')"
    return (features.withColumn("Constituent_Lengths", F.expr("concat('[', array_join(transform(Constituent_Lengths, x -> cast(x as string)), ', '), ']')"))
            .withColumn("Deprel_Tags", F.expr(q.format("Deprel_Tags")))
            .withColumn("Grammatical_Pairs", F.expr("concat('[', array_join(transform(Grammatical_Pairs, x -> concat('(''', x.a, ''', ''', x.b, ''')')), ', '), ']')")))


def filter_counts(classified: DataFrame) -> DataFrame:
    """Rejections of every stage in order, zeros included."""
    return named_counts(classified.groupBy("stage").agg(F.count("*").alias("n")))


def named_counts(counts: DataFrame) -> DataFrame:
    """Every stage's name and count, from stage and n; stages without a row have 0."""
    names = counts.sparkSession.createDataFrame([(k, n) for k, n in enumerate(STAGES, 1)], "stage int, filter string")
    return names.join(counts, "stage", "left").select("stage", "filter", F.coalesce("n", F.lit(0)).alias("rejected"))


def summary(classified: DataFrame) -> DataFrame:
    """One row of totals, rates and averages; zeros for an empty corpus."""
    passed = F.col("stage").isNull()
    a = classified.agg(
        F.count("*").alias("total_input"), F.count(F.when(passed, 1)).alias("total_passed"), F.count("stage").alias("total_rejected"),
        F.avg(F.when(passed, F.expr("size(filter(tokens, t -> t.id is not null))"))).alias("len"), F.avg(F.when(passed, F.size("constituents"))).alias("phr"))
    return _rounded(a)


def rates(totals: DataFrame) -> DataFrame:
    """The summary from sums over parts of a corpus: sentences in all and passed, words and phrases of passed ones."""
    t = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "passed", "words", "phrases")])
    return _rounded(t.select(F.col("total").alias("total_input"), F.col("passed").alias("total_passed"), (F.col("total") - F.col("passed")).alias("total_rejected"),
                             F.try_divide("words", "passed").alias("len"), F.try_divide("phrases", "passed").alias("phr")))


def _rounded(a: DataFrame) -> DataFrame:
    return a.select("total_input", "total_passed", "total_rejected",
                    F.coalesce(F.bround(F.try_divide(F.col("total_passed"), F.col("total_input")), 4), F.lit(0.0)).alias("pass_rate"),
                    F.coalesce(F.bround("len", 2), F.lit(0.0)).alias("avg_sentence_length"), F.coalesce(F.bround("phr", 2), F.lit(0.0)).alias("avg_phrase_count"))
