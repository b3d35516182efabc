"""Column-adding scorers over variant rows, and their oriented deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.barrier import settled
from . import registry

#: Annotation schemes: relations and tags that scorers look for (fixed values).
SCHEMES = {
    "ud": {"subject": ["nsubj"], "object": ["obj", "iobj"], "content": ["NOUN", "PROPN", "VERB", "ADJ", "ADV"], "pronoun": ["PRON"]},
    "paninian": {"subject": ["k1"], "object": ["k2", "k4"], "content": ["NN", "NNP", "VM", "JJ", "RB"], "pronoun": ["PRP"]},
}


def delta(reference: str, variant: str, label: str = "ML_Label") -> Column:
    """Reference minus variant, turned round where the label is 0."""
    return F.when(F.col(label) == 0, F.col(variant) - F.col(reference)).otherwise(F.col(reference) - F.col(variant))


def _vector(tokens: str, constituents: str, root: str) -> str:
    total = f"aggregate(filter({tokens}, t -> t.id is not null and t.head <> 0 and t.id <> t.head), 0, (a, t) -> a + abs(t.id - t.head) - 1)"

    def distance(back: int) -> str:
        return f"coalesce(greatest(0, abs(try_element_at(filter(try_element_at({constituents}, {back}), t -> t.head = {root}), 1).id - {root}) - 1), 0)"

    def size(back: int) -> str:
        return f"coalesce(if(try_element_at({constituents}, {back}) is null, 0, size(try_element_at({constituents}, {back}))), 0)"

    return f"array({total}, {distance(-1)}, {distance(-2)}, {size(-1)}, {size(-2)})"


def dependency_length(variants: DataFrame) -> DataFrame:
    """Add Ref_Features and Var_Features; an order is renumbered before it is measured."""
    light = "transform({0}, t -> named_struct('id', t.id, 'head', t.head))"
    v = settled(variants, _new=light.format("concat(prefix, flatten(transform(perm, i -> constituents[i])), suffix)"))
    v = settled(v, _ids="transform(_new, t -> t.id)")
    v = settled(v, _tree="transform(_new, (t, j) -> named_struct('id', j + 1, 'head', if(t.head = 0, 0, cast(array_position(_ids, t.head) as int))))",
                _root="cast(array_position(_ids, root_id) as int)", _consts="transform(perm, i -> transform(constituents[i], t -> named_struct('id', cast(array_position(_ids, t.id) as int), 'head', cast(array_position(_ids, t.head) as int))))")
    v = settled(v, Ref_Features=_vector("tokens", "constituents", "root_id"), Var_Features=_vector("_tree", "_consts", "_root"))
    return (v.withColumn("_r", F.col("Ref_Features")[0]).withColumn("_v", F.col("Var_Features")[0]).withColumn("Delta_DL", delta("_r", "_v"))
            .drop("_new", "_ids", "_tree", "_consts", "_root", "_r", "_v"))


def _strings(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def content_lemmas(scheme: dict, tokens: str = "tokens") -> Column:
    return F.expr(f"transform(filter({tokens}, t -> array_contains({_strings(scheme['content'])}, t.upos) and coalesce(t.lemma, '') not in ('', '_')), t -> t.lemma)")


def context_lemmas(corpus: DataFrame, scheme: dict, n: int = 1) -> DataFrame:
    """doc_id, k and the content lemmas of the ``n`` sentences before, of all sentences, filtered out or not."""
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(-n, -1)
    return corpus.select("doc_id", "k", F.flatten(F.collect_list(content_lemmas(scheme)).over(w)).alias("context"))


def information_status(variants: DataFrame, corpus: DataFrame, scheme_name: str = "paninian") -> DataFrame:
    """Add IS_Reference, IS_Variant and Delta_IS: 1 given before new, -1 new before given, else 0."""
    scheme = SCHEMES[scheme_name]
    v = variants.join(context_lemmas(corpus, scheme), ["doc_id", "k"], "left").withColumn("context", F.coalesce("context", F.expr("cast(array() as array<string>)")))
    v = settled(v, _h="transform(constituents, c -> try_element_at(filter(c, t -> t.head = root_id), 1))", context="context")
    v = settled(v, _s=f"try_element_at(filter(sequence(0, size(_h) - 1), i -> array_contains({_strings(scheme['subject'])}, _h[i].deprel)), 1)")
    v = settled(v, _o=f"try_element_at(filter(sequence(0, size(_h) - 1), i -> i <> _s and array_contains({_strings(scheme['object'])}, _h[i].deprel)), 1)")

    def given(at: str) -> str:
        return (f"(array_contains({_strings(scheme['pronoun'])}, _h[{at}].upos) or exists(constituents[{at}], t -> array_contains({_strings(scheme['content'])}, t.upos) "
                f"and coalesce(t.lemma, '') not in ('', '_') and array_contains(context, t.lemma)))")

    both = "_s is not null and _o is not null"
    v = settled(v, _d=f"if({both}, cast({given('_s')} as int) - cast({given('_o')} as int), 0)")
    v = v.withColumn("IS_Reference", F.expr(f"if({both}, if(_s < _o, _d, -_d), 0)"))
    v = v.withColumn("IS_Variant", F.expr(f"if({both}, if(array_position(perm, _s) < array_position(perm, _o), _d, -_d), 0)"))
    return v.withColumn("Delta_IS", delta("IS_Reference", "IS_Variant")).drop("context", "_h", "_s", "_o", "_d")


registry.scorer("dependency_length")(dependency_length)
registry.scorer("information_status")(information_status)
