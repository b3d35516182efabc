"""A deterministic treebank over ``documents``, for queries whose results SQL can rebuild.

Every word of every text is in it: a text is cut at full stops and line ends, and what is
left between them into sentences of up to LONGEST words. Chunks, question and negation features
are given to some sentences by a hash of their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.barrier import settled
from .conllu import TOKEN

#: Words of a sentence at most; a longer stretch of text makes several.
LONGEST = 20
_CHUNKED = "h % 2 = 0 and h % 11 <> 0 and h % 13 <> 0 and h % 29 <> 0 and n >= 3"

_OWN = "if(array_contains(heads, j + 1), j + 1, array_min(filter(heads, x -> x > j + 1)))"
#: A chunk's name ends with its place; every third has no other name.
_NAME = f"concat(if({_OWN} % 3 = 0, '', 'NP'), {_OWN})"
_TOKENS = f"""cast(transform(words, (w, j) -> named_struct(
    'id', if(h % 13 = 0 and j = 1, null, j + 1), 'id_raw', if(h % 13 = 0 and j = 1, '2.1', cast(j + 1 as string)),
    'form', w, 'lemma', lower(w),
    'upos', case when h % 19 = 0 and j = 0 then 'WQ' when h % 23 = 0 and j = 0 then 'NEG'
        when j + 1 = r then if(h % 10 = 0, 'NN', 'VM') else element_at(array('NN', 'PRP', 'JJ', 'PSP'), length(w) % 4 + 1) end,
    'xpos', '_', 'feats', if(j = 0 and h % 31 = 0, map('PronType', 'Int'), if(j = 0 and h % 37 = 0, map('Polarity', 'Neg'), cast(null as map<string,string>))),
    'head', case when h % 11 = 0 and n >= 6 and j = 0 then 3 when h % 11 = 0 and n >= 6 and j = 1 then 4
        when j + 1 = r then if(h % 29 = 0, 1, 0) when j + 1 = n then r when array_contains(heads, j + 1) then r
        else array_min(filter(heads, x -> x > j + 1)) end,
    'deprel', if(h % 17 = 0 and j + 1 = coalesce(try_element_at(heads, 1), 0), 'punct', element_at(array('k1', 'k2', 'k4', 'vmod', 'k7'), length(w) % 5 + 1)),
    'deps', '_', 'misc', if({_CHUNKED}, map('ChunkId', if(j + 1 >= r, 'VGF', {_NAME}), 'ChunkType', if(j + 1 = r or array_contains(heads, j + 1), 'head', 'child')), cast(null as map<string,string>)))) as array<{TOKEN}>)"""


def treebank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, sent_id, text, tokens for every sentence; ``k`` orders the sentences of a document."""
    s = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(r"posexplode(split(text, '[.\n]+')) as (k, s)"))
    s = settled(s, all="split(trim(regexp_replace(s, '[ \t\r]+', ' ')), ' ')").where("all[0] <> ''")
    s = s.select("doc_id", "k", F.expr(f"explode(transform(sequence(0, cast((size(all) - 1) div {LONGEST} as int)), c -> named_struct('c', c, 'words', slice(all, c * {LONGEST} + 1, {LONGEST})))) as x"))
    s = s.select("doc_id", F.expr("k * 1000000L + x.c").alias("k"), "x.words").withColumn("sent_id", F.expr("concat(doc_id, '_s', k)"))
    s = settled(s, text="array_join(words, ' ')", h="cast(conv(substr(md5(sent_id), 1, 7), 16, 10) as bigint)", n="size(words)").withColumn("r", F.expr("greatest(n - 1, 1)"))
    s = settled(s, heads="if(r < 2, cast(array() as array<int>), filter(sequence(1, r - 1), i -> length(words[i - 1]) >= 5 or i = r - 1))")
    return settled(s, tokens=_TOKENS).select("doc_id", "k", "sent_id", "text", "tokens")


#: The same tokens, one row each, for DuckDB.
SQL = r"""
with s0 as (select doc_id, unnest(string_split_regex(text, '[.\n]+')) as s, generate_subscripts(string_split_regex(text, '[.\n]+'), 1) - 1 as k from documents),
sa as (select doc_id, k, string_split(trim(regexp_replace(s, '[ \t\r]+', ' ', 'g')), ' ') as ws from s0),
sb as (select doc_id, k, ws, unnest(range(0, (len(ws) - 1) // 20 + 1)) as c from sa where ws[1] <> ''),
s2 as (select doc_id, k * 1000000 + c as k, ws[c * 20 + 1 : c * 20 + 20] as words, doc_id || '_s' || (k * 1000000 + c) as sent_id from sb),
s3 as (select *, array_to_string(words, ' ') as text, len(words) as n, greatest(len(words) - 1, 1) as r, ('0x' || substr(md5(sent_id), 1, 7))::bigint as h from s2),
t0 as (select doc_id, k, sent_id, text, n, r, h, unnest(words) as form, generate_subscripts(words, 1) as i from s3),
t1 as (select *, i < r and (length(form) >= 5 or i = r - 1) as ch from t0),
t2 as (select *, min(case when ch then i end) over (partition by sent_id order by i rows between 1 following and unbounded following) as nx,
    min(case when ch then i end) over (partition by sent_id) as fc from t1),
tok as (select doc_id, k, sent_id, text, n, h, i, form, lower(form) as lemma, case when h % 13 = 0 and i = 2 then null else i end as id,
    case when h % 19 = 0 and i = 1 then 'WQ' when h % 23 = 0 and i = 1 then 'NEG' when i = r then case when h % 10 = 0 then 'NN' else 'VM' end
        else (['NN','PRP','JJ','PSP'])[length(form) % 4 + 1] end as upos,
    case when h % 11 = 0 and n >= 6 and i = 1 then 3 when h % 11 = 0 and n >= 6 and i = 2 then 4 when i = r then case when h % 29 = 0 then 1 else 0 end
        when i = n then r when ch then r else nx end as head,
    case when i = 1 and h % 31 = 0 then 'Int' end as prontype, case when i = 1 and h % 37 = 0 and h % 31 <> 0 then 'Neg' end as polarity,
    h % 2 = 0 and h % 11 <> 0 and h % 13 <> 0 and h % 29 <> 0 and n >= 3 as chunked, r, case when ch then i else nx end as own,
    case when h % 17 = 0 and i = fc then 'punct' else (['k1','k2','k4','vmod','k7'])[length(form) % 5 + 1] end as deprel from t2)
"""
