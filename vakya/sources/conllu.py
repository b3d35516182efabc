"""CoNLL-U and plain-text sources, and the CoNLL-U sink expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = ("struct<id:int,id_raw:string,form:string,lemma:string,upos:string,xpos:string,"
         "feats:map<string,string>,head:int,deprel:string,deps:string,misc:map<string,string>>")


def _pairs(field: str) -> str:
    return f"if({field} = '_' or {field} is null, null, map_from_entries(transform(filter(split({field}, '\\\\|'), p -> p like '%=%'), p -> struct(substring_index(p, '=', 1), substr(p, instr(p, '=') + 1)))))"


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """(file, k, block) to (file, k, sent_id, text, tokens). Lines with fewer than ten columns are skipped."""
    lines = blocks.withColumn("lines", F.expr(r"split(block, '\n')"))
    rows = F.expr(r"transform(filter(lines, x -> not startswith(x, '#') and size(split(x, '\t')) >= 10), x -> split(x, '\t'))")
    token = f"""cast(transform(rows, c -> named_struct('id', try_cast(c[0] as int), 'id_raw', c[0], 'form', c[1], 'lemma', c[2], 'upos', c[3], 'xpos', c[4],
        'feats', {_pairs('c[5]')}, 'head', try_cast(c[6] as int), 'deprel', c[7], 'deps', c[8], 'misc', {_pairs('c[9]')})) as array<{TOKEN}>)"""

    def meta(key: str) -> Column:
        found = F.expr(f"try_element_at(filter(lines, x -> x rlike '^#\\\\s*{key}\\\\s*='), 1)")
        return F.trim(F.regexp_replace(found, rf"^#\s*{key}\s*=", ""))

    out = lines.withColumn("rows", rows).withColumn("tokens", F.expr(token)).where(F.size("tokens") > 0)
    forms = F.expr("array_join(transform(filter(tokens, t -> t.id is not null), t -> t.form), ' ')")
    return out.select("file", "k", F.coalesce(meta("sent_id"), F.lit("Unknown_ID")).alias("sent_id"), F.coalesce(meta("text"), forms).alias("text"), "tokens")


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of CoNLL-U files: split at empty lines by the reader, so a file of any size is read in parts.

    Lines may end with CR LF, and blank lines hold blanks: parts are split again
    at those. ``k`` orders the sentences of a file, whose path is ``doc_id``.
    """
    parts = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.explode(F.split("value", r"\r?\n[ \t\r]*\n")).alias("block"))
    blocks = parts.select("file", F.monotonically_increasing_id().alias("k"), F.regexp_replace("block", r"^[ \t\r\n]+|[\r\n]+$|\r(?=\n)", "").alias("block"))
    return parse_blocks(blocks.where("block <> ''").select("file", "k", "block")).select(F.col("file").alias("doc_id"), "*")


def load_input(spark: SparkSession, source: str, parser: Callable[[str], str] | None = None) -> DataFrame:
    """Sentences of a ``.conllu`` file, a ``.txt`` file of one sentence a line, or of ``source`` itself.

    Text goes through ``parser``, which makes CoNLL-U of a sentence, in Arrow batches. Raises
    ValueError for a blank source, for text without a parser and where nothing is parsed,
    FileNotFoundError where a file is missing.
    """
    from pyspark.errors import AnalysisException

    if not source or not source.strip():
        raise ValueError("the input is blank")
    try:
        if source.endswith(".conllu"):
            found = read_conllu(spark, source)
        else:
            if parser is None:
                raise ValueError("text needs a parser")
            lines = read_lines(spark, source) if source.endswith(".txt") else spark.createDataFrame([("", 0, source.strip())], "file string, k bigint, text string")
            made = F.pandas_udf(lambda t: t.map(parser), "string")
            found = parse_blocks(lines.select("file", "k", made("text").alias("block"))).select(F.col("file").alias("doc_id"), "*")
        empty = found.isEmpty()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(source) from e
        raise
    if empty:
        raise ValueError("nothing was parsed")
    return found


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of text files, one sentence each, in reading order."""
    return spark.read.text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("k"), F.trim("value").alias("text"))


def serialise(tokens: str = "tokens") -> Column:
    """A sentence's tokens as CoNLL-U lines."""
    m = "coalesce(array_join(transform(array_sort(map_keys({0})), x -> concat(x, '=', {0}[x])), '|'), '_')"
    return F.expr(f"""array_join(transform({tokens}, t -> concat_ws('\\t', t.id_raw, coalesce(t.form, '_'), coalesce(t.lemma, '_'), coalesce(t.upos, '_'),
        coalesce(t.xpos, '_'), {m.format('t.feats')}, coalesce(cast(t.head as string), '_'), coalesce(t.deprel, '_'), coalesce(t.deps, '_'), {m.format('t.misc')})), '\\n')""")
