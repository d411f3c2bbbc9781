"""The corpus pipeline: five stages over ``documents``, each reading what the one before has kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return
the columns of ``documents``. Each stage's result is written as Parquet and reread
as the next one's input.

1. quality      documents that the classifier and their site's posterior reject go
2. ngram_join   of each group of near-duplicate documents the one with the least id stays
3. secrets      every secret span in the text is replaced by ``[secret]``, n_chars follows
4. mixing       rows are put in the order of a mix by target weights: that of the files written, and of the rows in them
5. bpe          ids under the word vocabulary, digests of ids and decoded text, and the row's place in the mix

Texts, not ids, decide in stage 2: of each group of near-duplicate texts one row
stays, that with the least id (one without an id only if none has one), and texts
without words all stay. Other columns than those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import bpe, mixing, ngram_join, quality, secret_scan
from agora.llm.common import Scratch, table

#: Ids up to this many are broadcast (8 bytes each); beyond it, joined by shuffle.
MOST_BROADCAST = 1_000_000
MASK = "[secret]"
#: The column that holds a text's class of sets for a while.
CLASS = "__class"


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    judged = quality.assess(docs, quality.learn(docs, labels))
    return judged.filter(~F.col("rejected")).select(docs.columns)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(docs, by_id=False)
    linked = found.filter("group is not null").select("doc_id", "cls", "group")
    first = linked.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "cls")).alias("first")).select("group", "first.*")
    several = found.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id")
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("cls") == F.col("_cls"))
    gone = linked.join(first.select("group", F.col("doc_id").alias("_id"), F.col("cls").alias("_cls")), "group").filter(~stays).select("doc_id")
    gone = gone.filter("doc_id is not null").distinct()
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    if several.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # an id with several rows, or a null one, doesn't tell its texts apart: these rows are judged by their sets
    repeated = several.filter("doc_id is not null")
    plain = docs.filter("doc_id is not null").join(repeated, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(docs.columns)
    odd = docs.filter("doc_id is null").unionByName(docs.join(repeated, "doc_id", "left_semi").select(docs.columns))
    classed = ngram_join.with_class(odd, CLASS)
    chosen = first.select(F.col("doc_id").alias("_id"), F.col("cls").alias("_cls"))
    kept = classed.join(chosen, (F.col(CLASS) == F.col("_cls")) & F.col("doc_id").eqNullSafe(F.col("_id"))).dropDuplicates([CLASS])
    return plain.unionByName(kept.select(docs.columns)).unionByName(classed.filter(F.col(CLASS).isNull()).select(docs.columns))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.mask_secrets(docs, mask=MASK)
    changed = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(F.contains("text", F.lit(MASK)), changed).otherwise(F.col("n_chars"))).select(docs.columns)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(docs.columns)


def with_place(docs: DataFrame) -> DataFrame:
    """Adds mix_file and mix_row: the number of the file that a row was read from and its place there, by which the
    mix is ordered. Null for rows that come from no file."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not read from files
        return docs.withColumns({"mix_file": F.lit(None).cast("int"), "mix_row": F.lit(None).cast("bigint")})
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-", 1)
    return docs.withColumns({"mix_file": F.when(number != "", number.try_cast("int")), "mix_row": F.col("_metadata.row_index")})


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    placed = with_place(docs.select("doc_id", "text"))
    return bpe.encode_decode(placed, public_tokenizers.path("word_bpe_49k.json"), digests=True, reuse=False, keep=("mix_file", "mix_row"))


STAGES = [
    ("quality", stage_quality),
    ("ngram_join", stage_ngram_join),
    ("secrets", stage_secrets),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]

#: Neither the classifier nor the encoding can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        docs = scratch.keep(stage(spark, before, sf_dir), last=k == len(STAGES) - 1)
        scratch.drop(before)
    return docs
