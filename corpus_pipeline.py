"""A training-data pipeline over ``documents`` in five stages, each one of the operators of ``colloquy.llm``.

``STAGES`` names them in order; a stage gets the documents that the one before it kept, written and read again, and all
but the last return the columns of ``documents``. ``run`` applies them all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.line_dedup import drop_boilerplate
from colloquy.llm.mixing import mix, word_count
from colloquy.llm.ngram_join import similarity_components
from colloquy.llm.packing import pack, tokenize_pieces
from colloquy.llm.queries import TOXIC_FROM, tokenizer_path
from colloquy.llm.toxicity import learn, score
from colloquy.session import cut, materialise, ship

#: Dropped ids are broadcast up to here and joined by a shuffle beyond.
BROADCAST_IDS = 500_000


#: Columns of ``documents`` that the stages read or write; any others pass through.
OWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def passing_others(stage: Stage) -> Stage:
    """The stage with columns that are not its business out of its way: whatever they are called, they come back as they
    were, also where an operator has a column of that name. An empty table gives an empty table."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        given = docs.columns
        return stage(spark, docs.toDF(*[c if c in OWN else f"other_column_{i}" for i, c in enumerate(given)]), sf_dir).toDF(*given)

    return run


@passing_others
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the model learns from labels that are not held out.
    Empty and null texts score 0 and stay."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).filter(F.col("score") < TOXIC_FROM).select(*[f"`{c}`" for c in docs.columns])


@passing_others
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur over their source; ``n_chars`` follows the text."""
    clean = drop_boilerplate(docs.withColumnsRenamed({"n_chars": "_n_chars"}))
    length = F.when(F.col("text").isNull(), F.col("_n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars")
    return clean.select(*[length if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@passing_others
def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates on five-word shingles at 0.8: that of the least id, where null ids come
    last, and among rows of one id that of the least text hash. Rows are told apart by id and text, so another text of
    an id that goes stays if it is in no group. Documents without words are in no group and stay; repeated rows of one
    id and text that have words become one row."""
    rows = docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text")))
    found = cut(similarity_components(rows, doc_id="_row"))
    gone = cut(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = rows.join(gone, F.col("_row") == F.col("_gone"), "left_anti")
    again = cut(found.filter("n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return kept.drop("_row")
    single = kept.join(again, F.col("_row") == F.col("_again"), "left_anti")
    return single.unionByName(kept.join(again, F.col("_row") == F.col("_again"), "left_semi").dropDuplicates(["_row"])).drop("_row")


@passing_others
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts whose words are of an odd length on average weigh a quarter."""
    per_word = F.length("text") / F.greatest(word_count(F.col("text")), F.lit(1))
    taken = mix(docs, weight=F.when(per_word.between(3, 12), 1.0).otherwise(0.25))
    rows = taken.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens."""
    return pack(tokenize_pieces(docs, tokenizer_path=tokenizer_path()))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the network nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written to the shared folder."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
