"""Documents to training sequences: language, near duplicates, repeats, mix, packing.

Each stage works on all its predecessor kept. Extra columns of documents pass
through; null and empty texts, repeated rows and empty tables are handled as
the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm import jaccard, language, mixing, packing, repeats
from estatelens.session import stored

#: Near duplicates share 80 % of their shingles of five words; op10's query has values of its own.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Passages of over 50 words that repeat go, whatever their bytes; op2's query looks at 400 bytes alone.
PASSAGE_WORDS = repeats.PASSAGE_WORDS


#: Rows of one batch to Python. Texts may be long, and what batches take outside the heap is not given back.
BATCH_ROWS = "1000"


def _small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that sends texts to Python in small batches."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; texts without letters go."""
    named = language.identify(docs, language.learn(docs))
    return named.filter("lang_pred != 'und'").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once; a null id belongs to no group."""
    groups = stored(jaccard.similar_documents(docs, NEAR_WIDTH, NEAR_PERCENT))
    kept = docs.join(groups.filter("doc_id != component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int | None = None) -> DataFrame:
    """Texts without the strings of 400 bytes, or of ``words`` whole words, that occur more than once; a character goes if all its bytes do."""
    cut = repeats.remove_repeats(docs, words=words)
    changed = {"text": F.when(F.col("text").isNotNull(), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("text").isNotNull(), F.char_length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumns(changed).select(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """:func:`cut_repeats` of passages of over 50 words too."""
    return cut_repeats(spark, docs, sf_dir, PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the columns it has."""
    taken = mixing.drawn(docs).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their token ids."""
    return packing.pack(stored(packing.tokenize(docs)), keep_ids=True)


STAGES = [
    ("language", _small_batches(keep_languages)),
    ("near_duplicates", _small_batches(keep_one_of_each)),
    ("repeats", _small_batches(cut_passages)),
    ("mix", _small_batches(mix_sources)),
    ("pack", _small_batches(pack_sequences)),
]

#: Learned languages and suffix arrays have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
