"""A corpus pipeline: documents through five stages, each a table in the shared folder.

Toxic and low-quality documents go, one document of each group of near
duplicates stays, byte strings that repeat across what is left are cut out, and
the rest is packed into training sequences.  Each stage works on all rows that
the one before it kept; all but the last return the columns of their input.

Every stage takes a table with ``doc_id`` and ``text`` and any other columns, of
any names and types, which it passes on.  An empty table gives an empty table
with the same columns.  Texts are read whole, however long; a null text counts as
an empty one and stays null where its row is kept.  A row with a null key is
judged and packed like any other, but is no copy of anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm._shared import by_likely, row_name, through_table
from veil.llm.near_dups import near_duplicates
from veil.llm.packing import pack_documents
from veil.llm.queries import tokenizer_path
from veil.llm.repeats import remove_repeats
from veil.llm.repetition import quality
from veil.llm.toxicity import held_out, scored, trained

SEQUENCE = 2048


def _kept(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The carried columns under their own names."""
    return rows.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score below 0.5.

    The model learns from labels of rows that are not held out.  Repeated rows get the same score, a tie at 0.5 goes, null and empty texts have the bias alone as score.
    """
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return _kept(scored(docs, model, keep=tuple(docs.columns)).where("score < 0.5"), docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged by itself; null and empty texts have too few words and go."""
    return _kept(quality(docs, keep=tuple(docs.columns)).where("kept"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest key.

    Of rows equal in key and text one stays, the least by all its columns written as JSON.  Only rows that go or repeat are joined; the others pass without a shuffle.
    """
    judged = near_duplicates(docs).groupBy("row").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
    touched = through_table(spark, judged.where("NOT kept OR times > 1").select("row", "kept"), "touched")
    rows = docs.select(row_name(F.col("doc_id"), F.col("text")).alias("row"), F.struct("*").alias("whole"))
    some, others = by_likely(rows, "row", touched)
    left = some.join(touched, "row", "left").where("kept IS NULL OR kept")
    one = left.groupBy("row").agg(F.min_by("whole", F.to_json("whole")).alias("whole")).select("whole.*")
    return others.select("whole.*").unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with texts without their repeated strings (null texts become empty); a column n_chars follows the text.

    A character stays whole if some byte of it isn't repeated.
    """
    others = [c for c in docs.columns if c != "text"]
    cut = remove_repeats(docs, keep=tuple(others), whole_characters=True)
    new = {"text": F.col("body").cast("string")} | {c: F.col(f"kept_{i}") for i, c in enumerate(others)}
    if "n_chars" in others:
        new["n_chars"] = F.length(F.col("body").cast("string")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(new[c].alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all rows with their token ids; an empty text is the end id alone, repeated rows are packed like any others."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 0, SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the quality rules can be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that pass all stages: doc_id, piece, start, length, ids, sequence_id, offset."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = through_table(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
