"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piiframe.functions.names import unused
from piiframe.llm import langid, packing, simhash, subdedup
from piiframe.llm.common import own_folder, table

#: A document whose n-grams are less like those of the nearest learned language than this goes, as
#: does one without a letter.  Typical texts have 1, letters at even chance less than 0.  Of the
#: held-out labelled rows of documents at 0.1 the least has 0.42, of all rows 0.30.
LEAST_KNOWN = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay.

    Rows whose text is null, empty or without a letter go; repeated rows stay or go together; a
    row without doc_id is judged like any other.  An empty table, or one without any label to
    learn from, gives no rows.  Other columns stay as they are, whatever their names.
    """
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    pred, score, known = unused(docs, "pred", "score", "known")
    found = langid.predict(docs, model, pred=pred, score=score, known=known)
    kept = found.where((F.col(pred) != langid.UNDETERMINED) & (F.col(known) >= LEAST_KNOWN))
    return kept.drop(pred, score, known)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles alike to 0.8) the smallest id stays.

    Null, empty and blank texts are copies of one another; a text of under five words is one
    shingle.  Rows without doc_id come last; of rows that repeat the one that stays, one stays.
    An empty table gives no rows.  Other columns stay as they are, whatever their names.
    """
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are taken out; n_chars follows the text.

    Every row stays; a null text stays null (and its n_chars as it is).  Rows without doc_id lose only their own repeats,
    rows that share a doc_id are one document.  An empty table gives no rows.  Other columns stay
    as they are, whatever their names.
    """
    names = docs.columns
    out = subdedup.dedup(docs).select(*[F.col(f"`{c}`") for c in names])
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 ids.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed as
    often as they stand there.  An empty table gives no rows.  Other columns are not read.
    """
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: The stages train a model and run Python; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is written to the shared folder and read
    again, so that a lost executor costs no earlier stage.  The last stage has read its input
    when it returns (its pieces are checkpointed), and the folder goes."""
    docs = table(spark, sf_dir, "documents")
    with own_folder(spark, "pipeline") as folder:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
