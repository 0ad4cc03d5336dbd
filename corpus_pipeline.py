"""From documents to token ids: toxicity, line dedup, near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return the columns of documents.

Every stage takes an empty table (and gives one back), nulls in any column, texts of any length, repeated rows and
further columns, which it passes on. How each treats null and empty texts, ties and rows without doc_id stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvlake.llm import lines, minhash, mixing, pieces, toxicity
from kvlake.llm.shared import drop, keep, scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go, a score of 0.5 too; the classifier learns from labels of these documents, held-out ones aside.

    Null and empty texts score alike; without labels nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("toxic_score < 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose blocks that an earlier document holds; all documents stay, copies with empty texts. Null texts stay null, rows without doc_id as they are."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 stays, that of the smallest doc_id, with all rows that repeat it. Null and empty texts, and rows without doc_id, are in no group."""
    return minhash.keep_one(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, in whole documents; those without words don't come. A null source is a source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with token_ids, the end id last, of each row; a null text has that id alone."""
    return pieces.encode_documents(docs).drop("decoded")


STAGES = [("toxicity", toxic), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("mixing", mix), ("sentencepiece", encode)]

#: SQL can't express the classifier, the alignment or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and removed once the next is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            made = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"), hold=True)
        drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
