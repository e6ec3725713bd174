"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import common, line_dedup, mixing, near_dedup, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the classifier calls toxic.

    Null, empty and blank texts have no words to judge: they score as the model's
    bias, the share of toxic labels. Null ids and repeated rows are scored each
    for its own text; tied scores of 0.5 count as toxic. Without labels, or
    with an empty table, nothing is left out. All columns stay, whatever
    their names.
    """
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated passages, and documents of nothing else.

    A changed document's n_chars is counted anew. A null id or text stays as it
    is, and so does an empty text that came empty; rows equal in id and text
    are one document and fare alike; ties of id go by a hash of the text. An
    empty table stays empty. Other columns stay.
    """
    cut = line_dedup.drop_repeated_passages(docs, words_col="_words_deleted")
    left = cut.where("_words_deleted = 0 or length(text) > 0")
    return left.withColumn("n_chars", F.when(F.col("_words_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates.

    Documents without words, and null ids, are in no group and stay. Rows that
    repeat an id stay or go together. An empty table stays empty. All columns
    stay.
    """
    later = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics meet their targets.

    Documents without words stay; a null source or language is a value of its
    own; equal ids, null ones too, fare alike. An empty table stays empty. All
    columns stay.
    """
    return mixing.mix(docs).where("mix_kept").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences.

    A null or empty text is its end mark alone; null ids and repeated rows are
    packed each on its own; an empty table gives no rows. Other columns are
    not returned.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last one's rows."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
