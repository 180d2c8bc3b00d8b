"""A pipeline over `documents`: quality classifier, quality rules, MinHash near-dedup, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and but for the
last returns the columns of documents. run() writes each stage's rows to the shared folder and reads them
back as the next one's input; a stage's rows are deleted once the stage after it is written. What the last
stage reads stays, as its rows are made when the caller asks for them.

Defined cases, for every stage: an empty table gives an empty table; columns beyond doc_id and text are
carried as they are, whatever their names; a text of any length is treated as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import near_duplicates, packing, quality_crf, quality_rules, suffix_dedup
from quernel.llm.common import cut, documents, forget, fresh, held_out, labels

#: The classifier, the differencing and the suffix order can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the line classifier scores at 0.5 or more; it is fitted on docs and their labels, held-out rows aside.

    Null and empty texts are one empty line and are judged as such; equal texts are judged alike; without any
    label every row stays; rows without doc_id are judged by their text.
    """
    model = quality_crf.fit(docs, labels(spark, sf_dir), held_out("doc_id", 3, 1))
    return quality_crf.keep_good(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules. Null, empty and short texts (below 50 words) go; equal texts are judged alike."""
    return quality_rules.keep_passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id.

    Null and empty texts are linked with nothing and stay; rows without doc_id stay; repeated rows with one doc_id
    share its fate; ties can't occur, as ids differ.
    """
    name = fresh(docs, "gone")
    gone = near_duplicates.near_duplicates(docs).filter("not kept and doc_id is not null").select(F.col("doc_id").alias(name))
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone[name], "left_anti")


def suffix_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with repeated passages cut out of text and n_chars, where there is one, counted anew.

    A passage is a maximal run of bytes covered by strings of suffix_dedup.PASSAGE (200) bytes that occur twice or
    more, if it holds PASSAGE_WORDS (51) words or more; every occurrence goes. Null texts stay null, a text that is one
    passage becomes empty, shorter texts stay as they are; rows without doc_id are cut as the others.
    """
    out = suffix_dedup.drop_repeats(docs, suffix_dedup.PASSAGE, suffix_dedup.PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document in a sequence of 4096 tokens. Null and empty texts are the end id alone;
    equal rows are packed each on their own."""
    return packing.with_digest(packing.pack(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("near duplicates", near_dedup),
    ("suffix dedup", suffix_cut),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
