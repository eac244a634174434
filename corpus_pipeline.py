"""The corpus pipeline: quality, near copies, repeated passages, secrets, packing; one operator per stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet to the shared
folder and reads them back as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from tallyloom.llm import ngram_join, packing, passages, quality, secrets
from tallyloom.llm.frames import table
from tallyloom.llm.plans import held_out, tokenizer_path
from tallyloom.session import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more); it learns from the labels that op3 may learn from."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))
    return quality.accepted(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; texts without words and rows without id stay.

    Rows that share an id are in one group, so one of them stays: the one with the least text.
    """
    groups = written(ngram_join.link_groups(docs), "groups")
    gone = written(groups.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = groups.where("component_id = doc_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = written(again, "repeated-ids")
    if again.isEmpty():
        return kept
    single = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    several = kept.join(again, "doc_id", "left_semi").withColumn("__words", F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    first = several.where("__words").groupBy("doc_id").agg(F.min(F.struct("text", *(c for c in docs.columns if c != "text"))).alias("row"))
    return single.unionByName(first.select("row.*").select(*docs.columns)).unionByName(
        several.where("not coalesce(__words, false)").select(*docs.columns)
    )


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the later ones."""
    return passages.without_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; ``n_chars`` follows where a text changes."""
    return secrets.redact(docs, n_chars="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of at most 4096 tokens."""
    limits = packing.Limits()
    cut = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), "words", 1, limits.tokens, with_ids=False)
    return packing.pack(cut, limits)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", cut_repeats),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: The stages fit a model, encode tokens and compress: SQL can't express them; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
