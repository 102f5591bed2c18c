"""Corpus pipeline: five stages over ``documents``, each one of the operators.

quality classifier -> n-gram Jaccard join -> substring dedup -> benchmark decontamination
-> packing. Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written as Parquet before the next one reads it. All but the last return the columns
of ``documents``; the last returns the packed pieces with their ids.

Defined results. A row is told by its id and text, and the stages run on that key, so null
and repeated ids lose nothing and escape nothing:
- Rows that repeat id and text count as one: the near-duplicate stage keeps one of them.
- Rows that share an id but not a text are one node there (one text of its group stays); in
  the other stages each is judged by its own text.
- Rows without id are documents of their own, after all others: a copy of a document with
  an id goes, of several copies without id one stays, passages that a document with an id
  holds are cut, and a benchmark item removes the row that holds it and no other.
- Null and blank texts score as empty ones; of those that pass, nothing is cut and none goes
  (nothing was removed from them); packing gives each the end id alone.
- An empty table passes through every stage; columns other than those of ``documents`` are
  dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import decontaminate, jaccard_join, packing, quality, shared, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df``, whose last step sends texts to Python, written with batches bounded by bytes."""
    with shared.arrow_batches(df.sparkSession):
        return shared.staged(df, name)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    model = quality.quality_model(docs, _table(spark, sf_dir, "labels"))
    return _written(quality.score(docs.select(*COLUMNS), model, score_col="_score").where("_score >= 0.5").drop("_score"), "scored")


def _tagged(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, and a tag of its id and text."""
    key = jaccard_join.row_key("doc_id", "text")
    return docs.select(*COLUMNS, key.alias("_row"), jaccard_join.row_tag(key, "text").alias("_tag"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each linked group stays, one row of it."""
    found = jaccard_join.jaccard_components(docs.select(*COLUMNS), nodes_too=True)
    found = shared.staged(found.select("n_shingles", "least", "node", F.col("tag").alias("_tag")), "nodes")
    linked = found.where("n_shingles > 0")
    first = linked.groupBy("least").agg(F.min(F.struct("node", "_tag"))["_tag"].alias("_tag")).select("_tag")
    copies = shared.staged(linked.select("_tag").distinct().join(first, "_tag", "left_anti"), "copies")
    stays = shared.on_ids(_tagged(docs), copies, "_tag", "left_anti")
    again = shared.staged(found.groupBy("_tag").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("_tag"), "again")
    if again.isEmpty():
        return stays.select(*COLUMNS)
    single = shared.on_ids(stays, again, "_tag", "left_anti").select(*COLUMNS)
    once = shared.on_ids(stays, again, "_tag", "left_semi").groupBy("_tag").agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return single.unionByName(once.select("r.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go, and documents of which nothing else was there. Texts that
    lose nothing keep their white space."""
    cut = substring_dedup.substring_dedup(_tagged(docs), id_col="_row").where("n_removed = 0 or n_words > n_removed")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return _written(cut.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars")), "cut")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = _tagged(docs)
    found = decontaminate.leaks(rows.select("_tag", "text"), _table(spark, sf_dir, "benchmark"), id_col="_tag").select("_tag").distinct()
    return shared.on_ids(rows, shared.staged(found, "leaks"), "_tag", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing_stage),
]

# Stages that write their result themselves.
WRITTEN = (quality_classifier, repeated_passages)

# Trained scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if stage in WRITTEN else shared.staged(out, f"stage{i}")
    return docs
