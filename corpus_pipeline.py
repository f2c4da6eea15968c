"""A corpus prepared for training: toxic documents go, near duplicates and repeated passages
go, sources are mixed to their targets, and the mix is encoded.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage before kept and
returns the columns of ``documents``; the last one returns the encoded documents. ``run``
writes each stage to the shared folder and reads it back, so a lost executor costs no more
than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from farewheel.llm import fair_mixing, fm_dedup, rank_array_bpe, toxicity_pu, trie_join
from farewheel.llm.queries import documents, table, tokenizer
from farewheel.llm.staging import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    scored = toxicity_pu.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, and every document
    that is like no other. Of repeated rows one stays; rows without id all stay. Different texts
    under one id are documents of their own: they are joined and removed by a 64-bit mark of id
    and text, and of near duplicates under one id the one with the smallest mark stays."""
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.select(*COLUMNS, key.alias("row_key"))
    components = staged(trie_join.jaccard_components(keyed.select(F.col("row_key").alias("doc_id"), "text")), "components")
    tied = components.filter("doc_id <> component_id").select(F.col("doc_id").alias("row_key"), "component_id")
    members = tied.union(tied.select("component_id", "component_id")).distinct()
    ids = members.join(keyed.select("row_key", "doc_id").distinct(), "row_key")
    first = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("first")).select(F.col("first.row_key").alias("row_key"))
    others = members.select("row_key").join(first, "row_key", "left_anti")
    left = keyed.join(others, "row_key", "left_anti")
    copies = components.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if copies.isEmpty():
        return left.select(*COLUMNS)
    first = Window.partitionBy("doc_id", "text").orderBy("source", "lang", "n_chars")
    return left.withColumn("copy", F.row_number().over(first)).filter("copy = 1 OR doc_id IS NULL").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id holds as well."""
    cut = fm_dedup.remove_repeats(docs, keep_text=True, keep=("lang", "source"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    key = ["doc_id", "source", "size"]
    sized = docs.select(*COLUMNS, fair_mixing.word_count(F.col("text")).alias("size"))
    taken = fair_mixing.fair_mix(sized.select(*key)).filter("taken > 0").groupBy(*key).agg(
        F.sum(F.expr("taken div size")).alias("takes"))
    same = None
    for c in key:
        equal = F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}"))
        same = equal if same is None else same & equal
    joined = sized.alias("d").join(taken.alias("t"), same).select("d.*", "takes")
    # rows that agree in id, source and size share what they take
    alike = Window.partitionBy(*key)
    rank = F.row_number().over(alike.orderBy("text"))
    rows = joined.withColumn("rows", F.count("*").over(alike)).withColumn("rank", rank)
    times = F.expr("takes div rows + IF(rank <= takes % rows, 1, 0)").cast("int")
    return rows.withColumn("times", times).filter("times > 0").select(
        *COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and decoded text."""
    return rank_array_bpe.bpe_encode(docs, tokenizer("word_bpe_49k.json"), keep=("doc_id", "source"), digests=True, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]

# SQL cannot train the classifier or encode.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
