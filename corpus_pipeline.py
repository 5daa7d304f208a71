"""A training-corpus pipeline over ``documents``: five stages, each one operator of ``pointloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns they were given; those beside id and text travel in one
struct, so their names cannot clash with an operator's.  A document without an
id cannot be named in another's result: near-dedup keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.decontaminate import find_contamination
from pointloom.llm.packing import pack_documents
from pointloom.llm.pii import find_pii, mask
from pointloom.llm.scratch import materialize
from pointloom.llm.simhash import near_duplicates
from pointloom.llm.toxicity import score, train


REST = "_rest"


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one struct."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None).cast("int")).alias(REST))


def key() -> Column:
    """What tells rows apart that repeat an id: the id and a hash of the text."""
    return F.struct("doc_id", F.xxhash64("text").alias("hash"))


def unfolded(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``."""
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col(REST).getField(c).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine predicts as toxic go."""
    rows = folded(docs)
    model = train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unfolded(score(rows, model, keep=("text", REST)).filter("predicted = 0"), docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    rows = folded(docs)
    found = near_duplicates(rows.filter("doc_id is not null").select(key().alias("doc_id"), "text"))
    keepers = materialize(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id.*", "n"), "keepers")
    marked = rows.withColumn("hash", F.xxhash64("text")).join(keepers, ["doc_id", "hash"])
    kept = marked.filter("n = 1").drop("n", "hash")
    if not keepers.filter("n > 1").isEmpty():  # rows that repeat an id and a text count as one document
        kept = kept.unionByName(marked.filter("n > 1").dropDuplicates(["doc_id", "hash"]).drop("n", "hash"))
    return unfolded(kept.unionByName(rows.filter("doc_id is null")), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark phrase go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs.select(key().alias("doc_id"), "text"), benchmark)
    hit = materialize(found.filter("n_hit > 0").select(F.col("doc_id.doc_id").alias("hit_id"), F.col("doc_id.hash").alias("hit_hash")).distinct(), "hit")
    rows = folded(docs).withColumn("hash", F.xxhash64("text"))
    return unfolded(rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("hash") == F.col("hit_hash")), "left_anti"), docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars follows the text."""
    rows = folded(docs)
    out = unfolded(mask(rows, find_pii(rows)), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("decontaminate", decontaminate), ("pii", pii), ("packing", packing)]
#: Learned scores, XXH64 fingerprints and tokenizer ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
