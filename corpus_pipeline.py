"""The corpus pipeline: from raw ``documents`` to packed token sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``. Empty tables, null texts and null ids are defined by the operators: a null text is the empty
text; it has no grade against it, no shingles, no repeats and no benchmark overlap, so it stays and is packed as its end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import ordinal, partenum, prefix_doubling, spaced_seeds
from tablescope.llm.binary_packing import pack
from tablescope.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is kept if the model finds the best grade at least so likely.
LEAST_TAIL = 0.5
#: Shingle length and similarity of near duplicates.
SHINGLE, PERCENT = 5, 80
#: Bytes of a repeated passage.
PASSAGE = 100
SEQUENCE = 2048
END_ID = 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a good expected grade; ratings come from ``labels``."""
    model = ordinal.train(docs, ordinal.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return ordinal.score(docs, model).where(F.col("tail") >= LEAST_TAIL).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id, then text, language and source. Texts without words stay.

    Rows are told apart by a hash of all their columns, not by their ids: another text under the same id is a row of its own.
    """
    docs = docs.withColumn("_row", F.xxhash64(*[x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]))
    groups = cut_lineage(partenum.similarity_components(docs, id_col="_row", k=SHINGLE, percent=PERCENT).where("n_shingles > 0")
                         .groupBy("id", "component_id").agg(F.count(F.lit(1)).alias("n")))
    several = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("component_id")
    members = cut_lineage(groups.join(several, "component_id").select("component_id", F.col("id").alias("_member")))
    few = members.count() <= partenum.BROADCAST_IDS
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2("text", 256), "lang", "source", "n_chars")
    keys = docs.select("_row", order.alias("_order")).join(F.broadcast(members) if few else members, F.col("_row") == F.col("_member"))
    kept = keys.groupBy("component_id").agg(F.min_by("_row", "_order").alias("_member")).select("_member")
    dropped = cut_lineage(members.select("_member").join(kept, "_member", "left_anti"))
    left = docs.join(F.broadcast(dropped) if few else dropped, F.col("_row") == F.col("_member"), "left_anti")
    if not groups.where("n > 1").isEmpty():
        words = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
        left = left.where(words).dropDuplicates(["_row"]).union(left.where(~words))
    return left.select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that started earlier; a document of which nothing is left goes."""
    out = prefix_doubling.cut_texts(prefix_doubling.repeated_spans(docs, length=PASSAGE, keep=["lang", "source"]))
    out = out.select(F.col("id").alias("doc_id"), "text", "payload.lang", "payload.source", "cut")
    out = out.where(~F.col("cut") | F.regexp_like("text", F.lit(r"\S")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return spaced_seeds.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=SEQUENCE, end_id=END_ID, added=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]
#: The stages cannot be expressed in SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is checkpointed, as the next one reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
