"""A training-data pipeline over ``documents``: quality, near duplicates, benchmark leaks, personal data, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the
last also says how its sample was drawn. ``run`` applies them in order, each to the written result of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipehat.llm import decontaminate, mixing, pii, quality, simhash_sets
from pipehat.llm.common import forget, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts.

    Null and empty texts are scored as one empty chunk, very long ones over all their chunks; rows of equal text are decided
    alike, repeated ones and those without an id too. An empty table gives an empty one; of other columns none is kept.
    """
    net = quality.quality_network(spark, sf_dir)
    return quality.scored(docs.select(*COLUMNS), net).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8 or more) one row.

    It is the row with the smallest id, and of that id's texts the one with the smallest digest; of rows that are the same in both,
    the least by their other columns. Rows are told apart by id and text, so other texts of an id stay. Rows without an id come
    last in their group; rows without an id and a text stay; texts without words, null ones too, are one group. Very long texts are compared whole.
    An empty table gives an empty one; of other columns none is kept.
    """
    docs = docs.select(*COLUMNS)
    nothing = F.col("doc_id").isNull() & F.col("text").isNull()
    found = written(simhash_sets.near_duplicates(docs.where(~nothing)), "groups")
    best = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("best"))
    stays = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.key") == F.col("key"))
    marked = found.join(best, "root").groupBy("doc_id", "key").agg(F.first(stays).alias("stays"), F.count("*").alias("n"))
    odd = written(marked.where("not stays or n > 1").select(F.col("doc_id").alias("odd_id"), F.col("key").alias("odd_key"), "stays"), "odd")
    forget(found)
    same = F.col("doc_id").eqNullSafe(F.col("odd_id")) & (F.col("key") == F.col("odd_key"))
    rows = docs.where(~nothing).withColumn("key", simhash_sets.key(F.col("text")))
    kept = rows.join(simhash_sets.small(odd, odd.count()), same, "left_anti").select(*COLUMNS)
    again = odd.where("stays")
    if not again.isEmpty():  # of repeated rows, one stays
        least = rows.join(again, same, "left_semi").groupBy("doc_id", "key").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
        kept = kept.union(least.select("doc_id", "row.*").select(*COLUMNS))
    return kept.union(docs.where(nothing))


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; very long ones are searched whole; rows of equal text are decided alike, repeated ones and
    those without an id too. Without any item all stay; an empty table gives an empty one; of other columns none is kept.
    """
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and ``n_chars`` to match.

    Null texts stay null, empty ones empty, very long ones are scanned whole. Spans that tie or overlap become one, of the first kind. Rows are independent:
    repeated ones and those without an id stay. An empty table gives an empty one; of other columns none is kept.
    """
    return pii.redacted(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target mixture of sources, languages and topics; see ``mixing.mixed``.

    Null sources and languages are values of their own; null, empty and wordless texts have no tokens, and are sampled only where their
    cell has some. Rows of one id draw alike; a null id draws 0. Very long texts count all their tokens. An empty table gives an empty one.
    """
    out = mixing.mixed(docs.select(*COLUMNS)).where("sampled")
    return out.select(*COLUMNS, F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), "probability", "weight")


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("leaks", no_leaks), ("personal_data", no_personal_data), ("mixture", mixture)]

#: No SQL expresses the network, the fingerprints or the trees; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what a stage wrote is deleted once the next one is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
