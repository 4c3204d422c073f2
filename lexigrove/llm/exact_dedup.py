"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, documents, materialise, numbered, text_column


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hasher: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with byte-identical texts form a group; of each group the largest (``keep="max"``) or the
    smallest id stays. Null texts count as empty; a null id loses against any other. Rows that repeat
    both id and text are counted in ``group_size`` and are all marked kept if their id is (see
    ``drop_copies`` for one row of each). Groups are found by ``hasher`` with counts made before the
    shuffle; then every member's bytes are compared with those of the member that stays, in a join
    that Spark can split when a group is large. Members that differ (hash collisions) are grouped by
    the text itself. Empty input: empty result. Other columns of any name are ignored.
    """
    best = F.max if keep == "max" else F.min
    base = docs.select(col(id_col).alias("id"), text_column(text_col).alias("t")).withColumn("h", hasher(F.col("t")))
    groups = base.groupBy("h").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialise(groups, "dedup-groups")
    rows = base.withColumn("sha", F.sha2(F.col("t").cast("binary"), 256)).join(groups, "h", "left")
    rows = materialise(rows.select("id", "h", "sha", "keep_id", F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.when(F.col("n") > 1, F.col("t")).alias("t")), "dedup-rows")
    single = rows.where("n = 1").select("id", F.col("id").alias("keep_id"), "n", F.lit(True).alias("kept"), "sha")
    members = rows.where("n > 1")
    stays = materialise(members.where("id <=> keep_id").groupBy("h").agg(F.min("t").alias("kept_t")), "dedup-kept")
    compared = members.join(stays, "h", "left").withColumn("same", F.col("t") == F.col("kept_t"))
    # a group's size and id hold as they are unless some member differs
    other = materialise(compared.where("not same").select("id", "h", "sha", "t"), "dedup-collisions")
    if other.isEmpty():
        whole = compared.select("id", "keep_id", "n", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")
        return _named(single.unionByName(whole), id_col)
    lost = other.groupBy("h").agg(F.count(F.lit(1)).alias("lost"))
    # texts that equal the kept one may have another best id than the whole hash group had
    same = compared.where("same").join(lost, "h", "left")
    same = same.select("id", "keep_id", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")
    regrouped = other.groupBy("h", "t").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    apart = other.join(regrouped, ["h", "t"]).select("id", "keep_id", "n", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")
    return _named(single.unionByName(same).unionByName(apart), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "keep_id", F.col("n").cast("long").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, one stays."""
    marks = exact_dedup(docs, id_col, text_col, keep).where("kept")
    marks = materialise(marks.groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.count(F.lit(1)).alias("_times")), "dedup-stay")
    plain, names = numbered(docs)
    keyed = plain.withColumns({"_key": col(names[id_col]), "_text": F.sha2(text_column(names[text_col]).cast("binary"), 256)})

    def of(condition: str) -> DataFrame:
        return keyed.join(marks.where(condition), F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha")), "left_semi")

    stay = of("_times = 1").unionByName(of("_times > 1").dropDuplicates(["_key", "_text"]))
    return stay.drop("_key", "_text").toDF(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
