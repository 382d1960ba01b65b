"""Exact duplicates with a heavy-hitter split.

A row is reduced to the digest (SHA-256) of its text, so texts never move. A Misra-Gries summary of TRACKED counters (Spark's
approx_top_k, whose partial summaries merge like sums) gives candidates for frequent digests: each digest with more than some
7 / TRACKED of all rows is among them, and there are TOP at most. Their groups are counted exactly, which verifies them, and give a winner
each; this table of at most TOP rows is broadcast, so rows of frequent digests find their winner where they are and don't move.
The rows of all other digests, of which none is frequent, meet by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, unused

#: Counters of the Misra-Gries summary, and most digests that are broadcast.
TRACKED, TOP = 4096, 1024


def digest(text: str = "text"):
    """The SHA-256 of a text's UTF-8 bytes in lowercase hex; null is empty."""
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)


def _best(rows: DataFrame) -> DataFrame:
    """For each digest its winner: the row of the largest id (null is smallest, of equal ids the last row), and the number of rows."""
    by = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("n"))
    return by.select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n")


def winners(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """digest, keep_id, keep_row, n of the frequent digests (at most TOP rows, a table) and of the others that several rows have (a plan). rows: id, digest, row."""
    summary = rows.agg(F.expr(f"approx_top_k(digest, {TOP}, {TRACKED})").alias("top"))
    candidates = summary.select(F.explode("top").alias("x")).select(F.col("x.item").alias("digest"))
    heavy = materialize(_best(rows.join(F.broadcast(candidates), "digest", "left_semi")).where("n > 1"), "heavy")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return heavy, _best(rest).where("n > 1")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs.

    Of rows with one text the one with the largest doc_id is kept; a null doc_id is smaller than all, and of rows that repeat both
    text and doc_id, or whose ids are all null, one is kept. A null text is an empty one, and empty texts are equal like others.
    Very long texts are digests as well; other columns don't matter; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), digest().alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "digests")  # texts are read once, and the numbers of rows are fixed
    heavy, light = winners(rows)
    # Two plans, not one join after the other: rows of frequent digests never enter the shuffle.
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest", "left")
    both = hot.unionByName(rest)
    single = F.col("n").isNull()
    return both.select(
        F.col("id").alias("doc_id"), F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row for each text, the one with the largest doc_id, with all columns, whatever their names.

    Copies of frequent texts go where they are read. Null ids, repeated rows and null texts as in exact_duplicates(); of rows that
    repeat text and id any one stays. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), digest().alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "digests")
    heavy, light = winners(rows)
    light = materialize(light, "light")
    discard(rows)
    wins = lambda df: df.select(F.col("digest").alias("d"), "keep_id")
    full = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), digest().alias("digest"))
    named = full.join(F.broadcast(wins(heavy)), F.col("digest") == F.col("d"), "left").where("d is null or id <=> keep_id").withColumnsRenamed({"d": "hot", "keep_id": "hot_id"})
    named = named.join(wins(light), F.col("digest") == F.col("d"), "left").where("d is null or id <=> keep_id")
    alone = named.where("hot is null and d is null").select("doc.*")
    # What is left of groups is a row for each group, or several where rows repeat id and text.
    tops = named.where("hot is not null or d is not null").groupBy("digest").agg(F.first("doc").alias("doc")).select("doc.*")
    return alone.unionAll(tops)


def sizes(docs: DataFrame) -> DataFrame:
    """copies, groups: how many texts stand in so many rows (a report; docs as in exact_duplicates())."""
    name = unused("copies", docs)
    return exact_duplicates(docs).where("kept").groupBy(F.col("group_size").alias(name)).agg(F.count("*").alias("groups")).withColumnRenamed(name, "copies")
