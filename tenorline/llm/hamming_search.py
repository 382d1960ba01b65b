"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A vector's code has a bit for the sign of each dimension. Codes are indexed by each of SEGMENTS segments; if two codes differ in
at most SEGMENTS * (r + 1) - 1 bits, one segment differs in at most r. Rounds grow r: a round looks up the segment values
that differ from the query's in exactly r bits, checks the whole codes found, keeps each query's best, and ends the queries
whose last kept distance is within what the radii searched so far provably cover.

The index holds distinct codes with their smallest id, and equal query codes are searched once, so neither a common vector
nor a common query makes a large bucket. Ties of distance are broken by id: of equally distant codes those with the smallest ids win,
which is exact, as a code that isn't among the best k has k codes before it, each with a vector of its own.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Segments of a code and bits of a segment.
SEGMENTS, WIDTH = 4, 16


def code(vector: str) -> Column:
    """The 64-bit code of an array column: bit j is set if the sum of the dimensions j, j + 64, ... is over 0. Null for null or empty."""
    bits = SEGMENTS * WIDTH
    return F.expr(
        f"case when size({vector}) between 1 and {bits} then aggregate(transform({vector}, (x, i) -> if(coalesce(x, 0) > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b) "
        f"when size({vector}) > {bits} then aggregate(transform(sequence(0, {bits - 1}), j -> if(aggregate(filter({vector}, (x, i) -> i % {bits} = j), 0D, (a, x) -> a + coalesce(x, 0)) > 0, shiftleft(1L, j), 0L)), 0L, (a, b) -> a | b) end"
    )


def _segment(of: str, j: Column | str) -> str:
    return f"cast(shiftrightunsigned({of}, {j} * {WIDTH}) & {(1 << WIDTH) - 1} as int)"


def _best(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each key; tasks keep at most k of a key before rows move."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: the k nearest other vectors of each query by code, then by id.

    vectors, queries: vec_id, embedding. Rows with a null id or a null or empty embedding are left out; a repeated row counts each time
    but never as its own id's neighbour; with fewer than k other vectors there are fewer rows; an empty table gives none.
    """
    coded = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), code("embedding").alias("code")).where("vec_id is not null and code is not null"), "codes")
    asked = materialize(queries.select(F.col("vec_id").cast("long").alias("query_id"), code("embedding").alias("q")).where("query_id is not null and q is not null").distinct(), "queries")
    need = k + 1  # one may be the query itself
    codes = materialize(coded.groupBy("code").agg(F.min("vec_id").alias("first_id")), "distinct-codes")
    index = codes.select("code", "first_id", F.explode(F.expr("sequence(0, %d)" % (SEGMENTS - 1))).alias("segment")).withColumn("value", F.expr(_segment("code", "segment")))
    active = materialize(asked.select("q").distinct(), "active")
    best = None
    for r in range(WIDTH + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(WIDTH), r)]
        probes = active.select("q", F.explode(F.expr("sequence(0, %d)" % (SEGMENTS - 1))).alias("segment")).withColumn("mask", F.explode(F.lit(masks)))
        probes = probes.select("q", "segment", F.expr(f"{_segment('q', 'segment')} ^ mask").alias("value"))
        hits = probes.hint("merge").join(index, ["segment", "value"])  # Spark takes exploded rows for as few as their sources and would broadcast them
        hits = hits.select("q", "code", "first_id").distinct().withColumn("distance", F.expr("bit_count(q ^ code)").cast("int"))
        if best is not None:
            hits = hits.unionAll(best).distinct()
        best = materialize(_best(hits, "q", ["distance", "first_id"], need), "best")
        covered = SEGMENTS * (r + 1) - 1
        known = best.where(F.col("distance") <= covered).groupBy("q").count().where(F.col("count") >= need).select("q")
        left = materialize(active.join(known, "q", "left_anti"), "active")
        discard(active)
        active = left
        if active.isEmpty():
            break
    # Vectors of the codes found: of each code its first ids, taken by parts first, as a code may have any number of vectors.
    wanted = coded.join(best.select("code").distinct(), "code", "left_semi").withColumn("part", F.struct("code", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")))
    ids = _best(_best(wanted, "part", ["vec_id"], need).drop("part"), "code", ["vec_id"], need)
    found = _best(best.join(ids, "code").select("q", "distance", "vec_id"), "q", ["distance", "vec_id"], need)
    out = asked.join(found, "q").where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "distance")
