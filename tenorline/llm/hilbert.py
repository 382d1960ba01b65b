"""Sharding along a Hilbert curve: metadata dimensions are quantised, rows sorted by curve index, and the order cut into runs.

Rows that are near in all dimensions (language, source, size of the text, age as the order of ids) get near indices, so each
shard, and each stretch of it, covers a small box of every dimension, and readers can skip files by their least and greatest
values. Codes keep the order of values: categories are cut into as many values each, sizes and ids into as many rows each. Equal texts are one group with the metadata of its first id, and lie side by side.

All of it is DataFrame code: the curve is a fold over the bits with a table of its states; ranks come from a range-partitioned
sort, whose key ends with the id, so that no value, however common, has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Bits of each quantised dimension.
BITS = 6
#: Most values of a category that are broadcast; more are joined.
BROADCAST_ROWS = 10_000


def curve_table(dims: int) -> list[int]:
    """For each state of the curve (entry corner e, direction d) and each corner: next state * 2 ** dims + place of the corner."""
    size = 1 << dims
    rotate = lambda x, r: (x << r % dims | x >> (dims - r % dims)) & (size - 1)
    gray = lambda x: x ^ x >> 1
    place = {gray(w): w for w in range(size)}
    ones = lambda x: 0 if not x & 1 else 1 + ones(x >> 1)
    out = []
    for e in range(size):
        for d in range(dims):
            for corner in range(size):
                w = place[rotate(corner ^ e, dims - (d + 1) % dims)]
                entry = gray((w - 1) // 2 * 2) if w else 0
                turn = 0 if not w else ones(w if w & 1 else w - 1) % dims
                out.append(((e ^ rotate(entry, d + 1)) * dims + (d + turn + 1) % dims) * size + w)
    return out


def curve_index(columns: list[str], bits: int = BITS) -> Column:
    """The Hilbert index of int columns with values from 0 to 2 ** bits - 1."""
    dims = len(columns)
    size = 1 << dims
    corner = " | ".join(f"shiftleft(shiftright({c}, i) & 1, {j})" for j, c in enumerate(columns))
    step = f"element_at(array({','.join(map(str, curve_table(dims)))}), cast(s.state * {size} + ({corner}) + 1 as int))"
    return F.expr(
        f"aggregate(sequence({bits - 1}, 0, -1), named_struct('state', 0, 'h', 0L), "
        f"(s, i) -> transform(array({step}), v -> named_struct('state', shiftright(v, {dims}), 'h', shiftleft(s.h, {dims}) | cast(v & {size - 1} as bigint)))[0], s -> s.h)"
    )


def ranked(df: DataFrame, by: list[Column], rank: str) -> DataFrame:
    """df with its 0-based rank in the order of by, which should tell rows apart; written to the shared folder on the way."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    parts = materialize(parts, "ranked")  # the numbers are fixed from here on
    part = F.shiftright("_at", 33)
    counts = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_part", before.alias("_base"))
    out = parts.withColumn("_part", part).join(bases, "_part").withColumn(rank, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")
    out._shared_path = parts._shared_path  # for discard()
    return out


def _codes(rows: DataFrame, column: str) -> DataFrame:
    """k_column, x_column: the values of a column, cut into 2 ** BITS codes of as many values each, in their order; null first.

    Up to BROADCAST_ROWS values are numbered in one task; more are sorted by range.
    """
    key, value = f"k_{column}", F.col(f"k_{column}").asc_nulls_first()
    values = rows.select(F.col(column).alias(key)).distinct()
    many = values.count()
    few = many <= BROADCAST_ROWS
    placed = values.withColumn("rank", F.row_number().over(Window.orderBy(value)) - 1) if few else ranked(values, [value], "rank")
    out = placed.select(key, F.expr(f"cast(rank * {1 << BITS} div {max(1, many)} as int)").alias(f"x_{column}"))
    return F.broadcast(out) if few else out


def shards(docs: DataFrame, count: int = 8) -> DataFrame:
    """Each row's id, size (bytes of the text plus 1), text_crc32, dimensions, curve index, shard (0 to count - 1) and slot in it.

    The number of rows of shards differs by one at most. A null text has size 1 and the crc32 of no bytes; null ids, languages
    and sources are values of their own and lie first; repeated rows get a slot each; an empty table gives no rows; other columns
    don't matter. Only sizes and hashes of texts are kept, so very long ones don't matter either.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
    )
    rows = materialize(rows, "metadata")  # texts are read once
    total = rows.count()
    top = 1 << BITS
    depths = rows.agg(*[F.percentile_approx(c, [i / top for i in range(1, top)], 10_000).alias(c) for c in ("size", "doc_id")]).first()
    groups = rows.groupBy("h", "text_crc32", "size").agg(F.min(F.struct("doc_id", "lang", "source")).alias("first"))
    groups = groups.select("h", "text_crc32", "size", F.col("first.doc_id").alias("group_id"), F.col("first.lang").alias("v_lang"), F.col("first.source").alias("v_source"))
    for c in ("lang", "source"):
        groups = groups.join(_codes(rows, c), groups[f"v_{c}"].eqNullSafe(F.col(f"k_{c}"))).drop(f"v_{c}", f"k_{c}")
    depth = lambda c, of: F.size(F.filter(F.lit(depths[of] or []).cast("array<bigint>"), lambda x: x < F.coalesce(F.col(c), x))).cast("int")
    coded = groups.withColumns({"x_size": depth("size", "size"), "x_age": depth("group_id", "doc_id")})
    coded = materialize(coded.withColumn("curve", curve_index(["x_lang", "x_source", "x_size", "x_age"])), "curve")
    # Both sides come from tables, so Spark can split a text that very many rows have.
    placed = ranked(rows.join(coded, ["h", "text_crc32", "size"]), [F.col(c) for c in ("curve", "group_id", "h", "text_crc32", "doc_id")], "rank")
    discard(rows, coded)
    shard = F.expr(f"(rank * {count}) div {max(1, total)}")
    start = F.expr(f"(shard * {max(1, total)} + {count - 1}) div {count}")
    return placed.withColumn("shard", shard.cast("long")).withColumn("slot", F.col("rank") - start).withColumn("shard", F.col("shard").cast("int"))


def summary(placed: DataFrame) -> DataFrame:
    """For each shard, rows, bytes and the least and greatest value of each dimension: what a reader prunes files by."""
    ends = [f(c).alias(f"{name}_{c}") for c in ("lang", "source", "size", "doc_id") for name, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)
