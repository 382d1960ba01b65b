"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A text's words (ASCII letters made small, split at ASCII white space) give its set of distinct 5-word shingles, as 64-bit hashes.
One permutation: the hash range is cut into BANDS * ROWS bins, the smallest hash of each bin is its value; an empty bin takes
the value of the first filled bin in a pseudo-random probe sequence of its own (optimal densification), so that each bin agrees
with probability J between sets of similarity J. ROWS bins make a band key; texts with a key in common share a bucket. A pair of
similarity 0.75 misses all buckets with probability (1 - 0.75 ** 4) ** 48 < 2e-8.

Equal sets are one node. A bucket of m nodes emits m - 1 candidate edges, a star around its weightiest node, not m * m / 2 pairs;
each candidate is confirmed on the full sets, and confirmed links merge nodes into components. What a star can't see is a link of
two members that don't both link with the centre. So nodes of buckets that still hold several components are completed exactly,
by their rarest hashes: of two linking sets, the smaller has one of its first 14 % and the larger one of its first 25 % of hashes in
common, both in the order of how few nodes have a hash. Those hashes are buckets, again with stars, around 1, 8, 64 ... of the
nodes that may be the smaller one, and only between components; places of the hash in both sets leave out most pairs beforehand.
No link of sets with a bucket in common is lost, and texts that share a passage and nothing else are never paired up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix, small_batches, unused, utf8
from .hilbert import ranked

#: Words of a shingle, bands of a signature, bins of a band.
SHINGLE, BANDS, ROWS = 5, 48, 4
#: Least similarity of a link, in hundredths.
PERCENT = 75
_BINS = BANDS * ROWS
_RANDOM = np.random.default_rng(20_240_229)
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_WORD = _RANDOM.integers(1, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_ROW = _RANDOM.integers(1, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _RANDOM.integers(1, 2**64, BANDS, dtype=np.uint64)
_PROBES = _RANDOM.integers(0, _BINS, (_BINS, 4096))
_EDGES = (np.arange(_BINS, dtype=np.float64) / _BINS * 2.0**64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2 ** 64; grown as needed."""
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: none without words, one of the whole sequence with fewer than SHINGLE words."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    blank = np.concatenate([[True], _SPACE[data], [True]])
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = turn[0::2], turn[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power(len(data) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    words = mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    k = min(SHINGLE, len(words))
    total = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _WORD[i]
    return np.unique(mix(total))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The key of each band of a set that isn't empty, given its sorted hashes."""
    first = np.searchsorted(hashes, _EDGES)
    filled = first < np.append(first[1:], len(hashes))
    value = hashes[np.minimum(first, len(hashes) - 1)]
    empty = np.flatnonzero(~filled)
    source = np.arange(_BINS)
    for t in range(_PROBES.shape[1]):
        if not len(empty):
            break
        probe = _PROBES[empty, t]
        hit = filled[probe]
        source[empty[hit]] = probe[hit]
        empty = empty[~hit]
    source[empty] = np.flatnonzero(filled)[0]
    value = mix(value[source]).reshape(BANDS, ROWS)
    return mix((value * _ROW).sum(axis=1, dtype=np.uint64) + _BAND)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, set_key (a 128-bit digest of the whole set) and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x) for x in utf8(batch.column(1))]
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            bands = [band_keys(x).view(np.int64) if len(x) else [] for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h", "n_shingles", "set_key", "bands"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, n_shingles long, set_key binary, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """id and the sorted hashes of the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x).view(np.int64) for x in utf8(batch.column(1))], pa.list_(pa.int64()))], ["id", "hashes"])

    return texts.mapInArrow(run, "id long, hashes array<long>")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with linked: whether the full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    both = both.withColumns({"shared": F.size(F.array_intersect("ha", "hb")), "all": F.size("ha") + F.size("hb")})
    return both.select("a", "b", (F.col("shared") * 100 >= (F.col("all") - F.col("shared")) * PERCENT).alias("linked"))


def _stars(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of buckets (key, node, w): each node with the one of largest weight w, then smallest id."""
    centres = members.groupBy("key").agg(F.max_by("node", F.struct(F.col("w"), -F.col("node"))).alias("c"))
    both = members.join(centres, "key").where(F.col("node") != F.col("c"))
    return both.select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b")).distinct()


def _mixed(rows: DataFrame, merged: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
    """rows (key, node, ...) with component, and the keys that hold several components."""
    named = rows.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *more).where("lo <> hi").drop("lo", "hi")
    return named, keys


def _rare(alive: DataFrame, sets: DataFrame) -> DataFrame:
    """key, node, n, w, left, place: the rarest hashes of each node (n hashes, left of them from this one on), by how many of the nodes have them.

    place: a number from 1 among the nodes that may be the smaller of a pair at this hash; null for the others.
    """
    hashes = sets.join(alive, sets["id"] == alive["node"]).select("node", "w", F.size("hashes").alias("n"), F.explode("hashes").alias("key"))
    common = hashes.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    own = hashes.join(common, "key").groupBy("node").agg(F.first("n").alias("n"), F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("df", "key"))).alias("t"))
    # Hashes that no other node has come first in the order; they are counted, not kept.
    own = own.withColumn("alone", F.col("n") - F.size("t"))
    probe = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    first = own.withColumn("t", F.slice("t", F.lit(1), F.greatest(probe - F.col("alone"), F.lit(0)).cast("int")))
    rows = first.select("node", "n", "w", "alone", F.posexplode("t").alias("at", "x")).select(F.col("x.key").alias("key"), "node", "n", "w", (F.col("n") - F.col("alone") - F.col("at")).alias("left"))
    rows = materialize(rows, "rare")
    smaller = F.col("left") * (100 + PERCENT) >= F.col("n") * 2 * PERCENT
    # Ranks by a sort by range, less each hash's first one: a window over a hash would be one task, however many nodes have it.
    order = ranked(rows.where(smaller), [F.col("key"), F.desc("w"), F.col("node")], "rank")
    firsts = order.groupBy("key").agg(F.min("rank").alias("first"))
    placed = order.join(firsts, "key").select(*rows.columns, (F.col("rank") - F.col("first") + 1).cast("long").alias("place"))
    out = materialize(placed.unionByName(rows.where(~smaller).withColumn("place", F.lit(None).cast("long"))), "rare")
    discard(rows, order)
    return out


def _class(n: str) -> Column:
    """Class of a size; one is 1.34 times as wide as the one before."""
    return F.floor(F.log(F.col(n)) / float(np.log(1.34))).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes of edges (a, b), by alternating large and small stars.

    Each step is a grouped minimum and a join, so a node of any degree is spread; steps are written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    state = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(small.distinct(), "stars")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = new


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    Null and empty texts and texts of blanks have no shingles and are linked with nothing, not even each other. A row with a
    null doc_id is linked with nothing, has a null component_id and is kept. Rows that repeat a doc_id are one document with
    the links of all of them. Other columns don't matter; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(signatures(docs), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    # A node is a number for each different set; its id is the smallest that has the set.
    nodes = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "h")).alias("of"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select("set_key", F.col("of.doc_id").alias("id"), F.col("of.h").alias("h"), "n", "bands", F.monotonically_increasing_id().alias("node")), "nodes")
    exploded = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = exploded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = materialize(exploded.join(sizes, "key"), "buckets")
    weights = materialize(buckets.groupBy("node").agg(F.sum("m").alias("w")), "weights")  # a text in the middle of many near copies shares the most buckets
    members = materialize(buckets.join(weights, "node").select("key", "node", "w"), "buckets")
    discard(buckets)
    wanted = weights.select("node").join(nodes.select("node", "id", "h"), "node")
    texts = docs.join(wanted, (docs["doc_id"] == wanted["id"]) & (F.xxhash64(docs["text"]) == wanted["h"])).groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(_sets(texts.select("node", "text")), "sets")
    # An id with several texts joins their sets.
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id", F.col("lo").alias("set_key"))
    numbers = nodes.select("set_key", "node")
    own = known.select("doc_id", "set_key").join(several.select("doc_id"), "doc_id", "left_semi").join(numbers, "set_key")
    links = own.join(several.join(numbers, "set_key").select("doc_id", F.col("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    tested = materialize(confirm(_stars(members), sets), "tested")
    merged = components(links.unionAll(tested.where("linked").select("a", "b")))
    named, keys = _mixed(members, merged)
    alive = named.join(keys, "key").groupBy("node").agg(F.first("w").alias("w"))
    rare = _rare(alive, sets)
    done, k, spent = 0, 1, [members, weights, sets, rare, tested]
    while True:
        named, keys = _mixed(rare, merged, F.max("place").alias("places"))
        named = materialize(named.join(keys.where(F.col("places") > done).select("key", "places"), "key"), "mixed")
        spent.append(named)
        most = named.agg(F.max("places")).first()[0]
        if most is None:
            break
        centres = named.where((F.col("place") > done) & (F.col("place") <= k)).select("key", *[F.col(c).alias(f"c_{c}") for c in ("node", "n", "left", "component")])
        # Sizes of a link differ by 4 / 3 at most, so a size's class is that of the smaller one or the next; others never meet in the join.
        centres = centres.withColumn("class", F.explode(F.array(_class("c_n"), _class("c_n") + 1)))
        fits = F.least("left", "c_left") * (100 + PERCENT) >= (F.col("n") + F.col("c_n")) * PERCENT
        met = named.join(centres, (named["key"] == centres["key"]) & (_class("n") == centres["class"]) & (F.col("component") != F.col("c_component")) & (F.col("n") >= F.col("c_n")) & fits)
        pairs = met.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = materialize(confirm(pairs, sets), "tested")
        spent.append(found)
        new = found.where("linked").select("a", "b")
        if not new.isEmpty():
            merged = components(new.unionAll(merged.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if most <= k:
            break
        tested, done, k = tested.unionAll(found), k, k * 8
    discard(*spent)  # from here on only signatures, nodes and components are read
    ids = merged.join(nodes.select("node", "id"), "node")
    labelled = ids.join(ids.groupBy("component").agg(F.min("id").alias("least")), "component").select("node", "least")
    named = nodes.select("set_key", "node", "id").join(labelled, "node", "left").select("set_key", F.coalesce("least", "id").alias("component"))
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    out = signed.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with their columns, whatever their names; rows that repeat a doc_id stay or go together.

    Rows without words or with a null doc_id stay; an empty table gives no rows.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(unused("gone", docs))).distinct()
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")
