"""Phrase collocations by compressed position bitmaps.

Texts are cut into shards of some SHARD_BYTES of one language. In a shard, words are numbered by position, with a free position
between pieces, so that no phrase crosses them, and each word has a bitmap of its positions, compressed to its bytes that aren't zero
(place of the byte, byte). A phrase's bitmap holds where it ends. Shifted by one place and ANDed with the bitmaps of words, it gives the
bitmaps of the phrases that are a word longer, and their popcounts are the counts of these. For a prefix, all words that
have bits in the same bytes are tried at once. Prefixes are extended depth-first, a few at a time, so only one branch's bitmaps are held.

Counts are sums over shards. A phrase can only be frequent if its parts are, so three passes are made: words; from frequent words on,
pairs; from frequent pairs on, phrases of three and four words, depth-first. After each the shards get back what of their own is frequent;
this is dealt out by shard, never broadcast, since it grows with the texts. A word or pair has one row for each shard at most, so its rows can
meet once, by a window, for their sum and for what goes back to the shards.

With more texts, more of a shard's own pairs are frequent, up to all of them. So a task reads them as a stream behind their shard, keeps a number
of eight bytes for each, and gives out phrases branch by branch; it never holds them all as strings. Shards lie in tables as pieces of some words
each, so that no row needs large buffers, which executors would keep.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, utf8

#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD_BYTES = 16 << 20
#: Shards of SHARD_BYTES whose texts a task may hold; beyond, that is with many languages, the largest ends early.
OPEN_SHARDS = 5
#: Bytes of bitmaps of the prefixes that are extended together.
BRANCH = 50_000
#: Bytes of bitmaps of a row of a shard's table; a word with more is a row of its own.
PIECE = 50_000
#: Frequent pairs that are looked up together.
LOOKUP = 200_000
#: Words of a phrase at most, least occurrences, and hundredths of a phrase's occurrences that make a longer one stand for it.
LONGEST, LEAST, ABSORB = 4, 30, 80
_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_UPPER + b".,;:!?\n\x0b\x0c\r\t", _UPPER.lower() + b"\n" * 10 + b" ")
_SHARD = "shard long, lang string, many long, base int, words binary, counts binary, sizes binary, places binary, bits binary"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers with like bytes side by side, which compresses well."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def tokens(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of texts that are joined by a line end, the number of each word in order, and its position: one more than the word's before it, two more in the next piece."""
    raw = np.frombuffer(data.translate(_TABLE), dtype=np.uint8)
    del data
    edge = np.zeros(len(raw) + 2, bool)
    inside = edge[1:-1]
    np.logical_and(raw != 10, raw != 32, out=inside)
    turn = np.flatnonzero(edge[1:] != edge[:-1]).astype(np.int32)
    letters, pieces = raw[inside], np.flatnonzero(raw == 10).astype(np.int32)
    del raw, inside, edge  # all of these are as long as the texts
    start = turn[0::2]
    offsets = np.zeros(len(start) + 1, "<i4")
    np.cumsum(turn[1::2] - start, out=offsets[1:])
    first = np.searchsorted(start, pieces)  # the first word behind each end of a piece
    step = np.ones(len(start), np.int32)
    step[:1] = 0
    step[first[(first > 0) & (first < len(start))]] = 2
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False), np.cumsum(step, dtype=np.int32)


def bitmaps(codes: np.ndarray, positions: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of many words the number of its bytes; all places of bytes and bytes, by word and place."""
    order = np.argsort(codes, kind="stable")
    word, at = codes[order], positions[order]
    del order
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (at[1:] >> 3 != at[:-1] >> 3))) if len(word) else np.zeros(0, np.int64)
    bits = np.bitwise_or.reduceat(np.left_shift(1, at & 7, dtype=np.int32).astype(np.uint8), first) if len(first) else np.zeros(0, np.uint8)
    return np.bincount(word[first], minlength=many), at[first] >> 3, bits


def _shards(docs: DataFrame) -> DataFrame:
    """The shards of docs (lang, text) with their bitmaps: for each piece its first word's number, and occurrences (many), words, counts, bytes, places and bits of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)

        def shard(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            size.pop(lang)
            words, codes, positions = tokens(b"\n".join(held.pop(lang)))
            if not len(codes):
                return
            counts = np.bincount(codes, minlength=len(words))
            sizes, places, bits = bitmaps(codes, positions, len(words))
            del codes, positions
            number += 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for start, end in pairwise([0, *(np.flatnonzero(np.diff((ends[1:] - 1) // PIECE)) + 1).tolist(), len(words)]):
                own = slice(ends[start], ends[end])
                row = [number, lang, int(counts[start:end].sum()), start, b" ".join(words.slice(start, end - start).to_pylist()), *(x[start:end].astype("<i4").tobytes() for x in (counts, sizes)), _planes(places[own]), bits[own].tobytes()]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in _SHARD.split(", ")])

        whole = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                held[lang].append(text)
                size[lang] += len(text) + 1
                whole += len(text) + 1
                if size[lang] > SHARD_BYTES or whole > OPEN_SHARDS * SHARD_BYTES:
                    most = max(size, key=size.__getitem__)
                    whole -= size[most]
                    yield from shard(most)
                    pa.default_memory_pool().release_unused()
        for lang in list(held):
            yield from shard(lang)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, _SHARD)


def _split(words: bytes) -> pa.Array:
    return pa.array(words.split(b" "), pa.binary())


def _words(shards: DataFrame) -> DataFrame:
    """shard, lang, word, code, n: the words of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, base, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(counts, "<i4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(shard, pa.int64()), len(n)), pa.repeat(pa.scalar(lang), len(n)), _split(words).cast(pa.string()), pa.array(np.arange(base, base + len(n)), pa.int32()), pa.array(n)], ["shard", "lang", "word", "code", "n"])

    return shards.select("shard", "lang", "base", "words", "counts").mapInArrow(run, "shard long, lang string, word string, code int, n long")


class Vertical:
    """A shard's bitmaps of some of its words, and the extension of prefixes by them."""

    def __init__(self, sizes: np.ndarray, places: np.ndarray, bits: np.ndarray, wanted: np.ndarray) -> None:
        self.many = len(sizes)
        own = np.zeros(self.many, bool)
        own[wanted] = True
        keep = np.repeat(own, sizes)
        #: Bitmaps by word, as they are stored.
        self.word = np.repeat(np.flatnonzero(own).astype(np.int32), sizes[own])
        self.place, self.bits = places[keep], bits[keep]
        #: The same by place: where the bytes of each place begin.
        order = np.argsort(self.place, kind="stable")
        self.by_word, self.by_bits = self.word[order], self.bits[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.place, minlength=1)), [len(order)] * 2])

    def branches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The bitmaps of all words, some words at a time, as prefixes of one word."""
        start = 0
        while start < len(self.word):
            end = start + BRANCH
            end = len(self.word) if end >= len(self.word) else max(int(np.searchsorted(self.word, self.word[end])), int(np.searchsorted(self.word, self.word[start], side="right")))
            yield self.word[start:end], self.place[start:end], self.bits[start:end]
            start = end

    def extended(self, prefix: np.ndarray, place: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """prefix, word, place, bits of the prefixes shifted by one place and ANDed with each word's bitmap, where bits are left."""
        over = bits >= 128
        prefix, place = np.concatenate([prefix, prefix[over]]), np.concatenate([place, place[over] + 1])
        bits = np.concatenate([(bits << 1).astype(np.uint8), np.ones(int(over.sum()), np.uint8)])
        many = self.begin[place + 1] - self.begin[place]
        left = np.repeat(np.arange(len(place)), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begin[place], many)
        both = bits[left] & self.by_bits[right]
        hit = np.flatnonzero(both)
        left, right = left[hit], right[hit]
        return prefix[left], self.by_word[right], place[left], both[hit]


def _counted(prefix: np.ndarray, word: np.ndarray, place: np.ndarray, bits: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Different (prefix, word), in order, their popcounts, and their bitmaps as prefixes by number."""
    keys, number = np.unique(prefix.astype(np.int64) * many + word, return_inverse=True)
    n = np.bincount(number, weights=np.bitwise_count(bits), minlength=len(keys)).astype(np.int64)
    return keys // many, keys % many, n, (number, place, bits)


def _phrase(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in columns), b" ").cast(pa.string())


def _with_shard(shards: DataFrame, frequent: DataFrame, key: str) -> DataFrame:
    """shard, key, held: the pieces of each shard (held; key is null) and, behind them in the same task, the keys of frequent (shard, key) that are its own."""
    rows = shards.select("shard", F.lit(None).cast(frequent.schema[key].dataType).alias(key), F.struct("base", "lang", "words", "sizes", "places", "bits").alias("held"))
    rows = rows.unionByName(frequent.select("shard", key), allowMissingColumns=True)
    return rows.repartition("shard").sortWithinPartitions(F.col("shard") * 2 + F.col(key).isNotNull().cast("long"))


class Shard:
    """A shard as its pieces give it."""

    def __init__(self, number: int, pieces: list[dict]) -> None:
        pieces.sort(key=lambda x: x["base"])
        self.number, self.lang = number, pa.scalar(pieces[0]["lang"])
        self.words = pa.concat_arrays([_split(x["words"]) for x in pieces])
        self.bitmaps = [np.concatenate([read(x[n]) for x in pieces]) for n, read in (("sizes", lambda x: np.frombuffer(x, "<i4")), ("places", _unplanes), ("bits", lambda x: np.frombuffer(x, np.uint8)))]


def by_shard(batches: Iterator[pa.RecordBatch], found: Callable[[Shard, pa.Array], np.ndarray]) -> Iterator[tuple[Shard, np.ndarray]]:
    """Each shard and found(shard, keys) of all its keys, of the rows of _with_shard(); keys are looked up some at a time, and a shard without any is left out."""
    number, shard, pieces, keys, wait, many = None, None, [], [], [], 0

    def look() -> None:
        nonlocal shard, pieces, wait, many
        if many:
            shard = shard or Shard(number, pieces)
            pieces = []
            keys.append(found(shard, pa.concat_arrays(wait)))
        wait, many = [], 0

    for batch in batches:
        ids = batch.column(0).to_numpy()
        for start, end in pairwise([0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]):
            if start < end and ids[start] != number:
                look()
                if keys:
                    yield shard, np.concatenate(keys)
                    pa.default_memory_pool().release_unused()
                number, shard, pieces, keys = int(ids[start]), None, [], []
            held = batch.column(2).slice(start, end - start).drop_null().to_pylist()
            pieces += held
            wait.append(batch.column(1).slice(start + len(held), end - start - len(held)))
            many += len(wait[-1])
            if many >= LOOKUP:
                look()
    look()
    if keys:
        yield shard, np.concatenate(keys)


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, lang, phrase, n: pairs of frequent words, of the rows of _with_shard() with codes."""
    for shard, codes in by_shard(batches, lambda _, keys: keys.to_numpy()):
        v = Vertical(*shard.bitmaps, codes)
        for branch in v.branches():
            a, b, n, _ = _counted(*v.extended(*branch), v.many)
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(shard.number, pa.int64()), len(n)), pa.repeat(shard.lang, len(n)), _phrase(shard.words, [a, b]), pa.array(n)], ["shard", "lang", "phrase", "n"])


def _pairs(shards: DataFrame, frequent: DataFrame) -> DataFrame:
    """shard, lang, phrase, n: pairs of frequent words (shard, code) in each shard."""
    return _with_shard(shards, frequent, "code").mapInArrow(pairs_of, "shard long, lang string, phrase string, n long")


def _numbers(shard: Shard, pairs: pa.Array) -> np.ndarray:
    """The codes of pairs' words as one number each."""
    both = pc.split_pattern(pairs.cast(pa.binary()), b" ")
    a, b = (pc.index_in(pc.list_element(both, i), value_set=shard.words).to_numpy().astype(np.int64) for i in (0, 1))
    return a * len(shard.words) + b


def longer_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, size, n: phrases of three words and more of which all pairs are frequent, of the rows of _with_shard() with pairs."""
    for shard, allowed in by_shard(batches, _numbers):
        allowed.sort()
        own = np.zeros(len(shard.words), bool)
        own[allowed // len(own)] = own[allowed % len(own)] = True
        v = Vertical(*shard.bitmaps, own)

        def grow(phrases: list[np.ndarray], prefix: np.ndarray, place: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Extend phrases (columns of codes), whose bitmaps are numbered by row, to the longest, depth-first."""
            prefix, word, place, bits = v.extended(prefix, place, bits)
            pair = phrases[-1][prefix].astype(np.int64) * v.many + word
            at = np.searchsorted(allowed, pair)
            known = allowed[np.minimum(at, len(allowed) - 1)] == pair
            first, last, n, maps = _counted(prefix[known], word[known], place[known], bits[known], v.many)
            longer = [c[first] for c in phrases] + [last]
            if len(longer) > 2 and len(n):
                yield pa.RecordBatch.from_arrays([pa.repeat(shard.lang, len(n)), _phrase(shard.words, longer), pa.repeat(pa.scalar(len(longer), pa.int32()), len(n)), pa.array(n)], ["lang", "phrase", "size", "n"])
            if len(longer) < LONGEST and len(n):
                yield from grow(longer, *maps)

        every = np.arange(v.many)
        for branch in v.branches():
            yield from grow([every], *branch)


def _longer(shards: DataFrame, frequent: DataFrame) -> DataFrame:
    """lang, phrase, size, n: phrases of three words and more of which all pairs are frequent (shard, phrase), in each shard."""
    return _with_shard(shards, frequent, "phrase").mapInArrow(longer_of, "lang string, phrase string, size int, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size, f of all phrases of one to LONGEST words with at least so many occurrences, and lang, n (all words); tables."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    shards = materialize(_shards(docs.select(lang, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))), "shards")
    total = materialize(shards.groupBy("lang").agg(F.sum("many").alias("n")), "total")
    often = lambda df, key: df.withColumn("f", F.sum("n").over(Window.partitionBy("lang", key))).where(F.col("f") >= least).drop("n")
    words = materialize(often(_words(shards), "word"), "words")
    pairs = materialize(often(_pairs(shards, words.select("shard", "code")), "phrase"), "pairs")
    more = _longer(shards, pairs.select("shard", "phrase"))
    more = materialize(more.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "longer")
    one, two = words.groupBy("lang", "word").agg(F.first("f").alias("f")), pairs.groupBy("lang", "phrase").agg(F.first("f").alias("f"))
    sized = lambda df, name, size: df.select("lang", F.col(name).alias("phrase"), F.lit(size).alias("size"), "f")
    out = materialize(sized(one, "word", 1).unionAll(sized(two, "phrase", 2)).unionAll(more.select("lang", "phrase", "size", "f")), "phrases")
    discard(shards, words, pairs, more)
    return out, total


def scored(phrases: DataFrame, absorb: int = ABSORB) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates of frequent_phrases() that no longer one stands for, at the cut of the lowest score."""
    found = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = found.select("lang", "phrase", "a", "w", F.col("size").alias("m"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    known = lambda key, name: phrases.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    both = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    within = found.where("size > 2").select("lang", "w", F.col("a").alias("above"), F.col("size").alias("m"), F.explode(F.expr("sequence(2, size - 1)")).alias("n"))
    within = within.select("lang", "w", "above", "n", F.explode(F.expr("sequence(1, m - n + 1)")).alias("at")).select("lang", part(F.col("at"), F.col("n")).alias("phrase"), "above")
    above = within.groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    left = best.join(above, ["lang", "phrase"], "left").where(F.coalesce(F.col("above").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * absorb, F.lit(True)))
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language by score, occurrences and name.

    A null language is und; null and empty texts have no words; very long texts are shards of their own; repeated rows count each time;
    ids, null or not, and other columns don't matter; ties are told apart by the phrase's bytes; an empty table gives no rows.
    """
    phrases, total = frequent_phrases(docs)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored(phrases).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # Spark cuts each task's rows at this rank before they move
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
