"""Byte-level BPE: ranked merges folded by Spark higher-order functions over the byte arrays of distinct words.

The rank map is a literal: a packed table from a pair of neighbouring ids to the rank of the piece that they make, which is also
its id. A fold over a word's bytes keeps the ids and the ranks of all neighbouring pairs; each step merges the first pair of
least rank and ranks the two new pairs. This is what tiktoken computes, merge by merge; no string is built on the way. A word that
is itself a piece needs no fold.

Words are the matches of the tokenizer's pattern. A block of documents has its ids in place, except that a word which isn't a piece is
a negative number into its task's distinct words; those that are new in the block are folded in the block's row, and all are then
put in their places. Words that many tasks would fold again are folded once, ahead, and go to all tasks: a bounded number of those that two tasks meet in a
share of the documents. Which these are changes no result, a word that isn't among them is folded in its task. So texts are never shuffled, no table of words grows with the corpus, and a task holds one block of bounded
size (or one long document) and the ids of a bounded number of words.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, utf8

#: Characters of text in a block; words and units that a task remembers from block to block.
BLOCK, WORDS, UNITS = 4 << 20, 400_000, 250_000
#: Words that are folded ahead for all tasks, at most, and documents in which they are looked for, on average at most, and at most this share of all.
COMMON, LOOKED_AT, SHARE = 250_000, 16_000, 1 / 16
#: White space, as the tokenizer's regular expressions have it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NO_SPLIT = re.compile(f"[{SPACE}] ")
_UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Bits of an id, the most that they hold (more than all ranks, too), and the bit where an element's rank begins, behind its id and its place in a word (8 MB at most).
ID_BITS, END, NONE, AT = 20, (1 << 20) - 1, (1 << 20) - 1, 43


def load_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a .tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def units(text: str) -> list[str]:
    """Stretches that can be tokenized one by one: no word of the pattern goes from a character that isn't white space to one that is."""
    if _NO_SPLIT.search(text):
        return _UNITS.findall(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The literal rank map, in flat arrays, as it goes to each task: m has an entry ((left id << ID_BITS | rank of the piece) << ID_BITS) for each pair of
    ids that makes a piece, at d[left id] + right id; b has the ids of all bytes, t the ranks of all pairs of bytes (NONE: no piece).

    Rows of a sparse table are shifted so that none of their entries collide; an entry of another row has another left id. A subquery of
    one row evaluates the literal once: tasks then get its arrays as bytes, not as an object for each number, which took a task longer than thousands of words.
    """
    size = max(ranks.values()) + 2  # one id more, for the ends of words
    if size >= END:
        raise ValueError("ids need more bits")
    rows: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            if (left := ranks.get(piece[:i])) is not None and (right := ranks.get(piece[i:])) is not None:
                rows.setdefault(left, {})[right] = rank
    shift, used = [0] * size, 0  # used: a bit for each place
    for left, row in sorted(rows.items(), key=lambda r: -len(r[1])):
        taken = 0
        for right in row:
            taken |= used >> right
        shift[left] = (~taken & (taken + 1)).bit_length() - 1  # the first place where the row fits
        for right in row:
            used |= 1 << (shift[left] + right)
    table = [END << 2 * ID_BITS] * (max(shift) + size)
    for left, row in rows.items():
        for right, rank in row.items():
            table[shift[left] + right] = (left << ID_BITS | rank) << ID_BITS
    one = [bytes([x]) for x in range(256)]
    literal = {"m": table, "d": shift, "b": [ranks[x] for x in one], "t": [ranks.get(x + y, NONE) for x in one for y in one]}
    made = F.from_json(F.lit(json.dumps(literal)), "struct<m:array<bigint>,d:array<int>,b:array<bigint>,t:array<bigint>>")
    return spark.range(1).select(made.alias("ranks")).scalar()


def folded(words: str, ranks: str) -> str:
    """SQL: the ids of each of an array of words (arrays of bytes, 0 to 255), given the column of rank_map().

    The state of the fold is one array, with an element (rank of the id with the next one, place of the id's first byte, id) for each id, and one for an
    end at either side; the first of these goes when nothing is left to merge. Places make elements unique, so the least one is the first pair of least
    rank, and arrays are changed by value. An entry XOR its own left id is a rank, with any other it's more than all ranks. (Calls inside a fold are
    interpreted one by one, and those that build an array from others cost most, so a step has few of them.)
    """

    def let(name: str, value: str, then: str) -> str:
        return f"transform(array({value}), {name} -> {then})[0]"

    def rank(left: str, right: str) -> str:
        return f"shiftleft(least(shiftright(get(m, cast(get(d, cast({left} as int)) + {right} as int)) ^ shiftleft({left}, {2 * ID_BITS}), {ID_BITS}), {NONE}L), {AT})"

    last, low, places = "size(d) - 1L", f"shiftright(get(f, k), {AT})", (1 << AT) - 1 - END
    before = f"{rank(f'(get(f, k - 1) & {END})', low)} | get(f, k - 1) & {places | END}"
    merged = f"{rank(low, f'(get(f, k + 2) & {END})')} | get(f, k) & {places} | {low}"
    rest = "array_remove(array_remove(array_remove(f, get(f, k + 1)), get(f, k)), get(f, k - 1))"
    step = f"array_insert(array_insert({rest}, k, {before}), k + 1, {merged})"
    least = f"aggregate(array(cast(array_position(e, array_min(e)) as int) - 1), e, (f, k) -> if(get(f, k) >= {NONE << AT}, slice(f, 2, size(f)), {step}))"
    begin, end = f"array({NONE << AT}L | {last})", f"array({NONE << AT | places}L | {last})"
    ids = f"transform(w, (x, i) -> shiftleft(if(i + 1 < size(w), get(t, x * 256 + get(w, i + 1)), {NONE}L), {AT}) | shiftleft(i + 1L, {ID_BITS}) | get(b, x))"
    fold = f"aggregate(w, concat({begin}, {ids}, {end}), (e, i) -> if(get(e, 0) & {END} <> {last}, e, {least}), e -> transform(slice(e, 1, size(e) - 1), x -> x & {END}))"
    names = {"m": f"{ranks}.m", "d": f"{ranks}.d", "b": f"{ranks}.b", "t": f"{ranks}.t"}
    out = f"transform({words}, w -> {fold})"
    for name, value in names.items():
        out = let(name, value, out)
    return out


def lists(words: list[bytes]) -> pa.ListArray:
    """One list of words, each as a list of its bytes, 0 to 255."""
    data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int32, count=len(words)), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(data)))


def common_words(docs: DataFrame, held: Broadcast, table: Column, pattern: str, share: float) -> dict[bytes, bytes]:
    """Ids (little-endian signed 32-bit integers) of words that aren't pieces and that more than one task meets in a share of docs, the most met first."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = regex.compile(pattern).findall, held.value
        seen, own = set(), set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for unit in units(text or ""):
                    if unit not in seen:
                        seen.add(unit)
                        own.update(word for word in find(unit) if word.encode("utf-8", "surrogatepass") not in known)
                if len(seen) > UNITS:
                    yield pa.RecordBatch.from_arrays([pa.array([x.encode("utf-8", "surrogatepass") for x in own], pa.binary())], ["word"])
                    seen, own = set(), set()
        yield pa.RecordBatch.from_arrays([pa.array([x.encode("utf-8", "surrogatepass") for x in own], pa.binary())], ["word"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.binary())), lists(words)], ["words", "bytes"])

    often = docs.select("text").sample(share, seed=1).mapInArrow(met, "word binary").groupBy("word").count().where("count > 1")
    rows = often.orderBy(F.desc("count"), "word").limit(COMMON).select("word").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    rows = rows.mapInArrow(listed, "words array<binary>, bytes array<array<int>>").withColumn("_ranks", table).select("words", F.expr(folded("bytes", "_ranks")).alias("ids")).toArrow()
    out = {}
    for words, ids in zip(rows["words"], rows["ids"], strict=True):
        out.update(zip(words.as_py(), (struct.pack(f"<{len(x)}i", *x) for x in ids.as_py()), strict=True))
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block: int = BLOCK, words: int = WORDS, share: float | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, as bytes) of each row of docs, in any order.

    A null or empty text has no ids; a null doc_id stays null; repeated rows are encoded each; other columns don't matter; a text of
    any length is one row; an empty table gives no rows. block, words and share only move work: a word is folded once in a task, or again
    once the task has met so many others, unless it was common in a share of the documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = spark.sparkContext.broadcast(ranks)  # the vocabulary
    table = rank_map(spark, ranks)
    if share is None:
        share = min(SHARE, LOOKED_AT / max(1, docs.count()))
    common = spark.sparkContext.broadcast(common_words(docs, held, table, pattern, share))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known, done_before = regex.compile(pattern).findall, held.value, common.value
        ids, codes, own, size, sent = [], [], {}, 0, 0

        packed = struct.Struct("<i").pack

        class Codes(dict):
            """The codes of units, kept without the blank before them (blank) or as they are."""

            def __init__(self, blank: str) -> None:
                self.blank = blank

            def __missing__(self, unit: str) -> bytes:
                out = []
                for word in find(self.blank + unit):
                    data = word.encode("utf-8", "surrogatepass")
                    if (code := known.get(data)) is not None:
                        out.append(packed(code))
                    elif (made := done_before.get(data)) is not None:
                        out.append(made)
                    else:
                        out.append(packed(-1 - own.setdefault(data, len(own))))
                made = self[unit] = out[0] if len(out) == 1 else b"".join(out)
                return made

        def done() -> pa.RecordBatch:
            new = list(islice(own, sent, None))
            return pa.RecordBatch.from_arrays([pa.array([sent], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([codes], pa.list_(pa.binary())), lists(new)], ["sent", "ids", "codes", "words"])

        seen, behind = Codes(""), Codes(" ")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id)
                if _NO_SPLIT.search(text):
                    codes.append(b"".join(map(seen.__getitem__, _UNITS.findall(text))))
                else:  # as units() has it, but no string is made for a unit that was seen
                    first, *rest = text.split(" ")
                    codes.append(seen[first] + b"".join(map(behind.__getitem__, rest)))
                size += len(text)
                if size > block:
                    yield done()
                    ids, codes, size, sent = [], [], 0, len(own)
                    if sent > words or len(seen) + len(behind) > UNITS:
                        seen.clear()  # of units, what was seen since the last time
                        behind.clear()
                    if sent > words:
                        own.clear()
                        sent = 0
        if ids:
            yield done()

    def put_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sizes = [], []  # of the words of the task's blocks so far
        for batch in batches:
            for sent, doc_ids, codes, new in zip(*batch.columns, strict=True):
                if not sent.as_py():
                    flat, sizes = [], []
                if len(new.values):
                    sizes.append(np.diff(new.values.offsets.to_numpy()).astype(np.int64))
                    flat.append(new.values.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
                if len(flat) > 1:
                    flat, sizes = [np.concatenate(flat)], [np.concatenate(sizes)]
                begins = np.cumsum(sizes[0]) - sizes[0] if flat else None
                out = []
                for code in codes.values:
                    code = np.frombuffer(code.as_buffer(), dtype="<i4")
                    at = np.flatnonzero(code < 0)
                    if len(at):
                        word = -1 - code[at]
                        many = sizes[0][word]
                        each = np.ones(len(code), dtype=np.int64)
                        each[at] = many
                        code = np.repeat(code, each)
                        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        code[np.repeat((np.cumsum(each) - each)[at], many) + within] = flat[0][np.repeat(begins[word], many) + within]
                    out.append(code.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(out, pa.binary())], ["doc_id", "ids"])

    blocks = docs.mapInArrow(number, "sent long, ids array<long>, codes array<binary>, words array<array<int>>")
    ready = blocks.withColumn("_ranks", table).select("sent", "ids", "codes", F.expr(folded("words", "_ranks")).alias("words"))
    return ready.mapInArrow(put_in, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded (doc_id, ids) with decoded: the pieces of its ids, one behind the other, as bytes.

    No ids, null or empty, are no bytes; an unknown id is an error; null and repeated doc_ids don't matter; an empty table gives no rows.
    """
    spark = encoded.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast({rank: piece for piece, rank in ranks.items()})  # the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.full(max(held.value, default=0) + 1, None, dtype=object)
        for rank, piece in held.value.items():
            pieces[rank] = piece
        for batch in batches:
            out = [b"".join(pieces[np.frombuffer(x, dtype="<u4")].tolist()) for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
