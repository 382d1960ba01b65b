"""Edit-aware token counts: a segment tree of pre-token stretches per document, brought up to date after edits.

A text is cut into leaves of about LEAF characters, at places where a character that isn't white space is followed by one that is: no
pre-token spans such a place, whatever lies around it, so leaves are tokenized on their own. The tree holds characters and
tokens of each leaf and their sums over subtrees. An edit descends by characters to the leaves that it touches, with one more
character on either side as context (the characters that decide whether the cuts there still stand), re-encodes these leaves
alone, and adds the differences on the paths to the root. If leaves run empty or outgrow FAT times LEAF, the tree is laid out
again from its leaves; only what is new is ever encoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks, units
from .common import small_batches

#: Characters of a leaf, roughly; how many times that a leaf may grow; stretches whose counts a Python worker remembers.
LEAF, FAT, REMEMBER = 256, 8, 150_000
_STATE = "doc_id long, text string, chars binary, tokens binary"


class Counter(dict):
    """Tokens of stretches of text; a Python worker has one for each tokenizer."""

    of: dict[tuple[str, str], Counter] = {}

    @classmethod
    def at(cls, path: str, pattern: str) -> Counter:
        """The worker's own counter for a .tiktoken file and its pattern."""
        if (path, pattern) not in cls.of:
            counter = cls.of[path, pattern] = cls()
            counter.encode = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary
        return cls.of[path, pattern]

    def __missing__(self, stretch: str) -> int:
        n = len(self.encode(stretch))
        if len(self) < REMEMBER:
            self[stretch] = n
        return n

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves of a text."""
        parts = units(text)
        chars = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        tokens = np.fromiter(map(self.__getitem__, parts), dtype=np.int64, count=len(parts))
        if not chars.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins = np.cumsum(chars) - chars
        first = np.flatnonzero(np.append(True, begins[1:] // LEAF != begins[:-1] // LEAF))
        return np.add.reduceat(chars, first), np.add.reduceat(tokens, first)


class Tree:
    """Sums of two counts over a row of leaves: node i has the children 2 i and 2 i + 1, leaves begin at the middle."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.sums = [chars.copy(), tokens.copy()]

    @classmethod
    def of(cls, chars: np.ndarray, tokens: np.ndarray) -> Tree:
        """The tree over leaves."""
        half = 1 << max(0, len(chars) - 1).bit_length()
        out = []
        for leaf in (chars, tokens):
            level = np.zeros(half, dtype=np.int64)
            level[: len(leaf)] = leaf
            levels = [level]
            while len(level) > 1:
                level = level.reshape(-1, 2).sum(axis=1)
                levels.append(level)
            out.append(np.concatenate([np.zeros(1, np.int64), *levels[::-1]]))
        return cls(*out)

    @property
    def half(self) -> int:
        """Places for leaves."""
        return len(self.sums[0]) // 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that has the character at (the last leaf that has any, if at is the end) and where it begins."""
        node, begin, chars = 1, 0, self.sums[0]
        at = min(at, int(chars[1]) - 1)
        while node < self.half:
            node *= 2
            if at - begin >= chars[node]:
                begin += int(chars[node])
                node += 1
        return node - self.half, begin

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        """Give a leaf new counts and its ancestors their differences."""
        for sums, value in zip(self.sums, (chars, tokens), strict=True):
            node, more = leaf + self.half, value - int(sums[leaf + self.half])
            while node and more:
                sums[node] += more
                node //= 2


def edited(text: str, tree: Tree, at: int, cut: int, new: str, counter: Counter) -> tuple[str, Tree, int]:
    """text with cut characters at the place at replaced by new, its tree, and how many characters were encoded.

    Places and lengths beyond the text are brought within it.
    """
    at = min(max(at, 0), len(text))
    cut = min(max(cut, 0), len(text) - at)
    after = text[:at] + new + text[at + cut :]
    if not text or not after:
        return after, Tree.of(*counter.leaves(after)), len(after)
    first, begin = tree.find(max(at - 1, 0))
    last, end = tree.find(at + cut)
    end += int(tree.sums[0][last + tree.half])
    region = after[begin : end + len(new) - cut]
    chars, tokens = counter.leaves(region)
    room = last - first + 1
    if len(chars) and len(region) <= FAT * LEAF * room:
        share = np.arange(len(chars)) * room // len(chars)
        for k in range(room):
            tree.set(first + k, int(chars[share == k].sum()), int(tokens[share == k].sum()))
        return after, tree, len(region)
    half = tree.half
    old = [s[half:] for s in tree.sums]
    row = [np.concatenate([o[:first], n, o[last + 1 :]]) for o, n in zip(old, (chars, tokens), strict=True)]
    return after, Tree.of(*(x[row[0] > 0] for x in row)), len(region)


def trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text, chars and tokens (the trees' sums as 64-bit integers, root at place 1) of each row.

    A null or empty text has no leaves; a very long one has more leaves in one row; a null doc_id stays null and repeated rows come
    out each; other columns don't matter; an empty table gives no rows. The result can be written and kept; update() brings it up to date.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.at(path, pattern)
        for batch in batches:
            built = [Tree.of(*counter.leaves(x.as_py() or "")).sums for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([b[i].tobytes() for b in built], pa.binary()) for i in (0, 1))], ["doc_id", "text", "chars", "tokens"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _STATE)


def gather(edits: DataFrame) -> DataFrame:
    """doc_id and its list of edits, in the order of their numbers, from rows (doc_id, number, at, cut, new)."""
    return edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "at", "cut", "new"))).alias("edits"))


def update(state: DataFrame, path: str, pattern: str, keep: str | None = None) -> DataFrame:
    """State rows with a column edits (array of structs with at, cut, new, applied in order) brought up to date, and encoded: characters encoded again.

    keep: a bigint column of state that is passed on.

    No edits, a null list or a null edit leave a row as it is; a null field of an edit is 0 or empty. Null and repeated ids don't
    matter, each row is brought up to date; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.at(path, pattern)
        for batch in batches:
            texts, sums, work = [], [], []
            for text, chars, tokens, edits in zip(*(c.to_pylist() for c in batch.columns[1:5]), strict=True):
                tree, encoded = Tree(np.frombuffer(chars, dtype=np.int64), np.frombuffer(tokens, dtype=np.int64)), 0
                for e in filter(None, edits or ()):
                    text, tree, n = edited(text or "", tree, e["at"] or 0, e["cut"] or 0, e["new"] or "", counter)
                    encoded += n
                texts.append(text)
                sums.append(tree.sums)
                work.append(encoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array([s[i].tobytes() for s in sums], pa.binary()) for i in (0, 1)), pa.array(work, pa.int64()), *batch.columns[5:]], ["doc_id", "text", "chars", "tokens", "encoded", *more])

    small_batches(state.sparkSession)
    more = [keep] if keep else []
    return state.select("doc_id", "text", "chars", "tokens", "edits", *more).mapInArrow(run, _STATE + ", encoded long" + "".join(f", {c} long" for c in more))


def total(tree: str = "tokens") -> str:
    """SQL: the sum at the root of a tree column (its second integer, little-endian)."""
    digits = ", ".join(f"hex(substring({tree}, {i}, 1))" for i in range(16, 8, -1))
    return f"cast(conv(concat({digits}), 16, 10) as bigint)"


def recount(docs: DataFrame, edits: str, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, edited_tokens, edited_text, encoded (characters encoded for the edits) of each row of docs.

    edits: SQL of an array of structs (at, cut, new) over the row's columns doc_id and text. Odd rows fare as in trees() and update().
    """
    state = trees(docs, path, pattern).withColumn("edits", F.expr(edits)).withColumn("n_tokens", F.expr(total()))
    done = update(state, path, pattern, keep="n_tokens")
    return done.select("doc_id", "n_tokens", F.expr(total()).alias("edited_tokens"), F.col("text").alias("edited_text"), "encoded")
