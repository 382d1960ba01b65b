"""Packing: token windows filled by deficit round-robin over source queues.

Documents queue up by source. Each round stands for one window; in it every queue earns the share of the window's tokens that
the target mixture gives it, on top of the deficit that earlier rounds left, and sends whole quanta of QUANTUM tokens while the
deficit covers them. What the rounds send, in the order of rounds and then queues, is one stream, cut into full windows: only
the last sequence of all is short. A queue's deficit after t rounds is a closed form of its weight (integers, no rounding), so a
document finds its own rounds, windows and offsets from its place in its queue and the totals of all queues; nothing runs in
sequence, and windows, tasks and executors all continue the same deficits.

By default the target mixture is the share of tokens that each source has, so that all queues run dry together. Sources with a
smaller share than 1 / MAX_QUEUES that the mixture doesn't name share FALLBACK hashed queues, which bounds the number of queues
whatever the input. A shared queue gets the shares of its sources together, in each window; its documents come one source after
another within a block, so the share of a single small source is held over the stream, not in each window.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import materialize, small_batches

#: Tokens of a sequence; of a quantum; queues of their own; queues that small sources share.
WINDOW, QUANTUM, MAX_QUEUES, FALLBACK = 2048, 256, 512, 32
#: Weights of queues are integers that sum to 2 ** WEIGHT_BITS.
WEIGHT_BITS = 24
#: Distinct words that each of the two generations of a worker's memory holds.
REMEMBER = 150_000
#: Most rows of the table of places that is broadcast; a larger one is joined.
BROADCAST_ROWS = 100_000


#: A symbol before a full stop or comma: the tokenizer takes such a run as one word, so it isn't split.
_RUN = re.compile(r"[.,] (?<=[^\w\t-\r \x85\xa0][.,] |_[.,] )")
#: What the tokenizer's pattern makes of a word of ASCII characters without apostrophes.
_PARTS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")


def plain(text: str) -> str:
    """A text of the same ids in which fewer distinct words lie between blanks: other white space becomes a blank, letters become small,
    and a full stop or comma between a letter or digit and a blank stands apart (the tokenizer splits there in any case)."""
    text = text.replace("\n", " ")
    try:
        text.encode("latin-1")  # in these characters small letters are one for one and normalisation changes nothing
    except UnicodeEncodeError:
        return text
    text = text.lower()
    return text if _RUN.search(text) else text.replace(". ", " . ").replace(", ", " , ")


class Words(dict):
    """Ids of words as little-endian unsigned 32-bit integers. Words are what lies between blanks: the tokenizer drops white space.

    The memory has two generations: when the young one is full, it becomes the old one, and words that are met again move over. So
    words that go on coming up stay, and the many that come up once don't take their places.
    """

    of: dict[str, Words] = {}

    @classmethod
    def at(cls, path: str) -> Words:
        """This Python worker's own memory of a tokenizer; it lives from task to task, until pieces are made."""
        if path not in cls.of:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
            words = cls.of[path] = cls()
            words.old, tokenizer = {}, Tokenizer.from_file(path)
            words.encode = tokenizer.encode
            words.bare = tokenizer.model.tokenize  # small letters are one word, which normalisation leaves as it is
            words.as_bytes = str.maketrans({chr(c): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0] for c in range(256)})
        return cls.of[path]

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.made(word)
        if len(self) >= REMEMBER:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out

    def made(self, word: str) -> bytes:
        """The ids of a word that isn't remembered."""
        if word.islower():
            if word.isascii():
                if word.isalpha():
                    return array("I", [x.id for x in self.bare(word)]).tobytes()
                if "'" not in word and word.isprintable():
                    parts = _PARTS.findall(word)
                    if len(parts) > 1:
                        return b"".join([self[x] for x in parts])
            elif word.isalpha() and max(word) < "\u0100":
                return array("I", [x.id for x in self.bare(word.translate(self.as_bytes))]).tobytes()
        return array("I", self.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids of a text."""
        return b"".join(map(self.__getitem__, plain(text).split(" ")))


def tokenize(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, source, block, place, n, ids of each row: block is a task's number, place the row's first token among those of its block and source.

    A null or empty text is end_id alone; a null source is a source like any other (''). ids are unsigned 32-bit, or 16-bit where all fit.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, end, places = TaskContext.get().partitionId(), Words.at(path), np.array([end_id], dtype="<u4").tobytes(), {}
        for batch in batches:
            sources, out, place = [x or "" for x in batch.column(2).to_pylist()], [], []
            for text, source in zip(batch.column(1), sources, strict=True):
                ids = np.frombuffer(words(text.as_py() or "") + end, dtype="<u4")
                place.append(places.get(source, 0))
                places[source] = place[-1] + len(ids)
                out.append(ids)
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sources), pa.array([block] * n, pa.int32()), pa.array(place, pa.int64()), pa.array([len(x) for x in out], pa.int64()),
                 pa.array([(x.astype("<u2") if x.max() < 65536 else x).tobytes() for x in out], pa.binary())],
                ["doc_id", "source", "block", "place", "n", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")).mapInArrow(run, "doc_id long, source string, block int, place long, n long, ids binary")


def weights(totals: dict[str, int], mixture: dict[str, float] | None = None) -> dict[str, int]:
    """Integer weights of queues, at least 1 each, that sum to 2 ** WEIGHT_BITS (largest remainders), after mixture or the totals."""
    size = 1 << WEIGHT_BITS
    want = {k: float((mixture or totals).get(k, 0)) for k in totals}
    whole = sum(want.values()) or 1.0
    exact = {k: 1 + (size - len(totals)) * v / whole for k, v in want.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: size - sum(out.values())]:
        out[k] += 1
    return out


class Rounds:
    """Where each quantum of each queue lies in the stream."""

    def __init__(self, totals: dict[str, int], weight: dict[str, int]):
        self.names = sorted(totals)
        self.at = {k: i for i, k in enumerate(self.names)}
        self.total = np.array([totals[k] for k in self.names], dtype=np.int64)
        self.w = np.array([weight[k] for k in self.names], dtype=np.int64)
        self.shift = WEIGHT_BITS - (WINDOW // QUANTUM).bit_length() + 1

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (columns) has sent after each number of rounds (rows)."""
        return np.minimum((rounds[:, None] * self.w[None, :] >> self.shift) * QUANTUM, self.total[None, :])

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents, given the number of their queue, their first token there and their tokens: the document's
        place in the lists, start in it, length and place in the stream."""
        low, many = first // QUANTUM, (first + n - 1) // QUANTUM - first // QUANTUM + 1
        doc = np.repeat(np.arange(len(n)), many)
        cells = low[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        s = queue[doc]
        rounds = -(-((cells + 1) << self.shift) // self.w[s]) - 1
        place = np.empty(len(cells), dtype=np.int64)
        for at in range(0, len(cells), 4096):  # parts, as each has a row of all queues
            here = slice(at, at + 4096)
            r, q = rounds[here], s[here]
            before, after = self.sent(r), self.sent(r + 1)
            earlier = np.arange(len(self.w))[None, :] < q[:, None]
            place[here] = np.where(earlier, after, before).sum(axis=1) + cells[here] * QUANTUM - before[np.arange(len(q)), q]
        lo = np.maximum(cells * QUANTUM, first[doc])
        hi = np.minimum((cells + 1) * QUANTUM, (first + n)[doc])
        place += lo - cells * QUANTUM
        # Quanta of a document that follow each other in the stream are one piece, which is then cut at windows.
        joined = np.flatnonzero(np.append(True, (place[1:] != (place + hi - lo)[:-1]) | (doc[1:] != doc[:-1])))[: len(cells)]
        doc, lo, hi, place = doc[joined], lo[joined], hi[np.append(joined[1:], len(hi)) - 1], place[joined]
        parts = (place + hi - lo - 1) // WINDOW - place // WINDOW + 1
        of = np.repeat(np.arange(len(lo)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.maximum(place[of], (place[of] // WINDOW + k) * WINDOW)
        end = np.minimum((place + hi - lo)[of], (place[of] // WINDOW + k + 1) * WINDOW)
        return doc[of], (lo - first[doc])[of] + begin - place[of], end - begin, begin


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, mixture: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and, unless with_ids is False, ids.

    mixture: target shares by source; default: the shares of tokens. Null or empty texts give end_id alone, one piece; a null
    doc_id stays null; a null source is one of its own; a repeated row is packed each time; a very long text is cut like any other; other
    columns don't matter; an empty table gives no piece. Each token lies in exactly one piece;
    offsets in a sequence are gapless from 0; all sequences but the last have WINDOW tokens.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer_path, end_id), "packing-tokens")
    by_source = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    whole = by_source.agg(F.sum("n")).first()[0] or 0
    named = set(mixture or ())
    # Shares sum to 1, so at most MAX_QUEUES sources have more than 1 / MAX_QUEUES; mixture is the caller's own short list.
    large = {r["source"] for r in by_source.where((F.col("n") * MAX_QUEUES > F.lit(whole)) | F.col("source").isin(sorted(named))).select("source").collect()}
    if len(large) > MAX_QUEUES + len(named):
        raise AssertionError("more large sources than shares allow")
    queue = F.when(F.col("source").isin(sorted(large)), F.concat(F.lit("s"), F.col("source"))).otherwise(F.concat(F.lit("h"), (F.crc32(F.col("source").cast("binary")) % FALLBACK).cast("string")))
    # Within a queue: blocks in order, in a block its sources in order. One row for a block and source, far fewer than documents.
    sums = tokens.groupBy("source", "block").agg(F.sum("n").alias("m")).withColumn("queue", queue)
    order = Window.partitionBy("queue").orderBy("block", "source")
    bases = sums.withColumn("base", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1))).select("source", "block", "queue", F.coalesce("base", F.lit(0)).alias("base"))
    bases = materialize(bases, "packing-bases")
    if bases.count() <= BROADCAST_ROWS:  # else the ids are shuffled to them
        bases = F.broadcast(bases)
    totals = {r["queue"]: r["n"] for r in by_source.withColumn("queue", queue).groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # at most MAX_QUEUES + FALLBACK + named rows
    held = spark.sparkContext.broadcast((totals, weights(totals, mixture and {f"s{k}": v for k, v in mixture.items()})))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Words.of.clear()  # words are done with; workers stay, and their memory counts in whatever comes after
        rounds = Rounds(*held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_id, source, n, ids, queue, first = batch.columns
            n = n.to_numpy()
            doc, start, length, place = rounds.pieces(np.array([rounds.at[x] for x in queue.to_pylist()]), first.to_numpy(), n)
            data = [np.frombuffer(x, dtype="<u2" if len(x) == 2 * m else "<u4").astype("<u4") for x, m in zip(ids.to_pylist(), n.tolist(), strict=True)]
            own = [data[d][a : a + m].tobytes() for d, a, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            at = pa.array(doc)
            columns = [doc_id.take(at), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, own)), pa.int64()), pa.array(n[doc]), pa.array(place // WINDOW), pa.array(place % WINDOW), source.take(at), *([pa.array(own, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    placed = tokens.join(bases, ["source", "block"]).select("doc_id", "source", "n", "ids", "queue", (F.col("base") + F.col("place")).alias("first"))
    return placed.mapInArrow(run, schema)
