"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of sampled suffixes.

Every string of length bytes (a window) has an anchor: its first K-gram of smallest hash, K being a quarter of length. Equal windows have their anchor at the same
place in them, wherever they stand, so only suffixes that start at anchors are sorted, with windows of 400 bytes about one in 150 instead of all.
Consecutive windows with one anchor form a unit: the text from the first window's start to the last one's end. Units whose anchor
K-gram occurs nowhere else have no repeated window and are left out by counting hashes; all others are sorted, and their bytes decide.

Each task cuts its units out of the texts, keyed by the suffix from the anchor on and then the prefix read backwards, sorts
them, and sends sorted runs, front-coded, so that bytes shared with the run's previous key are not sent. Units that are the very
same in a run are repeats, are told so at once and go on as one key without a place. A receiver merges the runs of its anchors with
a loser tree that keeps for every run the length of the prefix its head shares with the last key put out; a comparison starts
behind it and known prefixes are never compared again. The order and its common prefix lengths give equal units and classes of
equal suffixes at every depth (and, by the prefixes' order, of equal contexts), and so which windows are equal.

Frequent anchors: one with more than HOT different units is split before it is sorted: its units are cut into parts of fewer windows,
which share more than the anchor, down to single windows if need be. One with more than WIDE units, however few of them differ, is
merged in groups first, whose runs are merged again. So a group has a bounded size, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, filter_of, materialize, mix, passed, sifted, small_batches, unused, utf8
from .neardup import _BYTE, _power

#: Bytes of a repeated string, unless a caller gives another length.
LENGTH = 400
#: Most different units of one anchor that are sorted together, and the windows of the parts into which more are cut.
HOT, PARTS = 1000, (16, 1)
#: Most units that are broadcast, as a table of two numbers for a text and five for a unit.
FEW = 20_000
#: Units that a receiver sorts at once, and bytes of units that a sender gathers before it sends runs.
BUCKET, RUN_BYTES = 8000, 32 << 20
#: Units of one anchor that are merged at once, and merged runs of such an anchor that are merged again.
WIDE, FAN = 20_000, 64
_UNIT = "h long, c long, o int, i0 int, i1 int, p int, a long, s long, n long"
_SPAN = ["h", "c", "start", "end"]
_RUN = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), *((x, pa.binary()) for x in ("shared", "sizes", "rest", "info")), *((x, pa.int64()) for x in _SPAN), ("piece", pa.binary()), ("units", pa.binary())])
_RUN_DDL = "bucket int, salt int, shared binary, sizes binary, rest binary, info binary, h long, c long, start long, end long, piece binary, units binary"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gram_size(length: int) -> int:
    """Bytes of an anchor."""
    return max(1, length // 4)


def anchors(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rows (first window, last window, anchor) of the units of a text, in order."""
    n, k = len(data), gram_size(length)
    if n < length:
        return np.zeros((0, 3), dtype=np.int64)
    power, inverse = _power(n + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:n], dtype=np.uint64)])
    gram = mix((prefix[k:] - prefix[:-k]) * inverse[: n - k + 1])
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    w, m = length - k + 1, n - length + 1
    # Least key of each w in a row: block-wise running minima from both sides.
    padded = np.concatenate([key, np.full(-len(key) % w, 2**64 - 1, dtype=np.uint64)]).reshape(-1, w)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(backward[:m], forward[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return np.stack([first, np.append(first[1:], m) - 1, at[first]], axis=1)


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """The units of all texts, with hashes of the anchor (a) and of the whole unit (s)."""
    gram = gram_size(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows, a, s = [], [], []
            for k, text in enumerate(utf8(batch.column(0))):
                found = anchors(np.frombuffer(text, dtype=np.uint8), length)
                rows.append(np.column_stack([np.full(len(found), k), found]))
                for i0, i1, p in found.tolist():
                    a.append(_signed(digest(text[p : p + gram])))
                    s.append(_signed(digest(text[i0 : i1 + length])))
            at, i0, i1, p = np.concatenate(rows).T if rows else np.zeros((4, 0), dtype=np.int64)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), *(pa.array(x, pa.int32()) for x in (np.zeros_like(i0), i0, i1, p)), pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(np.ones(len(a), dtype=np.int64))], _UNIT.replace(",", "").split()[::2])

    return docs.select("text", "h", "c").mapInArrow(run, _UNIT)


def _cut(pieces: DataFrame, windows: int, length: int) -> DataFrame:
    """Units of at most so many windows, cut from larger ones, each the whole of its piece; their anchor is all that their windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for text, h, c, o, unit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                i1, p, a, n = np.frombuffer(unit, dtype=np.int64).tolist()
                for part in range((p - i1) // windows, (p - o) // windows + 1):
                    near, far = p - part * windows, p - part * windows - windows + 1  # last and first window of the part, if all are there
                    lo, hi = max(o, far), min(i1, near)
                    core = digest(text[near - o : far - o + length], (a ^ part * 0x9E3779B97F4A7C15) & (2**64 - 1))
                    out.append((h, c, o, lo, hi, near, _signed(core), _signed(digest(text[lo - o : hi - o + length], core ^ near - lo)), n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] * 2 + [pa.int32()] * 4 + [pa.int64()] * 3)], _UNIT.replace(",", "").split()[::2])

    return pieces.select("text", "h", "c", "o", "unit").mapInArrow(run, _UNIT)


def _with_texts(units: DataFrame, pieces: DataFrame, few: bool) -> DataFrame:
    """text, h, c, o and the list of units of each piece of a text that has any; a piece's units are bounded by its length, and equal texts stand for one.

    few: whether the units are at most FEW, so that they are broadcast and only texts that have any are shuffled; else a filter of their texts is.
    """
    own = units.groupBy("h", "c", "o").agg(F.collect_list(F.struct("i0", "i1", "p", "a", "n", "m", "salts")).alias("units"))
    own = own.select(F.col("h").alias("_h"), F.col("c").alias("_c"), F.col("o").alias("_o"), "units")
    # Tasks keep one of equal texts before rows move, and texts without units don't.
    if few:
        found = pieces.join(F.broadcast(own), (pieces["h"] == own["_h"]) & (pieces["c"] == own["_c"]) & (pieces["o"] == own["_o"]))
        return found.groupBy("h", "c", "o").agg(F.first("text").alias("text"), F.first("units").alias("units")).select("text", "h", "c", "o", "units")
    each = passed(pieces, "h", filter_of(units.select("h").distinct(), "h")).groupBy("h", "c", "o").agg(F.first("text").alias("text"))
    return each.join(own, (each["h"] == own["_h"]) & (each["c"] == own["_c"]) & (each["o"] == own["_o"])).select("text", "h", "c", "o", "units")


def common(a: bytes, b: bytes, at: int) -> int:
    """Bytes that a and b share from the start, given that they share the first at."""
    n = min(len(a), len(b))
    while at < n and a[at : at + 32] == b[at : at + 32]:
        at += 32
    if at >= n:
        return n
    while at < n and a[at] == b[at]:
        at += 1
    return at


def shared_with_previous(keys: list[bytes]) -> list[int]:
    """Of sorted keys: the bytes that each shares with the one before."""
    return [common(last, key, 0) for last, key in zip([b"", *keys], keys)]


def front_code(keys: list[bytes], shared: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted keys and what each shares with the one before: that, their lengths, and all other bytes."""
    rest = b"".join(key[at:] for key, at in zip(keys, shared, strict=True))
    return np.array(shared, dtype=np.int32), np.array([len(k) for k in keys], dtype=np.int32), rest


def front_decode(shared: np.ndarray, length: np.ndarray, rest: bytes) -> list[bytes]:
    """The keys that front_code() was given."""
    keys, at, last = [], 0, b""
    for s, n in zip(shared.tolist(), length.tolist(), strict=True):
        last = last[:s] + rest[at : at + n - s]
        at += n - s
        keys.append(last)
    return keys


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (keys, bytes shared with the run's previous key): the order as (run, place), and bytes shared with the previous key.

    A loser tree. Every run's head carries the number of bytes that it shares with the last key put out. Of two heads the one
    that shares more is the smaller; only if both share as much are they compared, behind that prefix, and the loser then
    carries what it shares with the winner, which is what it will share with the next key put out.
    """
    k = max(1, len(runs))
    size = 1 << (k - 1).bit_length()
    head = [0] * size
    share = [0] * size
    alive = [i < len(runs) and len(runs[i][0]) > 0 for i in range(size)]
    keys = [runs[i][0] if i < len(runs) else [] for i in range(size)]

    def less(i: int, j: int) -> bool:
        """Whether the head of run i comes before that of run j; brings the loser's share up to date."""
        if not alive[i] or not alive[j]:
            return alive[i]
        if share[i] != share[j]:
            return share[i] > share[j]
        a, b = keys[i][head[i]], keys[j][head[j]]
        m = common(a, b, share[i])
        first = (a[m : m + 1], i) < (b[m : m + 1], j)
        share[j if first else i] = m
        return first

    tree = [0] * size
    winners = [0] * (2 * size)
    winners[size:] = range(size)
    for node in range(size - 1, 0, -1):
        i, j = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (i, j) if less(i, j) else (j, i)
    best = winners[1]
    order, out = [], []
    while alive[best]:
        order.append((best, head[best]))
        out.append(share[best])
        head[best] += 1
        if head[best] < len(keys[best]):
            share[best] = runs[best][1][head[best]]
        else:
            alive[best] = False
        node = (best + size) >> 1
        while node:
            if less(tree[node], best):
                best, tree[node] = tree[node], best
            node >>= 1
    return order, out


def equal_windows(keys: list[bytes], shared: list[int], right: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows are repeated: row d has the windows that start d bytes before the anchor, a column is a unit.

    keys: sorted; the suffix from the anchor (right bytes), then the prefix read backwards. shared: bytes shared with the key
    before. lo, hi: least and most d of each unit's windows.
    """
    n = len(keys)
    shared = np.array(shared, dtype=np.int64)
    back = [k[r:] for k, r in zip(keys, right.tolist(), strict=True)]
    order = sorted(range(n), key=back.__getitem__)
    left = np.array([0] + [common(back[i], back[j], 0) for i, j in zip(order, order[1:])], dtype=np.int64)
    out = np.zeros((int(hi.max()) + 1 if n else 0, n), dtype=bool)
    left_class = np.empty(n, dtype=np.int64)
    for d in range(int(lo.min()), len(out)):
        own = np.flatnonzero((lo <= d) & (d <= hi))
        if len(own) < 2:
            continue
        right_class = np.cumsum(shared < length - d)
        left_class[order] = np.cumsum(left < d)
        both = right_class[own] * (n + 1) + left_class[own]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        out[d, own[by[1:][same]]] = True
        out[d, own[by[:-1][same]]] = True
    return out


#: What goes with a key, as 64-bit numbers: bytes of its suffix, least and most d of its windows (which start d bytes before the anchor), occurrences so far (2: more than one), whether it still has a place of its own, and that place (text and position of the anchor).
_RIGHT, _LO, _HI, _N, _OPEN, _H, _C, _P = range(8)


def collapse(keys: list[bytes], shared: list[int], info: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """One of each of equal units, from sorted keys and the bytes shared with the key before: keys, shared, info, and the info of units that turned out to be repeated."""
    if not keys:
        return keys, np.zeros(0, dtype=np.int64), info, info
    sizes, common_ = np.array([len(k) for k in keys]), np.array(shared, dtype=np.int64)
    fresh = np.append(True, (common_[1:] < sizes[1:]) | (sizes[1:] != sizes[:-1]))
    stretch = np.cumsum(fresh) - 1  # equal keys; of these, units with suffixes of one length are equal
    order = np.lexsort((info[:, _RIGHT], stretch))
    stretch, info = stretch[order], info[order]
    first = np.append(True, (stretch[1:] != stretch[:-1]) | (info[1:, _RIGHT] != info[:-1, _RIGHT]))
    at = np.flatnonzero(first)
    total = np.add.reduceat(info[:, _N], at)
    settled = info[(info[:, _OPEN] == 1) & (total > 1)[np.cumsum(first) - 1]]
    leads = np.append(True, stretch[at][1:] != stretch[at][:-1])
    kept = info[at]
    kept[:, _N] = np.minimum(total, 2)
    kept[total > 1, _OPEN:] = 0
    return [keys[i] for i in order[at]], np.where(leads, common_[np.flatnonzero(fresh)][stretch[at]], sizes[order[at]]), kept, settled


def _places(info: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Spans (text, start, end) of windows that start last .. first bytes before the anchor."""
    return np.column_stack([info[:, _H], info[:, _C], info[:, _P] - first, info[:, _P] - last + length])


def _joined_spans(spans: np.ndarray) -> np.ndarray:
    """Spans (text, start, end) as disjoint ones; touching ones are one."""
    spans = spans[np.lexsort(spans.T[::-1])]
    if not len(spans):
        return spans
    text = np.cumsum(np.append(True, (spans[1:, :2] != spans[:-1, :2]).any(axis=1)))
    wide = text * (1 << 32)  # texts are under 2 GB, so ends of one text never reach the next one's starts
    reach = np.maximum.accumulate(wide + spans[:, 3])
    first = np.append(True, (wide + spans[:, 2])[1:] > reach[:-1])
    out = spans[first]
    last = np.append(np.flatnonzero(first)[1:], len(spans)) - 1
    out[:, 3] = reach[last] - wide[last]
    return out


def _rows(runs: list[tuple], spans: list[np.ndarray], pieces: list[tuple] = ()) -> list[pa.Array]:
    """Columns of _RUN: runs first, then spans, then pieces (text, h, c, o, unit)."""
    places = _joined_spans(np.concatenate([np.zeros((0, 4), dtype=np.int64), *spans]))
    out = []
    for i, kind in enumerate(_RUN.types):
        a = pa.array([r[i] for r in runs], kind) if i < 6 else pa.nulls(len(runs), kind)
        b = pa.array(places[:, i - 6], kind) if 6 <= i < 10 else pa.nulls(len(places), kind)
        at = {6: 1, 7: 2, 8: 3, 10: 0, 11: 4}.get(i)
        c = pa.nulls(len(pieces), kind) if at is None else pa.array([x[at] for x in pieces], kind)
        out.append(pa.concat_arrays([a, b, c]))
    return out


def _run(bucket: int, salt: int, keys: list[bytes], shared: np.ndarray, info: np.ndarray) -> tuple:
    shared, sizes, rest = front_code(keys, shared)
    return bucket, salt, shared.tobytes(), sizes.tobytes(), rest, info.tobytes()


def _sorted_spans(units: DataFrame, pieces: DataFrame, buckets: int, length: int, few: bool, hot: float) -> tuple[DataFrame, DataFrame]:
    """Spans (h, c, start, end) of the repeated windows of units, and as pieces (text, h, c, o, unit) the units of anchors with more than hot different ones; both are tables of materialize()."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = defaultdict(list)
        split: dict[tuple, list] = {}  # of the very same units of an anchor one goes on, with the occurrences of all
        known: list[tuple] = []  # and the spans of the others
        size = 0

        def sorted_runs() -> pa.RecordBatch:
            runs, spans = [], [np.array(known, dtype=np.int64).reshape(-1, 4)]
            for to, own in held.items():
                own.sort(key=lambda u: u[0])
                keys = [u[0] for u in own]
                keys, shared, info, settled = collapse(keys, shared_with_previous(keys), np.array([u[1:] for u in own], dtype=np.int64))
                runs.append(_run(*to, keys, shared, info))
                spans.append(_places(settled, settled[:, _HI], settled[:, _LO], length))
            pieces = [(unit, h, c, i0, np.array([i1, p, a, n], dtype=np.int64).tobytes()) for (a, _, unit), (h, c, i0, i1, p, n) in split.items()]
            made = pa.RecordBatch.from_arrays(_rows(runs, spans, pieces), schema=_RUN)
            held.clear()
            split.clear()
            known.clear()
            return made

        for batch in batches:
            for text, h, c, o, own in zip(utf8(batch.column(0)), *(x.to_pylist() for x in batch.columns[1:]), strict=True):
                for u in own:
                    i0, i1, p = u["i0"], u["i1"], u["p"]
                    if u["m"] > hot:
                        first = split.setdefault((u["a"], p - i0, text[i0 - o : i1 - o + length]), [h, c, i0, i1, p, 0])
                        if first[5]:
                            known.append((h, c, i0, i1 + length))
                        first[5] += u["n"]
                        size += 64 if first[5] > u["n"] else i1 + length - i0
                    else:
                        size += i1 + length - i0
                        suffix = text[p - o : i1 - o + length]
                        salt = h % u["salts"] + 1 if u["salts"] else 0
                        held[u["a"] % buckets, salt].append((suffix + text[i0 - o : p - o][::-1], len(suffix), p - i1, p - i0, u["n"], 1, h, c, p))
                    if size > RUN_BYTES:
                        yield sorted_runs()
                        size = 0
        if held or split:
            yield sorted_runs()

    def merged(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        runs, infos = [], []
        for shared, sizes, rest, info in zip(*(table.column(x).to_pylist() for x in ("shared", "sizes", "rest", "info")), strict=True):
            s = np.frombuffer(shared, dtype=np.int32)
            runs.append((front_decode(s, np.frombuffer(sizes, dtype=np.int32), rest), s.tolist()))
            infos.append(np.frombuffer(info, dtype=np.int64).reshape(-1, 8))
        order, shared = merge(runs)
        starts = np.cumsum([0, *map(len, infos)])
        return collapse([runs[r][0][i] for r, i in order], shared, np.concatenate(infos)[[starts[r] + i for r, i in order]])

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        keys, shared, info, settled = merged(table)
        run = _run(key[0].as_py(), key[1].as_py() // FAN, keys, shared, info)
        return pa.Table.from_arrays(_rows([run], [_places(settled, settled[:, _HI], settled[:, _LO], length)]), schema=_RUN)

    def receive(table: pa.Table) -> pa.Table:
        keys, shared, info, settled = merged(table)
        repeated = equal_windows(keys, shared, info[:, _RIGHT], info[:, _LO], info[:, _HI], length)
        repeated[:, info[:, _OPEN] == 0] = False  # all windows of those are known to be repeated
        edge = np.diff(np.pad(repeated.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        unit, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1] - 1  # windows begin .. end bytes before the anchor
        spans = _joined_spans(np.concatenate([_places(settled, settled[:, _HI], settled[:, _LO], length), _places(info[unit], end, begin, length)]))
        return pa.table({x: spans[:, i] for i, x in enumerate(_SPAN)})

    small_batches(pieces.sparkSession)
    made = [materialize(_with_texts(units, pieces, few).mapInArrow(send, _RUN_DDL), "runs")]
    runs = made[0].where("bucket is not null")
    top = units.agg(F.max("salts")).first()[0] or 0
    while top:
        made.append(materialize(runs.where("salt > 0").groupBy("bucket", "salt").applyInArrow(combine, _RUN_DDL), "runs"))
        runs = runs.where("salt = 0").unionAll(made[-1].where("bucket is not null"))
        top //= FAN
    spans = reduce(DataFrame.unionAll, (m.where("end is not null").select(_SPAN) for m in made))
    out = materialize(spans.unionAll(runs.groupBy("bucket").applyInArrow(receive, "h long, c long, start long, end long")), "spans")
    left = materialize(made[0].where("piece is not null").select(F.col("piece").alias("text"), "h", "c", F.col("start").cast("int").alias("o"), F.col("units").alias("unit")), "pieces")
    discard(*made)
    return out, left


def _open(units: DataFrame) -> DataFrame:
    """The units whose anchor occurs again, each once for equal texts (n: occurrences), with m, the number of different units of a frequent anchor (of others 1), and salts, the groups in which its units are merged first (0: none).

    units: a table of materialize(); it is deleted. Both sides of the joins by anchor come from tables, so that Spark can split the
    rows of a common anchor; beyond them, rows are counted by task before they move, and a filter keeps most others where they are. Hashes of units (s) tell only how to split an anchor.
    """
    again = materialize(units.groupBy("a").agg(F.sum("n").alias("k")).where("k > 1"), "anchors")
    some = materialize(passed(units, "a", filter_of(again, "a")).join(again, "a", "left_semi"), "units")
    discard(units)
    each = materialize(some.groupBy("h", "c", "o", "i0", "i1", "p", "a", "s").agg(F.sum("n").alias("n")), "units")
    discard(some)
    sizes = each.join(again.where(F.col("k") > min(HOT, WIDE)), "a", "left_semi").groupBy("a", "s").agg(F.count("*").alias("k")).groupBy("a").agg(F.count("*").alias("m"), F.sum("k").alias("k"))
    sizes = sizes.select("a", "m", F.when(F.col("k") > WIDE, F.ceil(F.col("k") / WIDE)).otherwise(0).cast("int").alias("salts")).where((F.col("m") > HOT) | (F.col("salts") > 0))
    sizes = materialize(sizes, "anchors")  # frequent ones alone, so at most one for HOT units
    out = materialize(each.join(sizes, "a", "left").withColumns({"m": F.coalesce("m", F.lit(1)), "salts": F.coalesce("salts", F.lit(0))}), "open")
    discard(again, each, sizes)
    return out


def text_key() -> tuple[Column, Column]:
    """Two hashes that stand for a whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(text), F.crc32(text.cast("binary"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """h, c (see text_key) and the list of disjoint byte spans that repeated windows of length bytes cover, of each text that has any."""
    small_batches(docs.sparkSession)
    h, c = text_key()
    pieces = docs.select(F.col("text").cast("string").alias("text"), h.alias("h"), c.alias("c"), F.lit(0).alias("o"))
    units, found, spent = _scan(pieces, length), [], []
    for windows in (*PARTS, 0):
        open_ = _open(materialize(units, "units"))
        count = open_.count()
        spans, pieces = _sorted_spans(open_, pieces, max(1, -(-count // BUCKET)), length, count <= FEW, HOT if windows else float("inf"))
        found.append(spans)
        spent += [open_, pieces]
        if not windows or pieces.isEmpty():
            break
        units = _cut(pieces, windows, length)
    whole = reduce(DataFrame.unionAll, found).groupBy("h", "c").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": x, "end": y} for x, y in union(of)] for of in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["h", "c", "spans"])

    out = materialize(whole.mapInArrow(joined, "h long, c long, spans array<struct<start: long, end: long>>"), "spans")
    discard(*found, *spent)
    return out


def union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that cover the same bytes; touching ones are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _with_spans(docs: DataFrame, length: int, run: Callable, schema: StructType | str) -> DataFrame:
    """What run makes of batches of docs with, as the last column, the spans that go.

    Few spans are broadcast. Else only rows that a filter of texts with spans lets through are joined; the others have none and stay where
    they are. A task has one Python worker in either case: workers stay, with their memory, for all that comes after.
    """
    name, key = unused("spans", docs), unused("key", docs)
    spans = repeated_spans(docs.select("text"), length)
    few = spans.count() <= FEW
    held = None if few else filter_of(spans, "h")
    of = spans.select(F.col("h").alias("_h"), F.col("c").alias("_c"), "spans")
    h, c = text_key()
    rows = docs.select(F.struct("*").alias("row"), h.alias("h"), c.alias("c"))  # in a struct, no name can clash
    joined = passed(rows, "h", held).join(F.broadcast(of) if few else of, (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c")), "left")
    out = joined.select("row.*", F.col("spans").alias(name)).mapInArrow(run, schema)
    if held is None:
        return out

    at = len(docs.columns) + 1

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays(b.columns[:at], b.schema.names[:at]) for b in sifted(batches, at, held, inside=False))

    none = F.lit(None).cast(spans.schema["spans"].dataType)
    return out.unionAll(rows.select("row.*", none.alias(name), F.col("h").alias(key)).mapInArrow(others, schema))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and text (these as characters; one that is cut goes whole) of each row of docs.

    Null and empty texts and texts under length bytes keep all; a null text counts as empty. A row with a null doc_id is treated
    like any other; repeated rows repeat each other's texts, so all their windows go. A very long text is one row, whose units are
    rows of their own. Other columns, whatever their names, don't matter; an empty table gives an empty result.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = utf8(batch.column(1)), [union(x) for x in batch.column(2).to_pylist()]
            kept = [_kept(t, s) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()),
                 pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())], names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_spans(docs, length, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs without the bytes of repeated windows, n_chars brought up to date where it exists; a character that is cut goes whole.

    Every row stays, with all its columns. Null texts stay null, empty texts and texts under length bytes stay as they are; ids, null or
    repeated, don't matter; the windows of repeated rows are repeats, so all of them go; an empty table gives an empty result.
    """
    schema, at = docs.schema, docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [union(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            texts = [_kept(t, s).decode("utf-8", "ignore") if s else None for t, s in zip(utf8(batch.column(at)), spans, strict=True)]
            columns = list(batch.columns[:-1])
            cut = pa.array([t is not None for t in texts], pa.bool_())
            columns[at] = pc.if_else(cut, pa.array(texts, pa.string()), columns[at])
            if size is not None:
                columns[size] = pc.if_else(cut, pa.array([None if t is None else len(t) for t in texts], columns[size].type), columns[size])
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return _with_spans(docs, length, run, schema)
