"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text's paragraphs (lines, cut at each sentence end and after PARAGRAPH characters) give a set of distinct 64-bit digests. They are
dealt by their low bits into 1, 2, 4, ... groups of at most about GROUP digests, and the fingerprint has a table of CELLS cells for
each group. A digest adds itself to one cell in each of three parts of its table: to the cell's count, to the XOR of its digests and
to the XOR of their checks.

Two fingerprints are compared as they are: tables of the one with more groups are added up to those of the other, tables
subtract cell by cell, which cancels all digests that both hold, and peeling cells that hold a single digest recovers the digests
that only one has, and which. Groups with cells left that don't peel are sketched again from both versions' digests: as finer groups
where tables were added up, then each twice as large and with other hashes, up to ATTEMPTS sizes; a group that peels at none is compared exactly. The likeness is shared
digests by all digests.

Groups halve bit by bit, so the work of a text grows as n log n. All of it is DataFrame code: cells, subtraction and peeling are
folds over arrays within a row, so nothing is exploded or grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .hilbert import ranked

#: Characters of a paragraph at most, without the marks that end it; cells of a table; digests of a group; rounds of peeling; attempts at most.
PARAGRAPH, CELLS, GROUP, ROUNDS, ATTEMPTS = 120, 48, 16, 32, 6
_NO_ID = -(2**63)


def digests(text: str) -> str:
    """SQL: the distinct digests of a text's paragraphs, without the blanks around them; none for a text of blanks."""
    return (
        f"array_distinct(transform(filter(transform(regexp_extract_all({text}, '[^\\\\n.!?]{{1,{PARAGRAPH}}}[.!?]*|[.!?]+', 0), x -> trim(x)), x -> x <> ''), x -> xxhash64(x)))"
    )


def _let(name: str, value: str, then: str) -> str:
    """SQL: then, in which name stands for value, which is worked out once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _placed(of: str, n: str, key: str, third: str, seed: str) -> str:
    """SQL: count (n), key, check and cells (one in each part) of each d of an array."""
    at = ", ".join(f"'c{p}', {p} * {third} + cast(pmod(xxhash64({key}, {p}, {seed}), {third}) as int)" for p in range(3))
    return f"transform({of}, d -> named_struct('n', {n}, 'key', {key}, 'check', xxhash64({key}, 7), {at}))"


def _table(placed: str, third: str) -> str:
    """SQL: the cells of what _placed() gives: sum of counts, XOR of keys, XOR of checks."""

    def part(p: int) -> str:
        add = f"if(x.c{p} = c, named_struct('n', a.n + x.n, 'key', a.key ^ x.key, 'check', a.check ^ x.check), a)"
        return f"transform(sequence({p} * {third}, {p + 1} * {third} - 1), c -> aggregate(placed, named_struct('n', 0L, 'key', 0L, 'check', 0L), (a, x) -> {add}))"

    return _let("placed", placed, f"concat({part(0)}, {part(1)}, {part(2)})")


def cells(of: str, third: str, seed: str) -> str:
    """SQL: the cells of a table of an array of digests, three parts of third (an int) cells: count, XOR of digests, XOR of checks."""
    return _table(_placed(of, "1L", "d", third, seed), third)


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'key', x.key ^ y.key, 'check', x.check ^ y.check))"


def _level(of: str) -> str:
    """SQL: the number of halvings after which groups of an array have at most about GROUP members."""
    return f"cast(greatest(0, ceil(log2(size({of}) / {GROUP}))) as int)"


def _groups(of: str, level: str) -> str:
    """SQL: an array of digests in 2 ** level groups; the two halves of a group lie side by side."""
    halves = "array(filter(p, d -> getbit(d, i - 1) = 0), filter(p, d -> getbit(d, i - 1) = 1))"
    return f"if({level} = 0, array({of}), aggregate(sequence(1, {level}), array({of}), (parts, i) -> flatten(transform(parts, p -> {halves}))))"


def sketch(of: str) -> str:
    """SQL: the tables of an array of digests, a list of cells for each group."""
    return f"transform({_groups(of, _level(of))}, g -> {cells('g', str(CELLS // 3), '0')})"


def fingerprint(tables: str) -> str:
    """SQL: what sketch() gives, as base64 of its cells."""
    return f"base64(unhex(array_join(transform(flatten({tables}), x -> concat(lpad(hex(x.n), 8, '0'), lpad(hex(x.key), 16, '0'), lpad(hex(x.check), 16, '0'))), '')))"


def stored(text: str) -> str:
    """SQL: the tables of a fingerprint()."""
    number = lambda start, n: f"cast(conv(substring(bytes, i * 40 + {start}, {n}), 16, -10) as bigint)"
    cell = f"named_struct('n', {number(1, 8)}, 'key', {number(9, 16)}, 'check', {number(25, 16)})"
    table = f"transform(sequence(g * {CELLS}, (g + 1) * {CELLS} - 1), i -> {cell})"
    return _let("bytes", f"hex(unbase64({text}))", f"transform(sequence(0, cast(length(bytes) / {40 * CELLS} as int) - 1), g -> {table})")


def _folded(tables: str, to: str) -> str:
    """SQL: tables added up to a smaller number of groups, a power of two."""
    add = "zip_with(x, y, (v, w) -> named_struct('n', v.n + w.n, 'key', v.key ^ w.key, 'check', v.check ^ w.check))"
    each = _let("own", f"slice({tables}, g * (size({tables}) div {to}) + 1, size({tables}) div {to})", f"aggregate(slice(own, 2, size(own)), own[0], (x, y) -> {add})")
    return f"if(size({tables}) = {to}, {tables}, transform(sequence(0, {to} - 1), g -> cast({each} as array<struct<n: bigint, key: bigint, check: bigint>>)))"


def _peeled(left: str, third: str, seed: str) -> str:
    """SQL: the digests that only the first (mine) and only the second of two tables has (other), recovered from the difference of their cells; null if they don't peel."""
    pure = "array_distinct(transform(filter(s.cells, x -> abs(x.n) = 1L and x.check = xxhash64(x.key, 7)), x -> named_struct('n', x.n, 'key', x.key)))"
    # Only cells that a digest lies in are made again, each part by the digests' cells in it.
    minus = lambda p: f"if(x.c{p} = c, named_struct('n', a.n - x.n, 'key', a.key ^ x.key, 'check', a.check ^ x.check), a)"
    again = lambda p: f"transform(sequence({p} * {third}, {p + 1} * {third} - 1), c -> if(array_contains(hit, c), aggregate(placed, s.cells[c], (a, x) -> {minus(p)}), s.cells[c]))"
    part = lambda p: _let("hit", f"transform(placed, x -> x.c{p})", again(p))
    less = _let("placed", _placed("now", "d.n", "d.key", third, seed), f"concat({part(0)}, {part(1)}, {part(2)})")
    after = f"named_struct('cells', {less}, 'found', concat(s.found, now), 'stuck', false)"
    step = _let("now", pure, f"if(size(now) = 0, named_struct('cells', s.cells, 'found', s.found, 'stuck', true), {after})")
    start = "named_struct('cells', less, 'found', cast(array() as array<struct<n: bigint, key: bigint>>), 'stuck', false)"
    side = lambda n: f"transform(filter(s.found, x -> x.n = {n}L), x -> x.key)"
    whole = f"if(exists(s.cells, x -> x.n <> 0L or x.key <> 0L or x.check <> 0L), null, named_struct('mine', {side(1)}, 'other', {side(-1)}))"
    peel = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(s.stuck, s, {step}), s -> {whole})"
    # Each cell gives one digest at most, so a table doesn't peel if one side has that many more than the other; a part's counts add up to how many.
    more = f"abs(aggregate(slice(less, 1, {third}), 0L, (sum, x) -> sum + x.n))"
    return _let("less", left, f"if({more} > 3 * {third}, null, {peel})")


def peeled(a: str, b: str) -> str:
    """SQL: from two sketches alone, a list of the digests that only either has (mine, other), for each group of the one with fewer groups; null for a group that doesn't peel."""
    fold = lambda x: _folded(x, "least(size(a), size(b))")
    differ = f"zip_with({fold('a')}, {fold('b')}, (one, two) -> {_peeled(_subtract('one', 'two'), str(CELLS // 3), '0')})"
    return _let("a", a, _let("b", b, differ))


def _again(mine: str, other: str, first: str, left: str) -> str:
    """SQL: the same for a group of digests, by tables twice as large in each attempt from the given one on, and by comparison where none peels. left: the difference of tables of the size of a sketch's, for attempt 0."""
    tables = f"if(t = 0, {left}, {_subtract(cells(mine, 'third', 't'), cells(other, 'third', 't'))})"
    attempt = _let("third", f"cast({CELLS // 3} * pow(2, t) as int)", _peeled(tables, "third", "t"))
    kind = "struct<mine: array<bigint>, other: array<bigint>>"
    plainly = f"named_struct('mine', array_except({mine}, {other}), 'other', array_except({other}, {mine}))"
    return f"coalesce(aggregate(sequence({first}, {ATTEMPTS - 1}), cast(null as {kind}), (z, t) -> if(z is not null, z, {attempt})), {plainly})"


def with_difference(df: DataFrame, name: str, a: str, b: str, sketch_a: str, sketch_b: str) -> DataFrame:
    """df with a column of the digests that only one of two columns of digests has (mine, other), recovered from their sketches; groups that don't peel are sketched again, larger.

    Steps are columns, not nested expressions, so that each is planned and worked out once.
    """
    finer = f"greatest({_level(a)}, {_level(b)})"
    pairs = f"zip_with({_groups(a, 'level')}, {_groups(b, 'level')}, (x, y) -> named_struct('mine', x, 'other', y))"
    # The sketch of the one with more groups has its tables of them already.
    own = lambda tables, group: f"if(size({tables}) = size(pairs), {tables}[h], {cells(group, str(CELLS // 3), '0')})"
    left = _subtract(own("tables_a", "q.mine"), own("tables_b", "q.other"))
    # Groups of the finer one have more cells already than the tables that were added up.
    again = _again("q.mine", "q.other", f"if(size(pairs) > size({name}), 0, 1)", left)
    each = f"transform(slice(pairs, begin + 1, size(pairs) div size({name})), (q, i) -> {_let('h', 'begin + i', again)})"
    part = _let("begin", f"cast(g * (size(pairs) div size({name})) as int)", each)
    retried = _let("level", finer, _let("pairs", pairs, f"flatten(transform({name}, (f, g) -> if(f is null, {part}, array(f))))"))
    retried = _let("tables_a", sketch_a, _let("tables_b", sketch_b, retried))
    every = df.withColumn(name, F.expr(peeled(sketch_a, sketch_b))).withColumn(name, F.expr(f"if(exists({name}, f -> f is null), {retried}, {name})"))
    return every.withColumn(name, F.expr(f"named_struct('mine', flatten(transform({name}, x -> x.mine)), 'other', flatten(transform({name}, x -> x.other)))"))


def ratio(a: str, b: str, differ: str) -> str:
    """SQL: shared digests by all digests of two sets of a and b members, from 0 to 1; two empty ones are alike."""
    return f"if({a} + {b} = 0, 1D, {_let('d', f'size({differ}.mine) + size({differ}.other)', f'({a} + {b} - d) / cast({a} + {b} + d as double)')})"


def with_likeness(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """df with a column of the likeness of two columns of digests, by their sketches."""
    sketched = df.withColumns({f"{name}_a": F.expr(sketch(a)), f"{name}_b": F.expr(sketch(b))})
    differ = with_difference(sketched, f"{name}_d", a, b, f"{name}_a", f"{name}_b")
    return differ.withColumn(name, F.expr(ratio(f"size({a})", f"size({b})", f"{name}_d"))).drop(f"{name}_a", f"{name}_b", f"{name}_d")


def stored_likeness(a: str, b: str) -> str:
    """SQL: the likeness of two fingerprints, from nothing else; null if they don't peel."""
    held = lambda x: f"cast(aggregate(flatten({x}), 0L, (sum, c) -> sum + c.n) / 3 as bigint)"
    both = "named_struct('mine', flatten(transform(first, x -> x.mine)), 'other', flatten(transform(first, x -> x.other)))"
    found = _let("first", peeled("p", "q"), f"if(exists(first, f -> f is null), null, {_let('differ', both, ratio(held('p'), held('q'), 'differ'))})")
    return _let("p", stored(a), _let("q", stored(b), found))


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, digests, edited_digests, next_digests of each document.

    The edited text has the last third of the characters replaced by as many (or all) of the next document's first ones, in the order of
    descending doc_id (null last; equal ids by a hash of their text), and after the last document comes the first. Rows that
    repeat an id and a text are one document, but each comes out. A single document is its own next one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = base.select("k", "h", F.length("text").alias("n")).distinct()
    order = materialize(ranked(keys, [F.col("k").desc(), F.col("h")], "rank"), "order")
    total = order.count()
    after = order.select(F.pmod(F.col("rank") - 1, F.lit(max(1, total))).alias("rank"), F.col("k").alias("k"), F.col("h").alias("h"))
    follows = order.select("rank", F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n") / 3).cast("int").alias("third")).join(after, "rank").drop("rank")
    # Both joins read one shuffle of the texts; rows that repeat an id and a text lie side by side after the first.
    near = base.join(follows, ["k", "h"]).dropDuplicates(["k", "h"])
    lent = near.select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), "third", F.expr("substring(text, 1, third)").alias("start"), F.expr(digests("text")).alias("next_digests"))
    edited = F.expr("concat(substring(text, 1, length(text) - third), start)")
    both = base.join(lent, ["k", "h"]).select("k", "text", edited.alias("edited"), "next_digests")
    return both.select(F.expr(f"nullif(k, {_NO_ID})").alias("doc_id"), "text", "edited", F.expr(digests("text")).alias("digests"), F.expr(digests("edited")).alias("edited_digests"), "next_digests")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs, and the digests that the edit takes away (gone) and brings (come), as peeling recovers them.

    A null text is empty; texts without paragraphs have an empty table and are alike; equal texts have equal fingerprints; very
    long texts have more groups of digests, not other paragraphs; an empty table gives no rows; other columns don't matter.
    """
    tables = versions(docs).withColumns({x: F.expr(sketch(of)) for x, of in (("own", "digests"), ("later", "edited_digests"), ("follower", "next_digests"))})
    compared = with_difference(with_difference(tables, "edit", "digests", "edited_digests", "own", "later"), "step", "digests", "next_digests", "own", "follower")
    return compared.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(fingerprint("own")).alias("fingerprint"), F.expr(fingerprint("later")).alias("edited_fingerprint"),
        F.expr(ratio("size(digests)", "size(edited_digests)", "edit")).alias("near_edited"), F.expr(ratio("size(digests)", "size(next_digests)", "step")).alias("near_next"),
        F.col("edit.mine").alias("gone"), F.col("edit.other").alias("come"),
    )
