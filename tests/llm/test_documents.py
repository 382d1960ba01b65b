"""Operators over documents against plain versions: on odd rows, and on the smallest shared tables."""

import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenorline.llm import bpe, common, hilbert, iblt, neardup, packing, queries, suffix_dedup, token_counts

SF = "/root/testdata/sf0.001"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(n))


BASE = words(1, 300)
PASSAGE = words(2, 120)
#: Null, empty, blank, short, equal, near, sharing a passage, not ASCII, very long, repeating itself.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One TWO"), (6, BASE), (7, BASE), (8, BASE + " and some more"), (9, BASE.upper()), (10, words(3, 50) + PASSAGE + words(4, 50)),
    (11, PASSAGE + words(5, 80)), (12, "ж" * 450 + "ü" + "ж" * 450), (13, "x" * 1000), (14, words(6, 30_000)), (15, words(7, 200) + " " + words(7, 200)), (16, "a\x00b  c\r\n\r\nd don't I'LL 12345 \u3000 日本語 😀😀"),
    (17, BASE[: len(BASE) // 2] + words(8, 150)), (18, "1 2 3 4"), (19, "1 2 3 4"),
]


def shared() -> list[tuple]:
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


BPE = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def encoded(df, **more):
    ranks = bpe.load_ranks(brute.BYTE_BPE)
    both = bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN, **more), ranks)
    return rows(both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), *BPE)


def test_bpe(spark, docs):
    want = sorted(brute.bpe(ODD))
    assert encoded(docs(ODD)) == want
    assert encoded(docs(ODD).coalesce(1), block=100) == want
    assert encoded(docs(ODD).coalesce(1), block=1000, words=20) == want
    assert rows(queries.op1_bpe(spark, SF), *BPE) == sorted(brute.bpe(shared()))


def test_bpe_words_folded_ahead(spark, docs):
    """Words that several tasks meet are folded once, ahead, and the ids of texts stay the same, whichever words these are."""
    texts = ["zqxatherine leschlichbel  \n ñüciónarllja", "zqxatherine ñüciónarllja onlybyone" + "q" * 300, "zqxatherine", " zqxatherine", None, ""]
    given = docs([(i, x) for i, x in enumerate(texts)]).repartition(6, "doc_id")
    ranks = bpe.load_ranks(brute.BYTE_BPE)
    ahead = bpe.common_words(given, spark.sparkContext.broadcast(ranks), bpe.rank_map(spark, ranks), public_tokenizers.PATTERN, 1.0)
    assert "ñüciónarllja".encode() not in ahead and " ñüciónarllja".encode() in ahead and all(w not in ranks for w in ahead)
    pieces = {rank: piece for piece, rank in ranks.items()}
    assert all(b"".join(pieces[x] for x in np.frombuffer(ids, "<i4").tolist()) == w for w, ids in ahead.items())
    want = sorted(brute.bpe([(i, x) for i, x in enumerate(texts)]))
    assert encoded(given, share=1.0) == want and encoded(given, share=0.5) == want and encoded(given.coalesce(1), share=1.0, block=1) == want


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates(spark, docs):
    assert rows(neardup.near_duplicates(docs(ODD)), *NEAR) == sorted(brute.near(ODD))
    assert rows(queries.op3_minhash(spark, SF), *NEAR) == sorted(brute.near(shared()))


def test_links_that_no_star_sees(docs):
    """A group of texts that share most words with one, and two of its edges with each other."""
    r, made = random.Random(5), []
    base = words(11, 200).split()
    for i in range(60):
        own = list(base)
        at, n = r.randrange(150), r.choice([4, 12, 25, 40, 60])
        own[at : at + n] = words(100 + i // 2, n).split()
        own[-1] = f"w{i}"
        made.append((i, " ".join(own)))
    assert rows(neardup.near_duplicates(docs(made)), *NEAR) == sorted(brute.near(made))


def test_a_hash_that_very_many_texts_share(docs):
    """Texts of one template that don't link all meet in its hashes; copies, near copies and sizes at the edge of a link among them are found, and nothing else."""
    r, template = random.Random(9), words(12, 60)
    made = [(i, template + " " + words(300 + i, r.choice([25, 30, 40, 80]))) for i in range(250)]
    made += [(1000 + i, made[i * 9][1] + (" tail" * (i % 4))) for i in range(25)] + [(2000, words(13, 79)), (2001, words(13, 79) + " " + words(14, 25)), (2002, words(13, 79) + " " + words(14, 26))]
    assert rows(neardup.near_duplicates(docs(made)), *NEAR) == sorted(brute.near(made))


def test_near_duplicates_of_repeated_and_null_ids(docs):
    got = {tuple(r) for r in neardup.near_duplicates(docs([(None, BASE), (1, BASE), (1, "other text of its own here"), (2, "other text of its own here")])).select(*NEAR).collect()}
    assert {g[2:] for g in got if g[0] is None} == {(None, True)} and {g[2] for g in got if g[0]} == {1}
    assert neardup.keep_one(docs([(3, BASE), (4, BASE)])).select("doc_id").collect() == [(3,)]
    # Documents 1 and 4 repeat their ids with other texts, each of which has a group of its own.
    two = [(1, BASE), (1, PASSAGE), (4, words(70, 80)), (4, BASE + " more"), (5, PASSAGE + " x"), (6, words(70, 80)), (7, words(71, 50))]
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(two)).collect()} == {1: 1, 4: 1, 5: 1, 6: 1, 7: 7}
    clash = docs([(3, BASE), (4, BASE)]).withColumnsRenamed({"h": "gone", "units": "gone_"})
    assert neardup.keep_one(clash).columns == clash.columns and neardup.keep_one(clash).count() == 1


SPANS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot,length,wide", [(1000, 400, 20_000), (3, 400, 2), (1000, 90, 2)])
def test_repeats(spark, docs, monkeypatch, hot, length, wide):
    """Also where anchors are split, and where they are merged in groups, whose runs are merged in several rounds."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    if wide == 2:
        monkeypatch.setattr(suffix_dedup, "FAN", 2)
        monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "FEW", 20_000 if length == 400 else 0)
    r = random.Random(1)
    cut = lambda: PASSAGE[(a := r.randrange(150)) : a + r.randrange(380, 500)]
    many = [*ODD, *((100 + i, words(50 + i, r.randrange(5, 60)) + cut() + words(90 + i, 20)) for i in range(25))]
    assert rows(suffix_dedup.report(docs(many), length), *SPANS) == sorted(brute.repeats(many, length))
    if hot > 3:
        assert rows(suffix_dedup.report(spark.read.parquet(f"{SF}/documents.parquet"), length), *SPANS) == sorted(brute.repeats(shared(), length))


def test_the_very_same_units_of_a_split_anchor_move_once(docs, monkeypatch):
    """Of a line that fills texts, and so of an anchor with very many units, each different unit is one piece, not each place of it."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    line = words(20, 90)
    given = [(i, words(1300 + i, 30) + line * 40 + words(1400 + i, 30)) for i in range(6)]
    left, plain = [], suffix_dedup._sorted_spans

    def counted(*a):
        out = plain(*a)
        left.append((out[1].count(), out[1].select("text").distinct().count()))
        return out

    monkeypatch.setattr(suffix_dedup, "_sorted_spans", counted)
    monkeypatch.setattr(suffix_dedup, "_with_texts", lambda *a, f=suffix_dedup._with_texts: f(*a).coalesce(1))
    assert rows(suffix_dedup.report(docs(given)), *SPANS) == sorted(brute.repeats(given))
    assert 0 < left[0][0] == left[0][1]


def test_equal_units_become_one():
    """Equal keys with suffixes of one length are one unit; its members with a place are told to be repeated."""
    keys = [b"aa", b"ab", b"ab", b"ab", b"abc", b"b", b"b"]
    info = np.array([[r, 0, 1, 1, 1, i, i, i] for i, r in enumerate([1, 2, 1, 2, 2, 1, 1])])
    info[6, 3:5] = 2, 0
    out, shared, kept, settled = suffix_dedup.collapse(keys, suffix_dedup.shared_with_previous(keys), info)
    assert out == [b"aa", b"ab", b"ab", b"abc", b"b"] and shared.tolist() == [0, 1, 2, 2, 0]
    assert kept[:, 0].tolist() == [1, 1, 2, 2, 1] and kept[:, 3].tolist() == [1, 1, 2, 1, 2] and kept[:, 4].tolist() == [1, 1, 0, 1, 0]
    assert sorted(settled[:, 5].tolist()) == [1, 3, 5]
    assert suffix_dedup.front_decode(*suffix_dedup.front_code(out, shared)) == out


def test_unlike_units_of_one_hash_are_told_apart(spark, docs, monkeypatch):
    """Hashes of units decide nothing: with one for all, the result is the same."""
    plain = suffix_dedup._open
    monkeypatch.setattr(suffix_dedup, "_open", lambda units: plain(suffix_dedup.materialize(units.withColumn("s", F.lit(1).cast("long")), "units")))
    assert rows(suffix_dedup.report(docs(ODD)), *SPANS) == sorted(brute.repeats(ODD))


def test_repeats_of_repeated_rows_and_clashing_names(spark):
    given = [(1, BASE), (1, BASE), (None, PASSAGE + "ж" * 100), (None, None), (3, ""), (3, PASSAGE)]
    names = "h c _h _c _kh _kc spans _spans units row".split()
    made = spark.createDataFrame([(d, t, *"abcdefghij") for d, t in given], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    null_first = lambda x: [(y is None, y) for y in x]
    assert sorted((tuple(r) for r in suffix_dedup.report(made).select(*SPANS).collect()), key=null_first) == sorted(brute.repeats(given), key=null_first)
    out = suffix_dedup.remove(made)
    assert out.columns == made.columns and {tuple(r)[2:] for r in out.collect()} == {tuple("abcdefghij")}
    assert sorted((r["text"] or "")[:3] for r in out.collect()) == ["", "", "", "", "", "жжж"] and out.where("text is null").count() == 1


def test_repeats_go_from_texts(docs):
    out = {r["doc_id"]: r for r in suffix_dedup.remove(docs([(1, "ж" * 300 + BASE), (2, "q" + BASE), (3, None)])).collect()}
    assert out[3]["text"] is None and out[2]["text"] == "q" and out[2]["n_chars"] == 1 and BASE not in out[1]["text"]


def test_spans_take_one_python_worker_a_task(docs, monkeypatch):
    """Few spans are broadcast to the step that cuts texts; of many, rows that stay are looked up and passed on in one step."""
    plan = lambda: suffix_dedup.remove(docs(ODD))._jdf.queryExecution().executedPlan().toString()
    assert plan().count("MapInArrow") == 1
    monkeypatch.setattr(suffix_dedup, "FEW", 0)
    assert plan().count("MapInArrow") == 3


def test_texts_without_repeats_stay_where_they_are(spark, docs, monkeypatch):
    """Only texts that may have repeats are shuffled, however large tables are; a filter that holds too many keys lets all through, with the same result."""
    monkeypatch.setattr(suffix_dedup, "FEW", 0)
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 20)
    given = [(i, words(1000 + i, 20_000)) for i in range(20)] + [(100 + i, words(50 + i, 5) + PASSAGE) for i in range(3)]
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        assert rows(suffix_dedup.report(docs(given)), *SPANS) == sorted(brute.repeats(given))
        assert moved() - before < sum(len(t) for _, t in given) / 4
        monkeypatch.setattr(common, "FILTER_BITS", 0)
        assert rows(suffix_dedup.report(docs(given)), *SPANS) == sorted(brute.repeats(given))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_packing(spark, docs):
    for source, given in ((docs(ODD), ODD), (spark.read.parquet(f"{SF}/documents.parquet"), shared())):
        pieces = [r.asDict() for r in packing.pack(source, brute.WORD_BPE).collect()]
        brute.check_packing(given, pieces)
    assert all(zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] for p in pieces)


def test_packing_holds_the_mixture(spark):
    """Every full window has each source's share, to a quantum or two."""
    made = spark.createDataFrame([(i, words(i, 400), "a" if i % 4 else "b") for i in range(120)], "doc_id long, text string, source string")
    out = packing.pack(made, brute.WORD_BPE)
    by = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("source") == "b", F.col("length")).otherwise(0)).alias("b")).where("n = 2048").collect()
    assert len(by) > 10 and all(abs(r["b"] / 2048 - 0.25) <= 2 * packing.QUANTUM / 2048 for r in by)


def test_packing_of_small_sources(spark, monkeypatch):
    """Sources that share a queue have their shares together in every full window; bases that are joined give the same pieces."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    monkeypatch.setattr(packing, "FALLBACK", 1)
    given = [(i, words(i, 400)) for i in range(160)]
    made = spark.createDataFrame([(i, t, "a" if i % 2 else f"s{i % 8}") for i, t in given], "doc_id long, text string, source string")
    out = packing.pack(made, brute.WORD_BPE)
    pieces = [r.asDict() for r in out.collect()]
    brute.check_packing(given, pieces)
    by = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("source") == "a", F.col("length")).otherwise(0)).alias("a")).where("n = 2048").collect()
    assert len(by) > 10 and all(abs(r["a"] / 2048 - 0.5) <= 2 * packing.QUANTUM / 2048 for r in by)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    key = lambda p: (p["sequence_id"], p["offset"], p["doc_id"], p["start"], p["ids_crc32"])
    assert sorted(map(key, pieces)) == sorted(key(r.asDict()) for r in packing.pack(made, brute.WORD_BPE).collect())


def test_packing_of_odd_words(spark):
    """Words that the memory takes apart or encodes by the bare model have the tokenizer's ids."""
    r = random.Random(1)
    letters = "abcXYZ019'.,!_-\n\t \r\x0b\x0c\x1c\x1f\x85\xa0éÉßſKİ́ 日жsTREllaªºµÿþÞ²¼"
    made = ["".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(5000)]
    encode, ids = packing.Tokenizer.from_file(brute.WORD_BPE).encode, packing.Words.at(brute.WORD_BPE)
    assert all(ids(x) == np.array(encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in made)


def test_token_counts(spark, docs):
    enc = brute.encoding()
    state = token_counts.trees(docs(ODD), brute.BYTE_BPE, public_tokenizers.PATTERN)
    edits = F.expr("array(null, named_struct('at', 3L, 'cut', 5L, 'new', ' new words'), named_struct('at', 0L, 'cut', 1L, 'new', cast(null as string)), named_struct('at', 500L, 'cut', 200L, 'new', 'x'), named_struct('at', 999999999L, 'cut', 5L, 'new', ' end'))")
    done = token_counts.update(state.withColumn("edits", edits), brute.BYTE_BPE, public_tokenizers.PATTERN).select("doc_id", "text", F.expr(token_counts.total()).alias("n"), "encoded")
    got = {r["doc_id"]: r for r in done.collect()}
    for doc_id, text in ODD:
        t = text or ""
        for at, cut, new in ((3, 5, " new words"), (0, 1, ""), (500, 200, "x"), (10**9, 5, " end")):
            t = t[:at] + new + t[min(at, len(t)) + cut :] if at <= len(t) else t + new
        assert got[doc_id]["text"] == t and got[doc_id]["n"] == len(enc.encode_ordinary(t)), doc_id
    assert got[14]["encoded"] < 0.1 * len(ODD[13][1])
    q = {r["doc_id"]: r for r in queries.op4_token_counts(spark, SF).collect()}
    for doc_id, text in shared():
        t = text or ""
        n = len(t)
        a = t[: n // 3] + "an edited passage, " + t[n // 3 + 8 :]
        b = a[: n // 2] + t[:40] + a[n // 2 :]
        c = b[: n + 100] + "\n The end." + b[n + 100 :]
        assert (q[doc_id]["n_tokens"], q[doc_id]["edited_tokens"], q[doc_id]["edited_sha256"]) == (len(enc.encode_ordinary(t)), len(enc.encode_ordinary(c)), brute.sha(c.encode()))


def test_hilbert(spark, docs):
    twice = [*ODD, *ODD[:3], (None, "x"), (None, None)]
    for made, given in ((hilbert.shards(docs(twice), 8), twice), (queries.op8_hilbert(spark, SF), shared())):
        out = made.collect()
        key = lambda x: [(y is None, y) for y in x]
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=key) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in given), key=key)
        slots = {k: sorted(r["slot"] for r in out if r["shard"] == k) for k in range(8)}
        assert all(s == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_prune(spark):
    """Readers of one value skip many shards by least and greatest values, in each dimension; rows dealt at random would let them skip none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = hilbert.shards(docs, 8)
    ends = {r["shard"]: r for r in hilbert.summary(placed).collect()}
    assert sum(r["rows"] for r in ends.values()) == docs.count() and len(ends) == 8
    rows = placed.select("lang", "source", "size", "doc_id").collect()
    skipped = {c: sum(not e[f"min_{c}"] <= r[c] <= e[f"max_{c}"] for r in rows for e in ends.values()) / len(rows) / 8 for c in ("lang", "source", "size", "doc_id")}
    assert sum(skipped.values()) > 1 and sorted(skipped.values())[1] > 0.15, skipped
    assert [r["curve"] for r in placed.orderBy("shard", "slot").collect()] == sorted(r["curve"] for r in placed.collect())


def test_curve_is_a_walk(spark):
    """Along a Hilbert curve each step changes one dimension by one, and each cell comes once."""
    cells = spark.range(4096).selectExpr("cast(id & 15 as int) as a", "cast(shiftright(id, 4) & 15 as int) as b", "cast(shiftright(id, 8) & 15 as int) as c")
    walk = [tuple(r)[1:] for r in sorted(cells.select(hilbert.curve_index(["a", "b", "c"], 4).alias("h"), "a", "b", "c").collect())]
    assert all(sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1 for p, q in zip(walk, walk[1:]))


def test_fingerprints(spark, docs):
    for source, given in ((docs(ODD), ODD), (spark.read.parquet(f"{SF}/documents.parquet"), shared())):
        v = iblt.with_likeness(iblt.with_likeness(iblt.versions(source), "e", "digests", "edited_digests"), "n", "digests", "next_digests").collect()
        exact = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
        assert all(abs(r["e"] - exact(r["digests"], r["edited_digests"])) < 1e-9 and abs(r["n"] - exact(r["digests"], r["next_digests"])) < 1e-9 for r in v)
        out = (queries.op9_iblt(spark, SF) if given is not ODD else iblt.fingerprints(source)).collect()
        assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == sorted(brute.edited(given))
        lists = lambda rows, *names: sorted((r["doc_id"] or 0, *(sorted(x) for x in (set(r[names[0]]) - set(r[names[1]]), set(r[names[1]]) - set(r[names[0]])))) for r in rows)
        assert sorted((r["doc_id"] or 0, sorted(r["gone"]), sorted(r["come"])) for r in out) == lists(v, "digests", "edited_digests")
    by = {r["doc_id"]: r["fingerprint"] for r in iblt.fingerprints(docs(ODD)).collect()}
    assert by[6] == by[7] and by[18] == by[19] and by[6] != by[8] and by[1] == by[2]


def test_paragraphs_end_at_each_sentence(docs):
    """Short sentences of one line are digests of their own, so an edit of the last third leaves the others alike; no character is left out."""
    text = "One is here. Two is there! Is three? Four. Five is the last one"
    long = words(20, 90).replace(" ", "")[:300]
    made = [(1, text), (2, long), (3, "...\n?! then\n!!"), (4, "Six. Seven.")]
    got = {r["doc_id"]: (len(r["digests"]), r["likeness"]) for r in iblt.with_likeness(iblt.versions(docs(made)), "likeness", "digests", "edited_digests").collect()}
    assert {k: n for k, (n, _) in got.items()} == {1: 5, 2: 3, 3: 4, 4: 2} and got[1][1] > 0.3


def test_fingerprints_alone(spark, docs):
    """Stored fingerprints of any two lengths give the exact likeness wherever they peel; with the digests at hand, always."""
    ranges = [(1, 5, 3, 9), (1, 100, 1, 100), (1, 2000, 20, 2010), (1, 40, 30, 60), (1, 600, 1, 9), (1, 300, 301, 600), (1, 0, 1, 0), (1, 0, 1, 4)]
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "i int, a int, b int, c int, d int")
    hashes = lambda x, y: F.expr(f"if({y} < {x}, cast(array() as array<bigint>), transform(sequence({x}, {y}), v -> xxhash64(v)))")
    both = iblt.with_likeness(made.select("i", hashes("a", "b").alias("one"), hashes("c", "d").alias("two")), "near", "one", "two")
    prints = both.select("i", "near", F.expr(iblt.fingerprint(iblt.sketch("one"))).alias("one"), F.expr(iblt.fingerprint(iblt.sketch("two"))).alias("two"))
    got = {r["i"]: (r["near"], r["alone"]) for r in prints.withColumn("alone", F.expr(iblt.stored_likeness("one", "two"))).collect()}
    for i, (a, b, c, d) in enumerate(ranges):
        one, two = set(range(a, b + 1)), set(range(c, d + 1))
        exact = len(one & two) / len(one | two) if one | two else 1.0
        assert abs(got[i][0] - exact) < 1e-9 and (got[i][1] is None or abs(got[i][1] - exact) < 1e-9)
    assert all(got[i][1] is not None for i in (0, 1, 2, 6, 7)) and got[4][1] is None


def test_empty_tables(docs):
    none = docs([(1, "x")]).where("doc_id < 0")
    ranks = bpe.load_ranks(brute.BYTE_BPE)
    made = [bpe.encode(none, ranks, public_tokenizers.PATTERN), neardup.near_duplicates(none), neardup.keep_one(none), suffix_dedup.report(none), suffix_dedup.remove(none), packing.pack(none, brute.WORD_BPE), hilbert.shards(none), iblt.fingerprints(none)]
    assert all(df.count() == 0 for df in made)


def test_groups_of_the_longer_text_are_not_sketched_again(spark):
    """Of sets of very different sizes, finer groups are compared by the tables that the larger one's sketch has: a digest that only the sketch has comes out."""
    r = random.Random(8)
    large = [r.getrandbits(62) for _ in range(400)]
    other = [large[0] ^ 1 << 61, *large[1:]]  # in the same group
    df = spark.createDataFrame([(large, other, large[:5])], "a array<bigint>, told array<bigint>, b array<bigint>").withColumns({"s": F.expr(iblt.sketch("told")), "t": F.expr(iblt.sketch("b"))})
    for one, two, s, t, mine in (("a", "b", "s", "t", "mine"), ("b", "a", "t", "s", "other")):
        found = iblt.with_difference(df, "d", one, two, s, t).first()["d"]
        assert other[0] in found[mine] and large[0] not in found[mine] and set(large[5:]) <= set(found[mine])
    same = df.withColumn("s", F.expr(iblt.sketch("a")))
    assert sorted(iblt.with_difference(same, "d", "a", "b", "s", "t").first()["d"]["mine"]) == sorted(large[5:])


def test_tables_with_too_many_digests_for_their_cells(spark):
    """A table doesn't peel if one side has more digests than cells besides the other's, and is given up before any round; others peel as before."""
    one = spark.range(1).select(F.expr("transform(sequence(1, 100), x -> xxhash64(x))").alias("a"))
    table = lambda of: iblt.cells(of, str(iblt.CELLS // 3), "0")
    found = lambda n, m: one.select(F.expr(iblt._peeled(iblt._subtract(table(f"slice(a, 1, {n})"), table(f"slice(a, 11, {m})")), str(iblt.CELLS // 3), "0")).alias("x"), "a").first()
    assert found(0, iblt.CELLS + 1)["x"] is None and found(90, 20)["x"] is None
    x, a = found(20, 20)
    assert sorted(x["mine"]) == sorted(a[:10]) and sorted(x["other"]) == sorted(a[20:30])


def test_new_words_take_the_model_alone():
    """Words of letters that aren't remembered go to the model as they are, without an encoding around them; ids are the tokenizer's, and runs of symbols before a full stop are found as before."""
    encode, memory, r = Tokenizer.from_file(brute.WORD_BPE).encode, packing.Words.at(brute.WORD_BPE), random.Random(9)
    assert [x.id for x in memory.bare("qzxunseenword")] == encode("qzxunseenword", add_special_tokens=False).ids
    before = re.compile(r"[^\w\t-\r \x85\xa0][.,] |_[.,] ")
    for _ in range(2000):
        text = "".join(r.choice(["ab", "Q", "7", "_", ".", ",", ";", " ", "\n", "\x85", "\xa0", "é", "ß", "ª", "'", "µ", "ż"]) for _ in range(r.randrange(14)))
        assert bool(packing._RUN.search(text)) == bool(before.search(text)), text
        assert np.frombuffer(memory(text), dtype="<u4").tolist() == encode(text, add_special_tokens=False).ids, text
