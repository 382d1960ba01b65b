"""Exact duplicates, collocations and conversation repair against plain versions, on odd rows and on the smallest shared tables."""

import functools
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tenorline.llm import collocations, conversation_repair, exact_dedup, queries

SF = "/root/testdata/sf0.001"
MESSAGE = "conv_id long, turn long, role string, text string, code string, place string"
KEPT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
null_first = lambda x: [(y is None, y if y is not None else 0) for y in x]


def in_order(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=null_first)


def brute_exact(given):
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    best = {}
    for d, t in given:
        best[t or ""] = max(best.get(t or "", (-(2**70), 0))[0], -(2**69) if d is None else d), best.get(t or "", (0, 0))[1] + 1
    out = []
    for d, t in given:
        keep, n = best[t or ""]
        out.append((d, None if keep == -(2**69) else keep, n, d == keep, sha(t)))
    return sorted(out, key=null_first)


def test_exact_duplicates(spark, docs):
    r = random.Random(1)
    given = [(i, r.choice(["hot"] * 5 + [None, "", "ж é", "long " * 50_000, f"own {i}", f"few {i % 30}"])) for i in range(600)]
    assert in_order(exact_dedup.exact_duplicates(docs(given)), *KEPT) == brute_exact(given)
    kept = exact_dedup.keep_one(docs(given))
    assert kept.columns == docs(given).columns and in_order(kept, "doc_id") == [r[:1] for r in brute_exact(given) if r[3]]
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    assert in_order(queries.op11_exact(spark, SF), *KEPT) == brute_exact(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))


def test_exact_duplicates_keep_one_of_equal_ids(docs):
    given = docs([(None, "a"), (None, "a"), (3, "b"), (3, "b"), (None, "b"), (4, "c")]).withColumnsRenamed({"h": "digest", "units": "n"})
    got = in_order(exact_dedup.exact_duplicates(given), "text_sha256", "doc_id", "keep_id", "group_size", "kept")
    assert Counter((r[0], r[4]) for r in got)[hashlib.sha256(b"a").hexdigest(), True] == 1 and sum(r[4] for r in got) == 3
    assert {r[2] for r in got if r[0] == hashlib.sha256(b"b").hexdigest()} == {3} and in_order(exact_dedup.keep_one(given), "doc_id", "text") == [(3, "b"), (4, "c"), (None, "a")]
    none = given.where("false")
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.keep_one(none).count() == exact_dedup.sizes(none).count() == 0


def test_frequent_digests_are_found_and_stay(spark):
    """A digest of a third of all rows is in the broadcast table; no digest of the rest has more than the summary's share of rows."""
    rows = spark.range(90_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("x"), (F.col("id") % 7001).cast("string"))).alias("digest"), F.col("id").alias("row"))
    heavy, light = exact_dedup.winners(rows)
    assert [(r["digest"], r["keep_id"], r["n"]) for r in heavy.collect() if r["digest"] == "hot"] == [("hot", 89_997, 30_000)]
    assert heavy.count() <= exact_dedup.TOP and light.agg(F.max("n")).first()[0] < 90_000 * 7 / exact_dedup.TRACKED + 1
    plan = rows.join(F.broadcast(heavy), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def brute_phrases(given, least):
    table = str.maketrans({c: "\n" for c in ".,;:!?\r\x0b\x0c"} | {"\t": " "})
    n, f = Counter(), Counter()
    for text, lang in given:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(table)
        for piece in low.split("\n"):
            w = [x for x in piece.split(" ") if x]
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in found.items():
        m = len(w)
        if any(y[0] == lang and len(y[1]) > m and any(y[1][i : i + m] == w for i in range(len(y[1]) - m + 1)) and 100 * b >= 80 * a for y, b in found.items()):
            continue
        score, _, l_, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, m))
        out.append((lang, -score, -a, " ".join(w).encode(), l_, r, n[lang]))
    ranked, last = [], None
    for lang, s, a, p, l_, r, total in sorted(out):
        rank = rank + 1 if lang == last else 1  # noqa: F821
        last = lang
        ranked.append((lang, rank, p.decode(), -a, l_, r, total, -s))
    return ranked


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("shard,branch", [(16 << 20, 300_000), (2000, 50)])
def test_collocations(spark, monkeypatch, shard, branch):
    """Whole and cut into many shards and branches, with nulls, empty and long texts, repeated rows, words of any bytes."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    monkeypatch.setattr(collocations, "BRANCH", branch)
    r = random.Random(3)
    words = ["Of", "the", "new", "York", "city", "é", "ÉÀ", "\x1c", "\x85x", "日本", "a-b", "1"]
    made = [("".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b", " \r\n"]) for _ in range(r.choice([0, 3, 40, 300]))), r.choice(["en", "de", None])) for _ in range(60)]
    made += [(None, "en"), ("", None), ("new york city hall " * 3000, "en"), ("the the the the the", "de"), ("the the the the the", "de")] + [("big red dog runs. big red", "xx")] * 31
    given = spark.createDataFrame([(None if i % 5 == 0 else i, t, lang, "x", 1) for i, (t, lang) in enumerate(made)], "doc_id long, text string, lang string, phrase string, shard int")
    assert in_order(collocations.collocations(given), *PHRASE) == brute_phrases(made, 30)
    assert collocations.collocations(given.where("false")).count() == 0
    assert in_order(collocations.collocations(given, 2), *PHRASE) == [x for x in brute_phrases(made, 30) if x[1] <= 2]


def test_collocations_of_the_tables(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert in_order(queries.op12_collocations(spark, SF), *PHRASE) == sorted(con.execute(f"SELECT {', '.join(PHRASE)} FROM ({queries.ORACLE_SQL['op12_collocations']})").fetchall())


def test_phrases_leave_a_shard_by_parts(spark, monkeypatch):
    """All pairs of a shard are frequent: its phrases are whole, and come branch by branch; the frequent pairs are looked up some at a time."""
    monkeypatch.setattr(collocations, "PIECE", 1000)
    monkeypatch.setattr(collocations, "BRANCH", 2000)
    monkeypatch.setattr(collocations, "LOOKUP", 5000)
    r = random.Random(5)
    words = [f"w{r.randrange(3000)}" for _ in range(40_000)]
    text = spark.createDataFrame([(" ".join(words), "en")], "text string, lang string")
    shards = collocations._shards(text.select("lang", "text")).cache()
    assert shards.count() > 20 and shards.select("shard").distinct().count() == 1
    pairs = spark.createDataFrame(sorted({f"{a} {b}" for a, b in zip(words, words[1:])}), "string").selectExpr("value AS phrase").crossJoin(shards.select("shard").distinct())
    rows = collocations._with_shard(shards, pairs, "phrase").toArrow().to_batches(max_chunksize=1000)
    parts = list(collocations.longer_of(iter(rows)))
    found = Counter()
    for part in parts:
        found.update(dict(zip(part.column("phrase").to_pylist(), part.column("n").to_pylist())))
    assert found == Counter(" ".join(words[i : i + m]) for m in (3, 4) for i in range(len(words) - m + 1))
    assert sum(len(p) for p in parts) > 70_000 and max(len(p) for p in parts) <= 5000


def test_texts_of_many_languages_are_not_held(spark, monkeypatch):
    """No language fills a shard, but together they are more than a task may hold: shards end early, with the same result."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", 4000)
    monkeypatch.setattr(collocations, "OPEN_SHARDS", 2)
    made = [("of the " * 20 + "new york", f"l{i}") for _ in range(12) for i in range(60)]
    given = spark.createDataFrame(made, "text string, lang string").coalesce(1)
    assert collocations._shards(given.select("lang", "text")).select("shard").distinct().count() > 60
    assert in_order(collocations.collocations(given), *PHRASE) == brute_phrases(made, 30)


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000_000_000
    made = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big), ("en", "b a", 2, big // 3)], "lang string, phrase string, size int, f long")
    assert in_order(collocations.scored(made), "phrase", "score") == [("a b", 1_000_000), ("b a", 2_000_000 * (big // 3) // (2 * big))]


def brute_damage(given):
    out = []
    for conv, turn, role, text in given:
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def brute_repair(rows):
    """Counts, cost, audit and digest of one conversation, by trying all edits (remembered by row and role so far)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    white, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for _, _, role, text in rows:
        end = text.rstrip(white)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))

    @functools.cache
    def best(i, last, inserts):
        """(cost, audit, repaired) of rows from i on, after a row of initial last; so many more inserts before the next row."""
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        role = "assistant" if last == "u" else "user"
        add = lambda cost, letter, row, rest: ways.append((cost + rest[0], letter + rest[1], row + rest[2])) if rest else None
        if inserts:
            add(3, "I", (f"{role}:",), best(i, role[0], inserts - 1))
        if i < len(rows):
            add(4, "D", (), best(i + 1, last, 3))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                if first[i] == role[0] or first[i] == "s" and last == "":
                    add(more, "K", (f"{rows[i][2]}:{rows[i][3]}",), best(i + 1, first[i], 3))
                add(3 + more, "R", (f"{role}:{rows[i][3]}",), best(i + 1, role[0], 3))
        return min(ways) if ways else None

    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, made = best(0, "", 3)
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def brute_report(given, damage=True):
    after = brute_damage(given) if damage else given
    return sorted(((c, *brute_repair([x for x in after if x[0] == c])) for c in {g[0] for g in given}), key=null_first)


def test_repair(spark):
    r = random.Random(7)
    texts = ["Yes.", "No!", "cut", "", " \t\n", "Why?  \n", None, "Yes.", "x" * 100_000 + ".", "é。", "\x1c"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    given = [(c, r.choice([t, t, t, t + 3, None]), r.choice(roles), r.choice(texts)) for c in [*range(150), None] for t in range(r.randrange(1, 9))]
    made = spark.createDataFrame([(*g, "x", "y") for g in given], MESSAGE)
    whole = conversation_repair.report(conversation_repair.damaged(made), made)
    assert in_order(whole, *REPAIR) == brute_report(given)
    plain = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in given]
    assert in_order(conversation_repair.report(made), *REPAIR) == brute_report(plain, False)
    none = made.where("false")
    assert conversation_repair.report(none).count() == 0 and conversation_repair.report(none, made).where("audit = '' and cost = 0").count() == 151


def test_repair_of_the_tables(spark):
    t = pq.read_table(f"{SF}/conversations.parquet", columns=["conv_id", "turn", "role", "text"])
    assert in_order(queries.op13_repair(spark, SF), *REPAIR) == brute_report(list(zip(*(c.to_pylist() for c in t.columns), strict=True)))


def test_repaired_conversations_are_legal(spark):
    out = conversation_repair.repair(conversation_repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["conv_id"], r["step"])):
        by[r["conv_id"]] = by.get(r["conv_id"], "") + r["role"][0]
    assert by and all(s.removeprefix("s") == "ua" * (len(s.removeprefix("s")) // 2) != "" for s in by.values())


def test_the_automaton_stays_small():
    """However long conversations are, few vectors come up, and costs add up by row."""
    r, machine = random.Random(2), conversation_repair.Automaton()
    for n in (0, 1, 5, 100, 20_000):
        rows = bytes(r.choice([0, 1, 2, 3]) + r.choice([0, 0, 4, 8, 16]) for _ in range(n))
        cost, audit = machine.repair(rows)
        assert sum(x != "I" for x in audit) == n and cost <= 4 * n
    assert len(machine.vectors) < 100
