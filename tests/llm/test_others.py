"""URL rules, toxicity, Hamming search and the pipeline."""

import math
import random
import re
import zlib

import brute
import corpus_pipeline
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_documents import SF, words

from tenorline.llm import hamming_search, queries, toxicity, url_filter


def test_url_rules(spark):
    out = {r["page_id"]: r for r in queries.op2_url_rules(spark, SF).collect()}
    t = pq.read_table(f"{SF}/pages.parquet", columns=["page_id", "url"])
    assert len(out) == len(t)
    for page_id, url in zip(t["page_id"].to_pylist(), t["url"].to_pylist(), strict=True):
        host, path, rule, verdict = brute.url_rule(url)
        got = out[page_id]
        assert (got["host"], got["path"], got["rule"]) == (host, path, rule) and (verdict is None or got["verdict"] == verdict)


def test_mined_rules_of_the_tables(spark):
    """What the mined rules say of all pages is what trying all combinations of up to three tokens says; both answers come up."""
    sf = "/root/testdata/sf0.01"
    pages, labels = (pq.read_table(f"{sf}/{n}.parquet").to_pylist() for n in ("pages", "labels"))
    marked = {x["doc_id"] for x in labels if x["toxic"] == 1 or x["quality"] == 0}
    bad = {p["page_id"]: p["page_id"] in marked or re.search(r'<html[^>]* lang="(\w+)', p["html"])[1] != "en" for p in pages}
    want = brute.mined_urls([(p["page_id"], p["url"]) for p in pages], bad, max(url_filter.LEAST, math.ceil(url_filter.SUPPORT * len(pages))), url_filter.CONFIDENCE)
    out = queries.op2_url_rules(spark, sf).collect()
    assert {r["page_id"] for r in out if r["mined"]} == want and 0 < len(want) < len(pages)
    assert {r["verdict"] for r in out if r["rule"] is None and r["mined"]} == {"block"} and {r["verdict"] for r in out if r["rule"] is None and not r["mined"]} == {"allow"}


def test_mined_rules(spark):
    """A combination of tokens that goes with bad labels is found and blocks; its parts alone don't."""
    r = random.Random(3)
    pages = []
    for i in range(600):
        win, slot = r.random() < 0.4, r.random() < 0.4
        pages.append((i, f"https://h{i % 7}.com/{'win' if win else 'news'}/{'slots' if slot else 'today'}/{i}", win and slot))
    odd = [(900, None), (901, "nothing"), (902, "http://"), (903, "x://A.B.NET/?q#f"), (903, "x://A.B.NET/?q#f"), (None, "http://a.org/fr/win/slots")]
    table = spark.createDataFrame([(p, u, "z") for p, u, _ in pages] + [(*o, "z") for o in odd], "page_id long, url string, items string")
    labels = spark.createDataFrame([(p, b) for p, _, b in pages] + [(None, True), (1, None)], "page_id long, bad boolean")
    out = url_filter.judge(table, labels, brute.RULES).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == 606 and all(got[p]["mined"] == b and got[p]["verdict"] == ("block" if b else "allow") for p, _, b in pages)
    assert got[903]["rule"] == "net/" and got[903]["host"] == "a.b.net" and got[None]["verdict"] == "allow" and got[900]["host"] == ""
    none = url_filter.judge(table, labels.where("false"), brute.RULES)
    assert none.where("mined").count() == 0 and url_filter.judge(table.where("false"), labels, brute.RULES).count() == 0


def test_rules_of_urls_with_many_tokens(spark):
    """A bad combination is found though many tokens of the same URLs go more often with bad labels than its own; of tokens that always occur together any one will do."""
    long = "/".join(f"t{i}" for i in range(14))
    kinds = [(60, f"{long}/win/slots", True), (28, f"{long}/win", False), (28, f"{long}/slots", False), (150, "win", False), (150, "slots", False)]
    kinds += [(30, "big/deal/now", True), (30, "big/deal", False), (30, "now", False)]
    pages = [(f"https://h{i % 7}.com/{path}/x{i}", bad) for path, bad, i in ((p, b, i) for n, p, b in kinds for i in range(n))]
    pages = [(i, u, b) for i, (u, b) in enumerate(pages)]
    new = [(1000, "http://a.org/now/big", True), (1001, "http://a.org/deal/now", True), (1002, "http://a.org/big/deal", False), (1003, "http://a.org/slots/win", True), (1004, "http://a.com/t1/win", False)]
    table = spark.createDataFrame([(i, u) for i, u, _ in pages + new], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in pages], "page_id long, bad boolean")
    got = {r["page_id"]: r["mined"] for r in url_filter.judge(table, labels, []).collect()}
    assert got == {i: b for i, _, b in pages + new}
    baskets = spark.createDataFrame([(u.split("://")[1].split("/"), b) for _, u, b in pages], "items array<string>, bad boolean")
    rules = {tuple(r["items"]): (r["n"], r["confidence"], round(r["support"] * len(pages))) for r in url_filter.mine(baskets).collect()}
    assert rules == {("slots", "win"): (2, 1.0, 60), ("big#deal", "now"): (2, 1.0, 30)}


def test_toxicity_on_held_out(spark):
    """Held-out rows of a table with a planted sign are told apart; odd rows have scores."""
    made = [(i, words(i, 60) + (" you vile scum " if i % 4 == 0 else " good day ") + words(1000 + i, 20), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(900, None), (901, ""), (None, "x"), (5, made[5][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.classify(docs, labels).collect()
    truth = {i: y for i, _, y in made}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(out) == 404 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    flat = toxicity.classify(docs, labels.where("false")).select("score", "predicted").distinct().collect()
    assert len(flat) == 1 and flat[0]["predicted"] == 0
    for known in ("false", "toxic = 1", "toxic = 0"):
        assert toxicity.keep_clean(docs, labels.where(known)).count() == docs.count()
    assert toxicity.keep_clean(docs.where("false"), labels).count() == 0
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_toxicity_of_the_tables(spark):
    """The query tells held-out rows of the shared tables apart; its scores are those of a plain loop over the model."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r["doc_id"]: r for r in queries.op7_toxicity(spark, sf).collect()}
    assert len(out) == docs.count() and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    held = [(out[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["toxic"] is not None and out[r["doc_id"]]["held_out"]]
    for y in (0, 1):
        of = [r["predicted"] == y for r, toxic in held if toxic == y]
        assert sum(of) >= 0.9 * len(of)
    weight, bias = toxicity.train(docs, labels)
    for r in docs.limit(20).collect():
        text = f" {r['text'] or ''} ".lower()
        grams = [text[i : i + n] for n in toxicity.GRAMS for i in range(len(text) - n + 1)]
        total = sum(float(weight[brute.gram_number(g, toxicity._MULT.tolist(), toxicity.BITS)]) for g in grams)
        assert abs(1 / (1 + math.exp(-(total * toxicity.rate(len(grams)) + bias))) - out[r["doc_id"]]["score"]) < 1e-5


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No labels, null, empty and repeated rows and clashing names: every stage keeps what it should; no documents give no pieces."""
    base = words(1, 300)
    rows = [(1, base), (1, base), (2, None), (3, ""), (None, base + " x"), (4, words(2, 40)), (5, words(3, 20_000))]
    schema = "doc_id long, text string, lang string, source string, n_chars int, _y int, _gone int, spans int, row int"
    docs = spark.createDataFrame([(d, t, "en", None, 1, 1, 2, 3, 4) for d, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, (7, 7, 7), strict=False):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() == want, name
    assert corpus_pipeline.run(spark, str(tmp_path)).where("length <= 0").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_hamming(spark):
    for source in (spark.read.parquet(f"{SF}/embeddings.parquet"),):
        given = [(r["vec_id"], list(r["embedding"])) for r in source.collect()]
        want = sorted(brute.hamming(given, [v for v, _ in given if v % 100 == 0], 10))
        assert sorted(tuple(r) for r in queries.op10_hamming(spark, SF).collect()) == want
    r = random.Random(2)
    same = [r.choice([-1.0, 1.0]) for _ in range(64)]
    rows = [(i, same if i < 30 else [r.choice([-1.0, 1.0]) for _ in range(64)], "x") for i in range(60)]
    odd = spark.createDataFrame([*rows, (70, None, "x"), (None, same, "x"), (71, [], "x")], "vec_id long, embedding array<double>, code string")
    got = sorted(tuple(x) for x in hamming_search.search(odd, odd.where("vec_id in (0, 29, 40)"), 5).collect())
    assert got == sorted(brute.hamming([x[:2] for x in rows], [0, 29, 40], 5))
    assert hamming_search.search(odd.where("false"), odd, 5).count() == 0


def test_pipeline(spark):
    """Stages one by one against plain versions; what is kept keeps its columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    clean = corpus_pipeline.without_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    one = corpus_pipeline.one_of_each(spark, docs, SF)
    assert one.columns == docs.columns and {d for d, _ in given(one)} == {d for d, _, _, kept in brute.near(given(docs)) if kept}
    cut = corpus_pipeline.without_repeats(spark, docs, SF)
    want = {d: n - gone for d, n, gone, _, _ in brute.repeats(given(docs), corpus_pipeline.PASSAGE)}
    assert cut.columns == docs.columns and all(want[d] - 8 <= len((t or "").encode()) <= want[d] for d, t in given(cut))
    packed = corpus_pipeline.run(spark, SF)
    assert packed.where(F.col("length") <= 0).count() == 0 and packed.select("doc_id").distinct().count() <= one.count()
