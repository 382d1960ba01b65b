"""Queries over the operators of this folder, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, conversation_repair, exact_dedup, hamming_search, hilbert, iblt, neardup, packing, suffix_dedup, token_counts, toxicity, url_filter
from .common import materialize, read

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by byte-level BPE and decoded again, as digests."""
    ranks = bpe.load_ranks(BYTE_BPE)
    encoded = materialize(bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), "encoded")  # a table that others read, too
    both = bpe.decode(encoded, ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: (host, path, verdict) of fixed rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


#: Language of a page as its own first tag gives it, and the languages that are wanted.
PAGE_LANGUAGE, WANTED = "<html[^>]*[ ]lang=[\"']?([A-Za-z]+)", ("", "en")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages, by fixed rules and else by rules mined from labels: a page is bad if its own html is in a language that isn't wanted, or if the document of its id is labelled as bad."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    shown = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), PAGE_LANGUAGE, 1))
    bad = pages.select("page_id", (~shown.isin(*WANTED)).alias("bad")).unionAll(labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")))
    return url_filter.judge(pages, bad, RULES)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


#: Three edits of each document: a replacement in its first third, a passage copied into the middle, an addition at the end.
EDITS = """array(
    named_struct('at', cast(length(coalesce(text, '')) div 3 as bigint), 'cut', 8L, 'new', 'an edited passage, '),
    named_struct('at', cast(length(coalesce(text, '')) div 2 as bigint), 'cut', 0L, 'new', substring(coalesce(text, ''), 1, 40)),
    named_struct('at', cast(length(coalesce(text, '')) + 100 as bigint), 'cut', 0L, 'new', '\\n The end.'))"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, before and after three edits of each, with the characters encoded again for these."""
    done = token_counts.recount(read(spark, sf_dir, "documents"), EDITS, BYTE_BPE, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "edited_tokens", F.sha2("edited_text", 256).alias("edited_sha256"), "encoded")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture-controlled packing of all documents into sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), WORD_BPE, with_ids=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the bytes of repeated 400-byte strings, as digests and as text."""
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from labels."""
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards along a Hilbert curve, equal in rows."""
    placed = hilbert.shards(read(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return iblt.fingerprints(read(spark, sf_dir, "documents"))


def op10_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors, by binary code, of every vector whose id is divisible by 100."""
    vectors = read(spark, sf_dir, "embeddings")
    return hamming_search.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents; the largest id stays."""
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language over all documents."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, with their faults and the cheapest repair."""
    rows = read(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damaged(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_url_rules": op2_url_rules,
    "op3_minhash": op3_minhash,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_hilbert": op8_hilbert,
    "op9_iblt": op9_iblt,
    "op10_hamming": op10_hamming,
    "op11_exact": op11_exact,
    "op12_collocations": op12_collocations,
    "op13_repair": op13_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op10_hamming": """
        WITH pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
                   CAST(len(list_filter(generate_series(1, 64), lambda i: (q.embedding[i] > 0) <> (v.embedding[i] > 0))) AS INTEGER) AS distance
            FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs
        )
        SELECT * FROM ranked WHERE rank <= 10""",
    "op11_exact": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
            FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)
        ), lists AS (
            SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
        ), single AS (
            SELECT p, lang, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM lists
        ), four AS (
            SELECT lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM single WINDOW o AS (PARTITION BY p ORDER BY i)
        ), grams AS (
            SELECT lang, 1 AS m, a AS phrase FROM four UNION ALL SELECT lang, 2, a || ' ' || b FROM four WHERE b IS NOT NULL
            UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM four WHERE c IS NOT NULL UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM four WHERE d IS NOT NULL
        ), f AS (
            SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
        ), words AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
        ), found AS (
            SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30
        ), cuts AS (
            SELECT x.lang, x.phrase, x.a, k, l.f AS l, r.f AS r, CAST(x.a AS HUGEINT) * 2000000 // (CAST(l.f AS HUGEINT) + r.f) AS score
            FROM found x JOIN generate_series(1, 3) t(k) ON k < x.m JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:k], ' ') AND l.m = k
            JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[k + 1 :], ' ') AND r.m = x.m - k
        ), best AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), kept AS (
            SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM found y WHERE y.lang = b.lang AND contains(' ' || y.phrase || ' ', ' ' || b.phrase || ' ') AND y.phrase <> b.phrase AND 100 * CAST(y.a AS HUGEINT) >= 80 * CAST(b.a AS HUGEINT))
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM kept JOIN words USING (lang) QUALIFY rank <= 2000""",
}
