"""Plain versions of the operators over small tables, in one process: what the tests hold the Spark versions against."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encoding() -> tiktoken.Encoding:
    with open(BYTE_BPE, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("brute", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe(docs: list[tuple]) -> list[tuple]:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of (doc_id, text)."""
    enc, out = encoding(), []
    for doc_id, text in docs:
        ids = enc.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((text or "").encode())))
    return out


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_rule(url: str | None) -> tuple[str, str, str | None, str | None]:
    """host, path, rule and its verdict."""
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def mined_urls(pages: list[tuple], bad: dict, least: int, confidence: float) -> set:
    """The page ids of pages (id, url) that a rule blocks: up to three tokens, so many bad pages of all that have them."""

    def tokens(url: str | None) -> frozenset:
        host, path, _, _ = url_rule(url)
        rest = (url or "").partition("://")[2][len(host) + len(path) :]
        return frozenset(["h:" + x for x in host.split(".") if x] + ["p:" + x.lower() for x in re.findall(r"[^\W_]+", path)] + ["q:" + x.lower() for x in re.split("[?#&;]", rest) if x])

    baskets = {p: tokens(u) for p, u in pages}
    counts: dict[frozenset, list[int]] = {}
    for p, items in baskets.items():
        for n in (1, 2, 3):
            for c in itertools.combinations(sorted(items), n):
                k = counts.setdefault(frozenset(c), [0, 0])
                k[0] += 1
                k[1] += bad[p]
    rules = [c for c, (k, b) in counts.items() if b >= least and b >= confidence * k]
    return {p for p, items in baskets.items() if any(r <= items for r in rules)}


def shingles(text: str | None) -> set[tuple]:
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data.lower())
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near(docs: list[tuple]) -> list[tuple]:
    """doc_id, n_shingles, component_id, kept of (doc_id, text), ids being different."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    seen = set()
    for own in where.values():
        for a, b in combinations(sorted(own), 2):
            if (a, b) not in seen:
                seen.add((a, b))
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


def packed_ids(text: str | None, tokenizer: Tokenizer) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(docs: list[tuple], pieces: list[dict], window: int = 2048) -> None:
    """Whether pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) pack all ids of docs (doc_id, text), ids being different."""
    tokenizer = Tokenizer.from_file(WORD_BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == {d for d, _ in docs}
    for doc_id, text in docs:
        ids, at = packed_ids(text, tokenizer), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], dtype="<u4").tobytes())
        assert at == len(ids)
    sizes = []
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        sizes.append(at)
    total = sum(sizes)
    assert len(sizes) <= -(-total // window) + 1  # little padding


def repeats(docs: list[tuple], length: int = 400) -> list[tuple]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of (doc_id, text)."""
    texts = [(t or "").encode() for _, t in docs]
    count = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            count[hash(t[i : i + length])] += 1
    out = []
    for (doc_id, _), t in zip(docs, texts, strict=True):
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - length + 1):
            if count[hash(t[i : i + length])] > 1:
                gone[i] += 1
                gone[min(i + length, len(t))] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int(np.sum(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))
        out.append((doc_id, len(t), int(mask.sum()), spans, sha(bytes(np.frombuffer(t, dtype=np.uint8)[~mask]))))
    return out


def edited(docs: list[tuple]) -> list[tuple]:
    """doc_id, n_chars, edited_sha256 of (doc_id, text), ids being different."""
    order = sorted(docs, key=lambda d: -d[0])
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        out.append((doc_id, len(text), sha((text[: len(text) - third] + after[:third]).encode())))
    return out


def codes(vectors: list) -> np.ndarray:
    """The sign codes of vectors of 64 dimensions."""
    return np.array(vectors) > 0


def hamming(vectors: list[tuple], queries: list[int], k: int) -> list[tuple]:
    """query_id, rank, vec_id, distance of (vec_id, vector)."""
    ids, bits = [v for v, _ in vectors], codes([x for _, x in vectors])
    at, out = {v: i for i, v in enumerate(ids)}, []
    for q in queries:
        distance = (bits != bits[at[q]]).sum(axis=1)
        best = sorted((int(d), v) for d, v in zip(distance, ids, strict=True) if v != q)[:k]
        out += [(q, r + 1, v, d) for r, (d, v) in enumerate(best)]
    return out


def gram_number(gram: str, mult: list[int], bits: int) -> int:
    """The feature number of one character n-gram."""
    h, mask = ord(gram[0]) * mult[0], 2**32 - 1
    for c in gram[1:]:
        h = ((h & mask) * 0x2C1B3C6D + ord(c)) & mask
    return ((h ^ h >> 16) * mult[len(gram) - 1] & mask) >> (32 - bits)
