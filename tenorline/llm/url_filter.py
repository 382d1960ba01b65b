"""URL filter by association rules: FP-growth mines combinations of URL tokens that go with a bad label; pruned rules match by inverted index.

A URL's tokens are the labels of its host, the words of its path and its query's parts. Each labelled URL is a basket of
tokens, with one more item if its label is bad. FP-growth finds the frequent item sets; rules "tokens -> bad" with enough support
and confidence are kept, unless a rule on fewer of the same tokens is kept already. A rule is found by its tokens: an
index from token to rules is joined with the tokens of distinct URLs, and a rule holds where all its tokens are met.

All tokens are mined. What can't change the rules leaves beforehand: tokens with too few bad URLs for any rule, tokens that are a rule
alone (rules on more tokens would be pruned), tokens that all labelled URLs have; tokens of the very same URLs are one item.

Fixed rules (host, path) come first: a rule fits its host and all subdomains, if the URL's path starts with the rule's; of several
the longest wins. All of it is DataFrame code.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Least share of labelled URLs that a rule covers, and least share of bad ones among those.
SUPPORT, CONFIDENCE = 0.002, 0.7
#: Least number of labelled URLs that a rule covers, so that a few can't make one by chance.
LEAST = 20
_BAD = "=bad"
#: Joins tokens into one item; no token has it.
_OR = "#"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: str) -> tuple[Column, Column, Column]:
    """host, path and the rest of a URL column; all empty for null or without "://"."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path, F.substring(after, F.length(path) + 1, F.length(after))


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """The distinct tokens of a URL."""
    words = lambda mark, column, at: F.transform(F.filter(F.split(column, at), lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.lower(x)))
    return F.array_distinct(F.concat(words("h:", host, "[.]"), words("p:", path, "[^\\p{L}\\p{N}]+"), words("q:", rest, "[?#&;]")))


def fixed(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits the columns host and path, as a struct (rule, verdict); null if none does. rules: a short list of the caller's."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for h, p, _ in ordered]
    made = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered]
    return reduce(lambda so_far, x: so_far.when(*x), zip(fits[1:], made[1:], strict=True), F.when(fits[0], made[0])) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def mine(baskets: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """items, n (items), support, confidence of the rules for a bad label, from rows (items, bad) of labelled URLs.

    Of a rule's item that is several tokens, joined by _OR, any one will do: the labelled URLs have all of them or none.
    """
    spark = baskets.sparkSession
    none = spark.createDataFrame([], "items array<string>, n int, confidence double, support double")
    baskets = materialize(baskets.select("items", "bad", F.monotonically_increasing_id().alias("_id")), "url-baskets")
    total = baskets.count()
    if not total:
        return none
    least = max(1, ceil(max(support * total, LEAST) - 1e-6))
    single = baskets.select("_id", "bad", F.explode(F.array_distinct("items")).alias("item"))
    # Two sums over the URLs of a token tell which tokens have the very same ones.
    same = [F.sum(F.xxhash64("_id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("_id", F.lit(1))).alias("x")]
    counts = single.groupBy("item").agg(F.count("*").alias("k"), F.sum(F.col("bad").cast("long")).alias("b"), *same).where(F.col("b") >= least)
    counts = materialize(counts.groupBy("k", "b", "s", "x").agg(F.array_sort(F.collect_list("item")).alias("tokens")).select("k", "b", "tokens", F.array_join("tokens", _OR).alias("item")), "url-items")
    alone = counts.where(F.col("b") / F.col("k") >= confidence)
    rules = alone.select(F.array("item").alias("items"), F.lit(1).alias("n"), (F.col("b") / F.col("k")).alias("confidence"), (F.col("b") / total).alias("support"))
    rest = counts.where((F.col("b") / F.col("k") < confidence) & (F.col("k") < total))
    # An item is found by the first of its tokens.
    chosen = single.join(rest.select(F.col("tokens")[0].alias("item"), F.col("item").alias("merged")), "item").groupBy("_id", "bad").agg(F.collect_list("merged").alias("items"))
    items = materialize(chosen.select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))).alias("items")), "url-items")
    # URLs without any of these items aren't baskets, so support is brought back to a share of all labelled URLs.
    mined = items.count()
    if mined:
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / mined, minConfidence=confidence).fit(items)
        found = model.associationRules.where(F.col("consequent") == F.array(F.lit(_BAD)))
        rules = rules.unionByName(found.select(F.array_sort("antecedent").alias("items"), F.size("antecedent").alias("n"), "confidence", (F.col("support") * mined / total).alias("support")))
    rules = materialize(rules, "url-rules")
    # A rule goes if another one's tokens are all among its own: found by index again, not by comparing all pairs.
    single = rules.select("items", "n", F.explode("items").alias("item"))
    inner = rules.select(F.col("items").alias("less"), F.col("n").alias("m"), F.explode("items").alias("item"))
    covered = single.join(inner, "item").where("m < n").groupBy("items", "less", "m").count().where(F.col("count") == F.col("m")).select("items").distinct()
    return materialize(rules.join(covered, "items", "left_anti"), "url-rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The urls (column url, with items) that some rule matches."""
    index = rules.select(F.col("items").alias("rule_items"), "n", F.explode("items").alias("met")).withColumn("item", F.explode(F.split("met", _OR)))
    met = urls.select("url", F.explode("items").alias("item")).join(index, "item").groupBy("url", "rule_items", "n").agg(F.size(F.collect_set("met")).alias("count"))
    return met.where(F.col("count") == F.col("n")).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether mined rules say block) of each row of pages.

    pages: page_id, url. labels: page_id, bad; null labels don't count, an id with several counts as bad if one is. A null url or
    one without "://" has an empty host and path and no tokens, so only the verdict allow is left. Repeated rows are judged each; without
    labels nothing is mined and all pages that no fixed rule fits are allowed; other columns don't matter.
    """
    host, path, rest = parse("url")
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path, "rest": rest})
    known = labels.where("page_id is not null and bad is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("bad").alias("bad"))
    with_items = parsed.select("page_id", "url", tokens(F.col("host"), F.col("path"), F.col("rest")).alias("items"))
    found = mine(with_items.join(known, "page_id").select("items", "bad"), support, confidence)
    bad = match(with_items.where("url is not null").select("url", "items").distinct(), found).select(F.col("url").alias("_url"), F.lit(True).alias("mined"))
    out = parsed.withColumn("_fixed", fixed(rules)).join(bad, F.col("url") == F.col("_url"), "left")
    mined = F.coalesce("mined", F.lit(False))
    verdict = F.coalesce("_fixed.verdict", F.when(mined, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), verdict.alias("verdict"), mined.alias("mined"))
