"""URL filters: listed rules, and association rules that Spark's FP-growth mines from labelled URLs; DataFrame functions only.

A listed rule fits its host and all subdomains if the url's path starts with the rule's; the longest that fits decides. Else the
mined rules do: FP-growth finds sets of URL tokens (host, its labels, path parts, query names; numbers are one token) that come
with the label block with SUPPORT of all labelled urls and CONFIDENCE, where the lower end of the confidence's 95 % interval (Wilson's)
is a half or more; that takes 4 urls at least. A rule of which a part has the same confidence or more is pruned. Rules may have any number of tokens.

So that urls of many tokens don't have all subsets counted, tokens that stand in the same labelled urls are one item, which a url has if it has one of
them, and tokens that are always blocked are rules of their own but part of no other, as nothing can add to their confidence. Rules are matched by an
inverted index: each under the item that fewest rules have, distinct sets of tokens only. A url that no rule matches is allowed.

Null urls, and such without "://", have empty host and path, no tokens, and are allowed. Urls without label, or with a null one, mine nothing;
without any label no rule is mined. Repeated rows give repeated rows and count as often in mining. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import small, written

#: (verdict, host and path)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Wilson's interval: standard deviations, and the lower end that a rule must reach.
DEVIATIONS, LOWER_END = 1.96, 0.5
#: Rows that share a join key are dealt over so many tasks where a side isn't broadcast.
SALTS = 16
BROADCAST_SETS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label=block"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """array<string> of distinct tokens."""
    name, number = host(url), r"^[0-9]+(\.[a-z]+)?$"
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    part = lambda x: F.when(F.translate(x, UPPER, LOWER).rlike(number), F.concat(F.lit("#"), F.regexp_extract(x, r"(\.[A-Za-z]+)?$", 1))).otherwise(x)
    labels = F.transform(F.split(name, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), part(x)))
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(F.array(F.concat(F.lit("d:"), name)), labels, parts, names))))


def listed(url_host: Column, url_path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    cases = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((url_host == name) | url_host.endswith(f".{name}")) & url_path.startswith(f"/{rest}")
        cases.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*cases, F.lit(None).cast("string"))


def evidence(n: Column, of: Column) -> Column:
    """Lower end of Wilson's interval for n of of."""
    z2 = DEVIATIONS**2
    return (n / of + z2 / (2 * of) - DEVIATIONS * F.sqrt((n / of) * (1 - n / of) / of + z2 / (4 * of * of))) / (1 + z2 / of)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule: array of items, each an array of tokens of which one is enough, confidence, n) from labelled(url, block: boolean)."""
    rows = labelled.where("block is not null").select(tokens(F.col("url")).alias("t"), "block").where(F.size("t") > 0)
    rows = written(rows, "labelled")
    total = rows.count()
    least = max(int(support * total), int(DEVIATIONS**2) + 1)
    # what tells two tokens' urls apart: how many, and two sums over them
    sums = [F.sum(F.xxhash64("t", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    known = rows.select("t", "block", F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("of"), F.count_if("block").alias("n"), *sums)
    items = known.where(F.col("n") >= least).groupBy("of", "n", "s1", "s2").agg(F.array_sort(F.collect_set("token")).alias("names"))
    items = written(items.select(F.col("names")[0].alias("item"), "names", "of", "n"), "items")
    good = lambda df: df.withColumn("confidence", F.col("n") / F.col("of")).where((F.col("confidence") >= confidence) & (evidence(F.col("n"), F.col("of")) >= LOWER_END))
    single = good(items).select(F.array("item").alias("rule"), "confidence", "n")
    open_ = items.where("n < of").select("item")
    # an item stands in a url if its first name does, as all its names do
    pairs = rows.withColumn("id", F.monotonically_increasing_id())
    pairs = written(pairs, "numbered").select("id", "block", F.explode("t").alias("item")).join(F.broadcast(open_) if small(open_, BROADCAST_SETS) else open_, "item")
    baskets = pairs.groupBy("id", "block").agg(F.collect_list("item").alias("t"))
    baskets = written(baskets.select(F.when(F.col("block"), F.concat("t", F.array(F.lit(BLOCK)))).otherwise(F.col("t")).alias("items")), "baskets")
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(1, baskets.count())), minConfidence=confidence).fit(baskets).freqItemsets
    sets = written(sets.select(F.array_contains("items", BLOCK).alias("b"), F.array_sort(F.array_remove("items", BLOCK)).alias("rule"), "freq"), "item-sets")
    longer = sets.where(f"b and size(rule) > 1 and freq >= {least}").select("rule", F.col("freq").alias("n")).join(sets.where("not b").select("rule", F.col("freq").alias("of")), "rule")
    rules = written(single.unionByName(good(longer).select("rule", "confidence", "n")), "all-rules")
    # a part is met under its first item
    parts = rules.select(F.col("rule").alias("part"), F.col("rule")[0].alias("item"), F.col("confidence").alias("p"))
    beaten = rules.select("rule", "confidence", F.explode("rule").alias("item")).join(parts, "item").where((F.size("part") < F.size("rule")) & (F.size(F.array_except("part", "rule")) == 0) & (F.col("p") >= F.col("confidence")))
    kept = rules.join(beaten.select("rule").distinct(), "rule", "left_anti")
    named = kept.select("rule", "confidence", "n", F.posexplode("rule").alias("k", "item")).join(items.select("item", "names"), "item")
    named = named.groupBy("rule", "confidence", "n").agg(F.array_sort(F.collect_list("names")).alias("names"))
    return named.select(F.col("names").alias("rule"), "confidence", "n")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of sets(t) that hold a whole rule, each under the tokens of its rarest item."""
    each = rules.select("rule", F.explode("rule").alias("item"))
    common = each.groupBy("item").agg(F.count("*").alias("rules"))
    index = each.join(common, "item").groupBy("rule").agg(F.min_by("item", F.struct("rules", "item")).alias("item")).select("rule", F.explode("item").alias("token"))
    index = written(index, "index")
    index = F.broadcast(index) if small(index, BROADCAST_SETS) else index
    return sets.select("t", F.explode("t").alias("token")).join(index, "token").where(F.forall("rule", lambda x: F.arrays_overlap(x, "t"))).select("t").distinct()


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages(page_id, url), with labels(page_id, block) to mine from."""
    known = pages.select("page_id", "url").join(labels.where("page_id is not null and block is not null").groupBy("page_id").agg(F.max("block").alias("block")), "page_id")
    mined = written(mine(known, support, confidence), "rules")
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("t"))
    rows = rows.withColumn("rule", listed(F.col("host"), F.col("path"), rules))
    sets = rows.where("rule is null and size(t) > 0").select("t").distinct()
    bad = written(matched(sets, mined), "matched").withColumn("hit", F.lit(True))
    if small(bad, BROADCAST_SETS):
        rows = rows.join(F.broadcast(bad), "t", "left")
    else:
        # many urls may have the same tokens
        bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int")).join(bad, ["t", "salt"], "left")
    verdict = F.coalesce(*(F.when(F.col("rule") == rule, F.lit(v)) for v, rule in rules), F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
