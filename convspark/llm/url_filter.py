"""Operator 1: URL filter by fixed rules, then by association rules.

FP-growth mines combinations of URL tokens (host labels, path words, names of parameters) from the labelled pages that are
blocked. Rules "tokens, so block" are pruned by support, by confidence (how many of all labelled pages with the tokens
are blocked), and by each shorter rule that is as confident. Tokens that occur on the same labelled pages are one item:
one stands for any of them, and a set with two is never better than with one. A token of confidence 1 is a rule at once,
and no set with it can be better, so it is not mined. What is left of a URL template is a few items, however long it is.

Rules are matched by an inverted index: each is filed under its rarest item, and a page is compared only with rules filed
under an item it has. The same index counts, over all labelled pages, how often the mined sets occur.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import ascii_lower, replaced, shared_folder, table

#: (verdict, host, start of the path)
HOST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
MIN_CONFIDENCE = 0.5
#: Bad pages that a rule needs at least, however many pages are labelled.
MIN_PAGES = 8
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens, sorted: h: labels of the host, p: words of the path, q: names of parameters."""
    host = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    path = F.transform(F.split(F.lower(path_of(url)), "[^\\p{L}\\p{N}]+"), lambda x: F.concat(F.lit("p:"), x))
    asked = F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    names = F.transform(F.regexp_extract_all(asked, F.lit(r"[?&]([^=&]+)"), 1), lambda x: F.concat(F.lit("q:"), F.lower(x)))
    every = F.concat(host, path, names)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: F.length(x) > 2)))


def _labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, tokens, bad): the labelled pages with a token. A page is bad if a label of it has quality 0 or toxic 1."""
    bad = F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1))
    known = labels.groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))
    seen = pages.select("page_id", tokens_of(F.col("url")).alias("tokens")).join(known, "page_id")
    return seen.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", "bad")


def _items(seen: DataFrame, min_pages: int) -> DataFrame:
    """(token, item, n, bad): tokens of enough bad pages, the item each belongs to, labelled pages with it, bad ones.

    The pages of a token are told apart by their number and two sums of hashes of their rows."""
    each = seen.select("row", "bad", F.explode("tokens").alias("token"))
    total = lambda *parts: F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))
    stats = each.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("bad"), total("row").alias("s"), total("row", F.lit(1)).alias("t")
    )
    stats = stats.filter(F.col("bad") >= min_pages)
    same = stats.groupBy("n", "bad", "s", "t").agg(F.min("token").alias("item"))
    return stats.join(same, ["n", "bad", "s", "t"]).select("token", "item", "n", "bad")


def _filed(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sets (items) with ``filed``: the item of theirs that the fewest labelled pages have."""
    rare = sets.select("items", F.explode("items").alias("item")).join(sizes, "item")
    rare = rare.groupBy("items").agg(F.min(F.struct("n", "item")).alias("rare"))
    return sets.join(rare, "items").select(sets["*"], F.col("rare.item").alias("filed"))


def mine(
    pages: DataFrame, labels: DataFrame, confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES
) -> tuple[DataFrame, DataFrame]:
    """Rules (items, filed, confidence, bad) and members (token, item), from pages whose page_id is the doc_id of a label.

    A page has an item if it has a token of it. A rule needs ``min_pages`` bad pages, at any number of labelled pages. Null
    ids, null urls and urls without tokens teach nothing; without labelled pages there are no rules. Both are read from
    tables in the shared folder.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "rules")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    seen = stored(_labelled(pages, labels), "seen")
    members = stored(_items(seen, min_pages), "members")
    sizes = members.select("item", "n", "bad").distinct()
    singles = sizes.select(F.array("item").alias("items"), "n", "bad")
    # what is always bad is a rule as it is; of the others sets are mined
    open_ = members.filter("bad < n")
    baskets = seen.select("row", "bad", F.explode("tokens").alias("token")).join(open_.select("token", "item"), "token")
    baskets = stored(baskets.groupBy("row", "bad").agg(F.collect_set("item").alias("items")), "baskets")
    blocked = baskets.filter("bad")
    size = blocked.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_pages - 0.5) / max(size, 1)), minConfidence=confidence)
    sets = model.fit(blocked).freqItemsets.filter(F.size("items") > 1)
    sets = _filed(sets.select(F.array_sort("items").alias("items"), F.col("freq").alias("bad")), sizes)
    sets = stored(sets, "sets")
    asked = baskets.select(F.col("items").alias("has"), F.explode("items").alias("filed"))
    counted = asked.join(sets.select("items", "filed"), "filed").filter(F.size(F.array_except("items", "has")) == 0)
    counted = counted.groupBy("items").agg(F.count("*").alias("n"))
    larger = sets.select("items", "bad").join(counted, "items").select("items", "n", "bad")
    found = stored(singles.union(larger).select("items", "bad", (F.col("bad") / F.col("n")).alias("confidence")), "found")

    # every shorter set of a frequent one is frequent, so each rule meets all rules of one item less
    less = found.filter(F.size("items") > 1).select("items", "confidence", F.explode("items").alias("out"))
    less = less.select("items", "confidence", F.array_remove("items", F.col("out")).alias("shorter"))
    other = found.select(F.col("items").alias("shorter"), F.col("confidence").alias("as_good"))
    needless = less.join(other, "shorter").filter(F.col("as_good") >= F.col("confidence")).select("items").distinct()
    kept = found.filter(F.col("confidence") >= confidence).join(needless, "items", "left_anti")
    rules = stored(_filed(kept, sizes).select("items", "filed", "confidence", "bad"), "rules")
    return rules, members.select("token", "item")


def match(urls: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """(url, because, confidence): of each distinct url that a rule fits, the most confident rule; ties go to the
    longer, then the later rule. ``because`` has the last token of each item that the url has."""
    pages = urls.select("url").filter(F.col("url").isNotNull()).distinct()
    tokens = pages.select("url", F.explode(tokens_of(F.col("url"))).alias("token")).join(members, "token")
    has = tokens.groupBy("url", "item").agg(F.max("token").alias("token"))
    has = has.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("has"))
    asked = has.select("url", "has", F.explode(F.map_keys("has")).alias("filed"))
    near = asked.join(rules, "filed").filter(F.size(F.array_except("items", F.map_keys("has"))) == 0)
    why = F.array_sort(F.transform("items", lambda i: F.element_at("has", i)))
    best = F.max(F.struct("confidence", F.size("items").alias("n"), why.alias("tokens"))).alias("best")
    found = near.groupBy("url").agg(best)
    return found.select("url", F.col("best.tokens").alias("because"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, host_rules: list[tuple[str, str, str]] = HOST_RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, because and confidence; input columns of these names go.

    The longest fixed rule that fits decides; of equally long ones the first by name. Otherwise a page that an association
    rule fits is blocked (``because`` has its tokens), any other is allowed. A null url, or one without ://, has an empty
    host and path, fits no fixed rule and is allowed. Rows are judged alone; repeated rows and ids stay.
    """
    seen = replaced(pages, host=host_of(F.col("url")), path=path_of(F.col("url"))).drop("rule", "verdict", "because", "confidence")
    kept = seen.columns
    rule = verdict = F.lit(None).cast("string")
    ordered = sorted(host_rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    for what, host, start in reversed(ordered):
        fits = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits = fits & F.startswith(F.col("path"), F.lit(start))
        rule = F.when(fits, F.lit(host + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    mined = match(pages, *mine(pages, labels))
    out = seen.withColumns({"rule": rule, "_llm_fixed": verdict}).join(mined, "url", "left")
    learned = F.when(F.col("because").isNotNull(), "block").otherwise("allow")
    out = out.withColumn("verdict", F.coalesce("_llm_fixed", learned))
    return out.select(*kept, "rule", "verdict", "because", "confidence")


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("because", " ").alias("because"), "confidence")


def _fixed_sql(value) -> str:
    """CASE over the fixed rules, longest first."""
    arms = ""
    for what, host, start in sorted(HOST_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{start}')"
        arms += f" WHEN {fits} THEN '{value(what, host + start)}'"
    return f"CASE{arms} END"


#: Itemsets by listing the subsets of each labelled page's tokens: for small tables.
_SQL = f"""
WITH parts AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path, coalesce(regexp_extract(url, '{_PARTS}', 3), '') AS asked FROM pages
), t AS (
  SELECT page_id, url, host, path, list_sort(list_distinct(list_filter(list_concat(list_concat(
    list_transform(string_split(host, '.'), lambda x: 'h:' || x),
    list_transform(string_split_regex(lower(path), '[^\\p{{L}}\\p{{N}}]+'), lambda x: 'p:' || x)),
    list_transform(regexp_extract_all(asked, '[?&]([^=&]+)', 1), lambda x: 'q:' || lower(x))), lambda x: length(x) > 2))) AS tokens FROM parts
), known AS (
  SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels GROUP BY doc_id
), seen AS (
  SELECT t.tokens, k.bad FROM t JOIN known k ON k.doc_id = t.page_id WHERE len(t.tokens) > 0
), subsets AS (
  SELECT list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s, bad
  FROM (SELECT tokens, bad, unnest(range(1, 1::BIGINT << len(tokens))) AS m FROM seen)
), rules AS (
  SELECT s, count(*) FILTER (bad) / count(*) AS confidence, count(*) FILTER (bad) AS both_n FROM subsets GROUP BY s
  HAVING count(*) FILTER (bad) >= {MIN_PAGES}
), kept AS (
  SELECT * FROM rules r WHERE confidence >= {MIN_CONFIDENCE} AND NOT EXISTS (SELECT 1 FROM rules q
    WHERE len(q.s) = len(r.s) - 1 AND list_has_all(r.s, q.s) AND q.confidence >= r.confidence)
), found AS (
  SELECT url, max({{'c': confidence, 'n': len(s), 's': s}}) AS best FROM (SELECT DISTINCT url, tokens FROM t WHERE url IS NOT NULL) u
  JOIN kept ON list_has_all(u.tokens, kept.s) GROUP BY url
)
SELECT page_id, host, path, {_fixed_sql(lambda what, rule: rule)} AS rule,
  coalesce({_fixed_sql(lambda what, rule: what)}, CASE WHEN best IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  array_to_string(best.s, ' ') AS because, best.c AS confidence
FROM t LEFT JOIN found USING (url)
"""

QUERIES = {"op1_url_filter": query}
ORACLE = {"op1_url_filter": _SQL}
