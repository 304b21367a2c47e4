"""URL filters: host and path rules first, association rules mined by FP-growth for the rest. DataFrame functions only.

URLs of labelled documents are baskets of tokens (words of host labels and of the path, extension, query names) with one
item more where the document is bad. FP-growth gives the token sets that enough bad URLs have; they are kept as rules if they
are min_lift times as confident as the share of bad URLs among all labelled ones, and if no part of them is as confident. Rules
are indexed by their rarest token, which a URL must contain; what the index finds is checked in full. The index is a map inside each row's expression, so no page is shuffled; beyond INDEX_RULES
rules it is a table that distinct URLs are joined with.

Defined results: a null URL or one without ``://`` has an empty host and path, meets no rule and is allowed; repeated
rows get equal results, null ids too; a URL of any length takes part with all its tokens; without labels nothing is mined
and what no rule meets is allowed; an empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, passing, table


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, the start of the path, and what follows from both."""

    host: str
    path: str
    verdict: str


#: The site list.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


@dataclass(frozen=True)
class MiningParams:
    """Support counts as a share of the labelled URLs, confidence against the share of bad ones; a rule needs all limits."""

    min_support: float = 0.002
    min_lift: float = 2.0
    min_urls: int = 20


BAD = "label:bad"
#: Rules up to which the index is a map in the rows' expression; a look-up passes over its keys.
INDEX_RULES = 512


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/``, ``?``, ``#`` or the end, lower-cased; the path up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of size, rule and verdict; null if none does. The list is a literal: its size is known."""
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.host) + len(r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All distinct tokens of a URL that can recur; numbers in paths stand for themselves only and are left out."""
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}_]+", -1), lambda w: (w != "") & ~w.rlike(r"^[0-9]+$"))
    names = F.regexp_extract_all(F.split_part(F.coalesce(url, F.lit("")), F.lit("#"), F.lit(1)), F.lit(r"[?&]([^=&#?]+)"), 1)
    parts = F.filter(F.split(host, r"[.-]", -1), lambda w: w != "")
    return F.array_distinct(
        F.concat(F.transform(parts, lambda w: F.concat(F.lit("h:"), w)), F.transform(words, lambda w: F.concat(F.lit("p:"), w)), F.transform(names, lambda w: F.concat(F.lit("q:"), w)))
    )


def document_number(path: Column) -> Column:
    """The id of the document that a page shows: the number that ends the path's second part."""
    return F.regexp_extract(path, r"^/[^/]+/([0-9]{1,18})(?:[./]|$)", 1).try_cast("bigint")


def baskets(pages: DataFrame, labels: DataFrame, params: MiningParams) -> DataFrame:
    """items of every labelled URL."""
    bad = F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int"))
    marks = labels.groupBy(F.col("doc_id").alias("__doc")).agg(bad.alias("bad"))
    host, path = host_and_path(F.col("url"))
    numbered = pages.select(document_number(path).alias("__n"), tokens(F.col("url"), host, path).alias("items")).filter("__n IS NOT NULL")
    joined = numbered.join(marks, F.col("__n") == F.col("__doc"))
    return joined.select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))


def mined(items: DataFrame, params: MiningParams = MiningParams()) -> DataFrame:
    """rule_id, tokens, key (the rarest token) and confidence of the rules that survive; ``items`` should be durable.

    FP-growth sees bad URLs only, and of their tokens those that enough bad URLs have, without two kinds that would make the
    number of combinations explode and add nothing: a token that only bad URLs have is a rule that no longer one can better, and
    of tokens that always stand together one stands for all, since a second one changes no count. The others' rules follow by
    putting each of them in its place.
    """
    spark = items.sparkSession
    none = spark.createDataFrame([], "rule_id bigint, tokens array<string>, key string, confidence double")
    is_bad = F.array_contains("items", BAD)
    total, bad = items.agg(F.count(F.lit(1)), F.count_if(is_bad)).first()
    if not bad:
        return none
    need = max(params.min_urls, math.ceil(params.min_support * total - 1e-9))
    # With every other URL bad no rule can be twice as confident: one that is never wrong is asked for then.
    confident = min(1.0, params.min_lift * bad / total)
    urls = durable(items.select(F.monotonically_increasing_id().alias("url_id"), is_bad.alias("bad"), F.filter("items", lambda t: t != BAD).alias("tokens")))
    per = urls.select("url_id", "bad", F.explode("tokens").alias("t")).groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), *[F.sum(F.xxhash64("url_id", F.lit(k)) % (1 << 28)).alias(f"s{k}") for k in (1, 2, 3)]
    )
    per = durable(per.filter(F.col("n_bad") >= need))
    single = per.filter("n_bad = n").select(F.array("t").alias("tokens"), F.lit(1.0).alias("confidence"))
    rest = per.filter("n_bad < n").groupBy("n", "n_bad", "s1", "s2", "s3").agg(F.array_sort(F.collect_list("t")).alias("alike"))
    classes = durable(rest.select(F.element_at("alike", 1).alias("t"), "alike", "n", "n_bad"))
    reduced = urls.select("url_id", "bad", F.explode("tokens").alias("t")).join(classes.select("t"), "t", "left_semi")
    reduced = durable(reduced.groupBy("url_id", "bad").agg(F.collect_list("t").alias("items")))
    if not reduced.filter("bad").take(1):
        sets = none.select("tokens", "confidence")
    else:
        n_baskets = reduced.filter("bad").count()
        found = FPGrowth(itemsCol="items", minSupport=max(0.0, (need - 0.5) / n_baskets)).fit(reduced.filter("bad").select("items")).freqItemsets
        found = durable(found.filter(F.col("freq") >= need).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n_bad")).withColumn("set_id", F.xxhash64("tokens")))
        sets = _not_beaten(_with_confidence(found, reduced, classes))
        members = classes.select(F.col("t").alias("__t"), "alike")
        placed = sets.filter(F.col("confidence") >= confident).select("set_id", "confidence", F.explode("tokens").alias("t")).join(members, F.col("t") == F.col("__t"))
        choices = placed.groupBy("set_id", "confidence").agg(F.collect_list("alike").alias("choices"))
        start = F.array(F.array().cast("array<string>"))
        each = F.aggregate("choices", start, lambda out, more: F.flatten(F.transform(out, lambda o: F.transform(more, lambda m: F.array_append(o, m)))))
        sets = choices.select(F.explode(each).alias("tokens"), "confidence").withColumn("tokens", F.array_sort("tokens"))
    rules = sets.select("tokens", "confidence").unionByName(single).withColumn("rule_id", F.xxhash64("tokens"))
    keyed = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("t")).join(per.select("t", "n"), "t")
    return keyed.groupBy("rule_id").agg(F.min(F.struct("n", "t")).alias("k"), F.first("tokens").alias("tokens"), F.first("confidence").alias("confidence")).select(
        "rule_id", "tokens", F.col("k.t").alias("key"), "confidence"
    )


def _with_confidence(found: DataFrame, urls: DataFrame, tokens_of: DataFrame) -> DataFrame:
    """``found`` (set_id, tokens, n_bad) with confidence: good URLs meet a set by its rarest token."""
    rare = found.select("set_id", "tokens", F.explode("tokens").alias("t")).join(tokens_of.select("t", "n"), "t")
    rare = rare.groupBy("set_id").agg(F.min(F.struct("n", "t")).alias("k"), F.first("tokens").alias("needs")).select("set_id", "needs", F.col("k.t").alias("t"))
    good = urls.filter("NOT bad").select("items", F.explode("items").alias("t"))
    n_good = good.join(rare, "t").filter(F.size(F.array_except("needs", "items")) == 0).groupBy(F.col("set_id").alias("__s")).agg(F.count(F.lit(1)).alias("n_good"))
    met = found.join(n_good, F.col("set_id") == F.col("__s"), "left")
    return met.select("set_id", "tokens", (F.col("n_bad") / (F.col("n_bad") + F.coalesce("n_good", F.lit(0)))).alias("confidence"))


def _not_beaten(sets: DataFrame) -> DataFrame:
    """Sets that are more confident than each of their parts.

    Every part of a frequent set is frequent, so the most confident part is found length by length: it is one of the parts
    with one token less, or the best below those. Parts meet by the hash of their tokens.
    """
    sets = durable(sets.withColumn("size", F.size("tokens")))
    longest = sets.agg(F.max("size")).first()[0] or 0
    below = sets.filter("size = 1").withColumn("best", F.col("confidence"))
    out = sets.filter("size = 1").select("set_id", "tokens", "confidence")
    for size in range(2, longest + 1):
        at = sets.filter(F.col("size") == size)
        parts = F.transform("tokens", lambda t: F.xxhash64(F.array_remove(F.col("tokens"), t)))
        met = at.select("set_id", F.explode(parts).alias("part")).join(below.select(F.col("set_id").alias("part"), "best"), "part")
        best = met.groupBy(F.col("set_id").alias("__s")).agg(F.max("best").alias("part_best"))
        level = durable(at.join(best, F.col("set_id") == F.col("__s")).drop("__s").withColumn("best", F.greatest("confidence", "part_best")))
        out = out.unionByName(level.filter("confidence > part_best").select("set_id", "tokens", "confidence"))
        below = level
    return out


def by_map(at: DataFrame, rules: DataFrame) -> DataFrame:
    """Append n_mined by looking every token up in a map of the rules, which stands in the plan once."""
    entry = F.struct("key", F.collect_list("tokens").over(Window.partitionBy("key")).alias("rules")).alias("e")
    index = rules.select(entry).distinct().agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    none = F.array().cast("array<array<string>>")
    found = F.flatten(F.transform("__tokens", lambda t: F.coalesce(F.element_at("__index", t), none)))
    whole = F.filter(found, lambda r: F.size(F.array_except(r, F.col("__tokens"))) == 0)
    return at.withColumn("__index", index.scalar()).withColumn("n_mined", F.size(whole).cast("bigint")).drop("__index")


def by_join(at: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with the index as a table: distinct URLs meet it, and come back to their pages."""
    index = rules.select("rule_id", F.col("tokens").alias("__needs"), "key")
    met = (
        at.select("url", "__tokens")
        .dropDuplicates(["url"])
        .withColumn("key", F.explode("__tokens"))
        .join(index, "key")
        .filter(F.size(F.array_except("__needs", "__tokens")) == 0)
        .groupBy(F.col("url").alias("__url"))
        .agg(F.count_distinct("rule_id").alias("n_mined"))
    )
    return at.join(met, F.col("url") == F.col("__url"), "left").withColumn("n_mined", F.coalesce("n_mined", F.lit(0))).drop("__url")


def judged(pages: DataFrame, rules: DataFrame, listed: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, n_mined and verdict of every row of page_id and url; ``rules`` should be durable."""
    host, path = host_and_path(F.col("url"))
    at = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    at = at.withColumn("__hit", matched_rule(F.col("host"), F.col("path"), listed)).withColumn("__tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    n = rules.count()
    out = at.withColumn("n_mined", F.lit(0).cast("bigint")) if not n else by_map(at, rules) if n <= INDEX_RULES else by_join(at, rules)
    verdict = F.coalesce(F.col("__hit.verdict"), F.when(F.col("n_mined") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("__hit.rule").alias("rule"), F.when(F.col("__hit").isNull(), F.col("n_mined")).otherwise(F.lit(0)).alias("n_mined"), verdict.alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    with passing(spark) as last:
        pages = table(spark, sf_dir, "pages").select("page_id", "url")
        rules = durable(mined(durable(baskets(pages, table(spark, sf_dir, "labels"), MiningParams()))))
        return last(judged(pages, rules))


def _oracle() -> str:
    """The same rules by counting every subset of every basket."""
    listed = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    p = MiningParams()
    return rf"""
WITH a AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
l AS (SELECT * FROM (VALUES {listed}) v(r_host, r_path, r_verdict)),
m AS (SELECT rid, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS r_verdict FROM h JOIN l ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY rid),
t AS (SELECT rid, page_id, host, path, list_distinct(list_transform(list_filter(string_split_regex(host, '[.-]'), lambda x: x <> ''), lambda x: 'h:' || x)
        || list_transform(list_filter(string_split_regex(lower(path), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$')), lambda x: 'p:' || x)
        || list_transform(regexp_extract_all(split_part(coalesce(url, ''), '#', 1), '[?&]([^=&#?]+)', 1), lambda x: 'q:' || x)) AS tok,
        TRY_CAST(nullif(regexp_extract(path, '^/[^/]+/([0-9]{{1,18}})(?:[./]|$)', 1), '') AS BIGINT) AS n FROM h),
k AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
b AS (SELECT tok, bad FROM t JOIN k ON n = doc_id),
e AS (SELECT bad, list_sort(list_filter(tok, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS s FROM (SELECT tok, bad, unnest(generate_series(1, CAST(pow(2, len(tok)) AS BIGINT) - 1)) AS mask FROM b)),
c AS (SELECT s, sum(bad) AS bad, sum(bad) / count(*) AS conf FROM e GROUP BY s HAVING sum(bad) / count(*) >= least(1, {p.min_lift} * (SELECT avg(bad) FROM b)) AND sum(bad) >= {p.min_urls} AND sum(bad) >= {p.min_support} * (SELECT count(*) FROM b)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE len(o.s) < len(c.s) AND list_has_all(c.s, o.s) AND o.conf >= c.conf)),
x AS (SELECT rid, count(*) AS n_mined FROM t JOIN r ON list_has_all(t.tok, r.s) GROUP BY rid)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN coalesce(n_mined, 0) ELSE 0 END AS n_mined, coalesce(r_verdict, CASE WHEN n_mined > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM t LEFT JOIN m USING (rid) LEFT JOIN x USING (rid)
"""


SQL_OP9 = _oracle()
