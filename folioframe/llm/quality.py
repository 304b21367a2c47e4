"""Host-level quality rules, DataFrame functions only.

Row rules are computed inside each row. A host's failure rate is shrunk towards the corpus by a beta prior
whose two parameters are fitted to the hosts by the method of moments. A host is rejected if its rate, less
two standard deviations of its beta posterior, means odds of failure beyond max_host_odds times the corpus's; the
verdict is joined back to the host's documents. Where all hosts fail alike, none is rejected, however high the rate.

Defined results: a null text is an empty text (0 words, so it fails); a null host is a host of its own;
repeated rows are judged and counted once each; texts of any length are read whole; an empty table gives an empty
result; columns of the input stay, and a clashing name is replaced by this operator's column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, durable, let, passing, spread, table, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityParams:
    """Row limits, and the odds of failure, in those of the corpus, beyond which a whole host is rejected."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    max_host_odds: float = 4.0
    deviations: float = 2.0
    max_strength: float = 1e6


def repeat_words(ws: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the text.

    Window hashes are sorted with their positions, so equal windows are neighbours: n log n, no pairs.
    """
    keyed = F.when(
        F.size(ws) >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(1), F.size(ws) - 2),
                lambda i: F.struct(F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)).alias("h"), i.alias("p")),
            )
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))

    def covered(ks: Column) -> Column:
        twice = F.filter(
            ks,
            lambda x, i: ((i > 0) & (F.get(ks, i - 1)["h"] == x["h"])).eqNullSafe(True) | (F.get(ks, i + 1)["h"] == x["h"]).eqNullSafe(True),
        )
        return let(
            F.sort_array(F.transform(twice, lambda x: x["p"])),
            lambda ps: F.aggregate(
                F.transform(ps, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(ps, i + 1) - p, F.lit(3)))),
                F.lit(0).cast("bigint"),
                lambda a, x: a + x,
            ),
        )

    return let(keyed, covered)


def row_rules(df: DataFrame, text: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and rule_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, WORD_GAP, "") != "")
    of_words = let(
        words(t),
        lambda ws: F.struct(F.size(ws).cast("bigint").alias("n"), repeat_words(ws).alias("r")),
    )
    out = df.withColumns(
        {
            "__w": of_words,
            "word_chars": F.char_length(F.regexp_replace(t, WORD_GAP, "")).cast("bigint"),
            "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
            "__l": let(lines, lambda ls: F.struct(F.size(ls).alias("n"), F.size(F.array_distinct(ls)).alias("d"))),
        }
    ).withColumns({"n_words": F.col("__w.n"), "n_repeat_words": F.col("__w.r"), "n_dup_lines": (F.col("__l.n") - F.col("__l.d")).cast("bigint"), "__n_lines": F.col("__l.n")})
    base = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    more = (100 * F.col("n_symbols") > params.max_symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > params.max_dup_line_percent * F.col("__n_lines"))
    return out.withColumns({"base_failed": base, "rule_failed": base | more}).drop("__w", "__l", "__n_lines")


def host_verdicts(judged: DataFrame, host: str = "source", params: QualityParams = QualityParams()) -> DataFrame:
    """host key, documents, failures, host_rate (shrunk) and host_rejected for every host of a frame that has rule_failed.

    The prior needs five sums over hosts, the only values that reach the driver.
    """
    hosts = durable(
        judged.groupBy(host_key(F.col(host)).alias("host_key")).agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("rule_failed").alias("host_failed"))
    )
    n, f = F.col("host_docs"), F.col("host_failed")
    s = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count(F.lit(1)).alias("k"), F.sum(f / n).alias("r"), F.sum((f / n) * (f / n)).alias("rr"), F.sum(1 / n).alias("inv")).first()
    a, b = beta_prior(s["n"], s["f"], s["k"], s["r"], s["rr"], s["inv"], params.max_strength)
    corpus = a / (a + b)
    limit = params.max_host_odds * corpus / (1 - corpus + params.max_host_odds * corpus)
    rate = (f + F.lit(a)) / (n + F.lit(a + b))
    least = rate - params.deviations * F.sqrt(rate * (1 - rate) / (n + F.lit(a + b + 1)))
    return hosts.withColumns({"host_rate": F.round(rate, 6), "host_rejected": least > limit})


def beta_prior(n, f, k, r, rr, inv, max_strength: float) -> tuple[float, float]:
    """Moments: the spread of host rates beyond what binomial noise explains gives the prior's strength."""
    if not n:
        return 1.0, 1.0
    m = min(max(f / n, 1e-6), 1 - 1e-6)
    spread = rr / k - 2 * m * r / k + m * m
    between = max(spread - m * (1 - m) * inv / k, 1e-12)
    strength = min(max(m * (1 - m) / between - 1, 1.0), max_strength)
    return m * strength, (1 - m) * strength


def host_key(host: Column) -> Column:
    """A key that is never null and keeps the null host apart from every string."""
    return F.coalesce(F.concat(F.lit("s:"), host.cast("string")), F.lit("n"))


def with_verdicts(judged: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Join the verdicts of hosts to their rows and append host_rate, host_rejected and kept."""
    keyed = judged.drop("host_rate", "host_rejected", "kept").withColumn("__host", host_key(F.col(host)))
    v = verdicts.select(F.col("host_key").alias("__vhost"), "host_rate", "host_rejected")
    joined = keyed.join(v, F.col("__host") == F.col("__vhost"), "left").drop("__host", "__vhost")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def op5_host_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict."""
    with passing(spark) as last:
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
        judged = durable(row_rules(docs).drop("text"))
        return last(with_verdicts(judged, host_verdicts(judged)).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "host_rejected", "kept"
        ))


SQL_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce('s:' || source, 'n') AS host FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls FROM d),
g AS (SELECT rid, p, ws[p] || ' ' || ws[p+1] || ' ' || ws[p+2] AS k FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS p FROM w WHERE len(ws) >= 3)),
t AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, CAST(sum(least(3, coalesce(nxt - p, 3))) AS BIGINT) AS n FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM t) GROUP BY rid),
j AS (SELECT d.rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, coalesce(n, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS rule_failed FROM j),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE rule_failed) AS f FROM b GROUP BY host),
s AS (SELECT least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS m, sum(f / n) / count(*) AS r, sum((f / n) * (f / n)) / count(*) AS rr, sum(1 / n) / count(*) AS inv FROM h),
q AS (SELECT m, least(greatest(m * (1 - m) / greatest(rr - 2 * m * r + m * m - m * (1 - m) * inv, 1e-12) - 1, 1.0), 1e6) AS strength FROM s),
y AS (SELECT host, n, (f + m * strength) / (n + strength) AS rate, strength, m FROM h, q),
v AS (SELECT host, round(rate, 6) AS host_rate, rate - 2 * sqrt(rate * (1 - rate) / (n + strength + 1)) > 4 * m / (1 - m + 4 * m) AS host_rejected FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, host_rejected, NOT base_failed AND NOT host_rejected AS kept
FROM b JOIN v USING (host)
"""
