"""Translation: dictionary, cache and replies joined to items, and the texts that are left sent out in batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions.dictionary import Replacer
from ..functions.fitting import Metrics, TableMetrics
from ..params import DEFAULT
from ..session import stored

#: Rows and bytes of a term list or cache up to which it is handed to every executor; larger ones are joined by hash.
SMALL_ROWS = 50_000
SMALL_BYTES = 16 << 20


def distinct_terms(terms: DataFrame) -> DataFrame:
    """One row per cn: the last wording in the file, the first place."""
    return terms.groupBy("cn").agg(F.min("ord").alias("ord"), F.max_by("en", "ord").alias("en"))


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table if its rows and bytes, counted, are few; else leave the choice of join to Spark."""
    octets = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    n, size = df.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(octets[1:], octets[0])), F.lit(0))).first()
    return F.broadcast(df) if n <= SMALL_ROWS and size <= SMALL_BYTES else df


def with_terms(items: DataFrame, terms: DataFrame, keep: str = "absent") -> DataFrame:
    """Append translated by exact text. What an item without a term gets: ``absent`` null, ``set`` its text, ``existing`` the value it had."""
    d = small(distinct_terms(terms).select(F.col("cn").alias("__cn"), F.col("en").alias("__en")))
    had = F.col("translated") if "translated" in items.columns else F.lit(None).cast("string")
    other = {"absent": had, "set": F.col("text"), "existing": F.coalesce(had, F.col("text"))}[keep]
    return items.join(d, F.col("text") == F.col("__cn"), "left").withColumn("translated", F.coalesce("__en", other)).drop("__cn", "__en")


def replace_terms(items: DataFrame, terms: DataFrame) -> DataFrame:
    """Append translated: every term replaced in the text, longest first and in file order; what a replacement makes can be matched again.

    A dictionary goes to the workers as one automaton, a very large one as several that follow each other: a list cut into
    stretches gives what the whole list gives, and a worker holds one stretch. Terms without a wording are left out.
    """
    out = items.withColumn("translated", F.col("text"))
    for stretch in _stretches(terms):
        out = out.withColumn("translated", _replacing(stretch)(F.col("translated")))
    return out


def _stretches(terms: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The terms in order, at most SMALL_ROWS terms and SMALL_BYTES characters at a time."""
    ready = distinct_terms(terms).filter("cn <> '' AND en IS NOT NULL").orderBy(F.desc(F.char_length("cn")), "ord", "cn")
    held, size = [], 0
    for r in ready.select("cn", "en").toLocalIterator(prefetchPartitions=True):
        if len(held) >= SMALL_ROWS or (held and size > SMALL_BYTES):
            yield held
            held, size = [], 0
        held.append((r.cn, r.en))
        size += len(r.cn) + len(r.en)
    if held:
        yield held


_replacers: dict[str, Replacer] = {}


def _replacer(name: str, terms: list[tuple[str, str]]) -> Replacer:
    """The automaton of a list, built once a worker; only the last few lists' stay."""
    if name not in _replacers:
        if len(_replacers) >= 4:
            _replacers.clear()
        _replacers[name] = Replacer(terms)
    return _replacers[name]


def _replacing(terms: list[tuple[str, str]]):
    name = uuid.uuid4().hex

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        replaced = _replacer(name, terms)
        for series in texts:
            yield series.map(replaced, na_action="ignore")

    return run


def is_translated() -> Column:
    """An absent translation and one equal to the text both count as untranslated."""
    return F.coalesce("translated", "text") != F.col("text")


def cache_cascade(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the cache's translation where the dictionary left the text unchanged, and the distinct texts still open."""
    c = cache.select(F.col("text").alias("__t"), F.col("translated").alias("__v"))
    pending = ~is_translated()
    out = items.join(c, F.col("text") == F.col("__t"), "left").withColumn("hit", pending & F.col("__t").isNotNull())
    out = out.withColumn("translated", F.when(F.col("hit"), F.col("__v")).otherwise(F.col("translated")))
    left = out.filter(~F.col("hit") & pending).select("text").distinct()
    return out.drop("__t", "__v"), left


def batches(texts: DataFrame, order: list[str], size: int = DEFAULT.batch_size, within: str | None = None) -> DataFrame:
    """Append batch_no and id (both from 1) in order, nulls first; ``within`` numbers each key's rows for themselves.

    Rows are dealt by ranges of the order and stored with the number of their range; ranges are numbered by their rows, and rows
    inside a range. No task gets all texts, and rows that agree in the order are dealt to several ranges.
    """
    if within:
        out = texts.withColumn("id", F.row_number().over(Window.partitionBy(within).orderBy(*order)))
    else:
        ranges = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = texts.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "__at")
        kept = stored(dealt.withColumn("__range", F.spark_partition_id()))
        counts = kept.groupBy("__range").agg(F.count(F.lit(1)).alias("__c"))
        before = F.coalesce(F.sum("__c").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select(F.col("__range").alias("__r"), before.alias("__before"))  # a row a range
        inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order, "__at"))
        met = kept.withColumn("__n", inside).join(F.broadcast(starts), F.col("__range") == F.col("__r"))
        out = met.withColumn("id", (F.col("__before") + F.col("__n")).cast("int")).drop("__at", "__range", "__r", "__before", "__n")
    return out.withColumn("batch_no", F.expr(f"(id - 1) DIV {size}") + 1)


def requests(sent: DataFrame, tagged: bool = True) -> DataFrame:
    """batch_no and body: the texts of each batch as tagged blocks, or as numbered lines with vertical ones marked. A batch's size bounds its body."""
    if tagged:
        one = F.concat(F.lit("[ITEM_START]\nID: "), F.col("id").cast("string"), F.lit("\nSRC: "), F.col("text"), F.lit("\n[ITEM_END]"))
    else:
        mark = F.when(F.col("is_vertical"), F.lit(" [vertical]")).otherwise(F.lit("")) if "is_vertical" in sent.columns else F.lit("")
        one = F.concat(F.col("id").cast("string"), F.lit('. "'), F.col("text"), F.lit('"'), mark)
    g = sent.groupBy("batch_no").agg(F.array_sort(F.collect_list(F.struct("id", one.alias("line")))).alias("r"))
    return g.select("batch_no", F.array_join("r.line", "\n").alias("body"))


def tagged_replies(replies: DataFrame, fallback_source: bool = False) -> DataFrame:
    """batch_no, id and trn of every tagged block; a block without TRN gives null, or its SRC where that is asked for; of repeated ids the last counts."""
    block = F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)\[ITEM_START\](.*?)\[ITEM_END\]"), 1)).alias("pos", "block")
    rows = replies.select("batch_no", block)
    number = F.regexp_extract("block", r"ID:\s*(\d+)", 1)
    trn = F.nullif(F.regexp_extract("block", r"(?s)TRN:\s*(.*?)\s*\z", 1), F.lit(""))
    src = F.nullif(F.regexp_extract("block", r"(?s)SRC:\s*(.*?)\s*(?:TRN:|\z)", 1), F.lit(""))
    rows = rows.select("batch_no", "pos", number.alias("id"), (F.coalesce(trn, src) if fallback_source else trn).alias("trn")).filter("id <> ''")
    return rows.groupBy("batch_no", F.col("id").cast("int").alias("id")).agg(F.max_by("trn", "pos").alias("trn"))


def numbered_replies(replies: DataFrame) -> DataFrame:
    """batch_no, id and trn of every line ``1. text`` (also with other points), quotes off both ends."""
    line = F.posexplode(F.split("body", "\n", -1)).alias("pos", "line")
    rows = replies.select("batch_no", line)
    pattern = r"^\s*(\d+)[.、．]\s*[\"“']?(.*?)[\"”']?\s*$"
    rows = rows.filter(F.col("line").rlike(pattern)).select("batch_no", "pos", F.regexp_extract("line", pattern, 1).cast("int").alias("id"), F.regexp_extract("line", pattern, 2).alias("trn"))
    return rows.groupBy("batch_no", "id").agg(F.max_by("trn", "pos").alias("trn"))


def parse_rates(sent: DataFrame, got: DataFrame) -> DataFrame:
    """batch_no, sent, matched and loose: whether fewer than half of a batch's ids came back."""
    a = sent.join(got.select(F.col("batch_no").alias("__b"), F.col("id").alias("__i"), "trn"), (F.col("batch_no") == F.col("__b")) & (F.col("id") == F.col("__i")), "left")
    out = a.groupBy("batch_no").agg(F.count(F.lit(1)).alias("sent"), F.count("trn").alias("matched"))
    return out.withColumn("loose", 2 * F.col("matched") < F.col("sent"))


def loose_replies(replies: DataFrame) -> DataFrame:
    """batch_no, id and trn by position: the nth line that is not blank answers the nth text."""
    line = F.posexplode(F.filter(F.split("body", "\n", -1), lambda x: F.trim(x) != "")).alias("pos", "line")
    bare = F.regexp_replace(F.trim("line"), r"^\d+[.、．]\s*", "")
    return replies.select("batch_no", line).select("batch_no", (F.col("pos") + 1).alias("id"), bare.alias("trn"))


def join_replies(sent: DataFrame, got: DataFrame) -> DataFrame:
    """Sent rows with translated; an id that did not come back keeps its text."""
    g = got.select(F.col("batch_no").alias("__b"), F.col("id").alias("__i"), F.col("trn").alias("__t"))
    met = sent.join(g, (F.col("batch_no") == F.col("__b")) & (F.col("id") == F.col("__i")), "left")
    return met.withColumn("translated", F.coalesce("__t", "text")).drop("__b", "__i", "__t")


def translated_texts(texts: DataFrame, translator: Callable[[list[str]], list[str | None]], size: int = DEFAULT.batch_size) -> DataFrame:
    """text and translated of distinct texts by an outside translator, called with lists of ``size``; a call that fails leaves its texts as they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[str] = []
            for k in range(0, len(frame), size):
                part = frame["text"].iloc[k : k + size].tolist()
                try:
                    got = translator(part)
                except Exception:  # noqa: BLE001  an outside service may fail in any way
                    got = [None] * len(part)
                out += [b if b is not None else a for a, b in zip(part, got, strict=True)]
            yield pd.DataFrame({"text": frame["text"].tolist(), "translated": out})

    return texts.select("text").mapInPandas(run, "text string, translated string")


def merged_cache(cache: DataFrame, fresh: DataFrame, overwrite: bool = False, identity: bool = True) -> DataFrame:
    """The cache with new entries: first wins or, with ``overwrite``, last; ``identity`` keeps translations equal to their text."""
    new = fresh if identity else fresh.filter("translated <> text")
    both = cache.select("text", "translated", F.lit(0).alias("age")).unionByName(new.select("text", "translated", F.lit(1).alias("age")))
    pick = F.max_by if overwrite else F.min_by
    return both.groupBy("text").agg(pick("translated", "age").alias("translated"))


def short_terms(items: DataFrame, terms: DataFrame, metrics: Metrics | TableMetrics = Metrics()) -> DataFrame:
    """Vertical items whose translation is too tall for their box take the dictionary's wording if that is shorter."""
    d = distinct_terms(terms).select(F.col("cn").alias("__cn"), F.col("en").alias("__en"))
    met = items.join(d, F.col("text") == F.col("__cn"), "left")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    tall = metrics.height * F.col("size")
    size = F.when(tall > w, F.col("size") * (w / tall) * 0.85).otherwise(F.col("size"))
    need = metrics.column_widest(F.col("translated")) * size * 1.05 * F.char_length("translated")
    swap = F.col("is_vertical") & is_translated() & (need > 1.2 * h) & (F.char_length("__en") < F.char_length("translated"))
    return met.withColumn("translated", F.when(swap, F.col("__en")).otherwise(F.col("translated"))).drop("__cn", "__en")


def refill_route(script: str = t.HAN) -> Column:
    """skipped, vertical, rotated, split or horizontal: how an item is put back.

    Items have is_vertical, direction, rotation_deg and needs_split. Text of the script without a translation is erased
    all the same, but not put back: erasing and putting back are two decisions.
    """
    skipped = ~is_translated() & t.has_script(F.col("text"), script)
    rotated = (F.col("direction") == "rotated") & (F.abs("rotation_deg") > 5)
    return F.when(skipped, "skipped").when(F.col("is_vertical"), "vertical").when(rotated, "rotated").when(F.col("needs_split"), "split").otherwise("horizontal")
