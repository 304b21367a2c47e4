"""The corpus pipeline: quality rules, language, near-duplicates, source mix, and token ids.

Every stage takes all rows that the one before it kept. All but the last return the columns of documents.

Defined results: a null or empty text has no words, so the quality rules reject it; a text without letters has no language
and is rejected; a null source is a source and a host of its own; a null id is no reason to reject, and such rows are no
near-duplicates; of rows that repeat id and text one stays; of near-duplicates the one with the smallest id stays; texts of
any length are taken whole; columns beside those that a stage works on pass through the first four stages, whatever their names
(they are carried in one column, so that no operator sees them); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.llm import language, mixing, neardup, pieces, quality
from folioframe.llm.common import durable, passing, table


#: What the stages work on, and the column that holds all others meanwhile.
WORKED_ON = ("doc_id", "text", "source")
CARRIED = "carried"


def apart(docs):
    """docs with all columns but those that stages work on in one."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in WORKED_ON]
    return docs.select(*WORKED_ON, *([F.struct(*others).alias(CARRIED)] if others else []))


def together(kept, docs):
    """The columns of docs again."""
    return kept.select(*[F.col(c) if c in WORKED_ON else F.col(CARRIED).getField(c).alias(c) for c in docs.columns])


def quality_stage(spark, docs, sf_dir):
    """Keep what the host-level rules keep."""
    judged = quality.row_rules(apart(docs))
    return together(quality.with_verdicts(judged, quality.host_verdicts(judged)).filter("kept"), docs)


def language_stage(spark, docs, sf_dir):
    """Keep documents whose language can be told."""
    params = language.LanguageParams()
    told = language.predicted(apart(docs), language.fit(docs.select("doc_id", "text", "lang"), params))
    return together(told.filter((told.lang_pred != language.UNDETERMINED) & (told.score >= params.min_score)), docs)


def near_duplicate_stage(spark, docs, sf_dir):
    """Keep one document of each near-duplicate group."""
    return together(neardup.one_of_each(apart(docs)), docs)


def mixing_stage(spark, docs, sf_dir):
    """Leave out or repeat documents so that sources come near their targets."""
    return together(mixing.mixed_rows(apart(docs)), docs)


def token_stage(spark, docs, sf_dir):
    """Token ids of every row, as digests."""
    return pieces.encoded(docs, pieces.default_model())


STAGES = [
    ("quality rules", quality_stage),
    ("language identification", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("source mix", mixing_stage),
    ("token ids", token_stage),
]

#: A trained classifier decides in the second stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each result is written and read again as the next stage's input, and only the last one stays."""
    with passing(spark) as last:
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = durable(stage(spark, docs, sf_dir))
        return last(STAGES[-1][1](spark, docs, sf_dir))
