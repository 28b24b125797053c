"""From documents to a corpus of passages: blocks with offsets, matched passages, exact duplicates and their occurrences."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslens.functions import fixed as X
from corpuslens.functions import text as T
from corpuslens.functions.ids import stable_id
from corpuslens.functions.rules import bound
from corpuslens.operators.documents import carry_heading, char_offsets, html_blocks, paragraphs, split_long
from corpuslens.plans.lineage import written


@F.pandas_udf(StringType())
def display_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC with white space collapsed: what two renditions of one passage have in common."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


def structural_heading(heading: Column) -> Column:
    """Whether a heading is furniture (contents, page and annex labels, bare numbers) and not a title; false for null and blank ones."""
    trim = "".join(f"\\u{ord(c):04x}" for c in X.HEADING_TRIM)
    bare = F.regexp_replace(T.collapse(heading), f"^[{trim}]+|[{trim}]+$", "")
    return F.coalesce((bare != "") & bare.rlike(f"(?i){X.STRUCTURAL_HEADING}"), F.lit(False))


def document_blocks(docs: DataFrame, ident: str, text: str, *, most_words: int = 220, html: Column | None = None) -> DataFrame:
    """(ident, block_index, heading, text, char_start, char_end): blocks of plain or HTML documents in order.

    A heading goes to the blocks after it and is no block. Offsets count in the document's segments joined by a line feed;
    long segments are cut into pieces of ``most_words`` words.
    """
    if most_words < 20:
        raise ValueError("most_words must be at least 20")
    is_html = F.lower(F.substring(text, 1, 1000)).rlike("<html|<body|<div|<p|<table") if html is None else html
    plain = paragraphs(docs.where(~is_html), ident, text).select(ident, F.col("block_index").alias("at"), "text", F.lit(False).alias("is_heading"))
    leaves = docs.where(is_html).select(ident, F.inline(html_blocks(text))).select(ident, F.col("idx").alias("at"), "text", F.col("heading").alias("is_heading"))
    rows = carry_heading(plain.unionByName(leaves), ident, "at", F.when(F.col("is_heading"), F.col("text")))
    segments = char_offsets(rows.where(~F.col("is_heading")), ident, "at", "text")
    pieces = split_long(segments.withColumn("whole", F.col("text")), "text", most_words=most_words)
    # a piece begins where the pieces before it and their spaces end
    before = Window.partitionBy(ident, "at").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    placed = pieces.withColumn("local", local)
    index = F.row_number().over(Window.partitionBy(ident).orderBy("at", "piece")) - 1
    start = (F.col("char_start") + F.col("local")).cast("long")
    return placed.select(ident, index.alias("block_index"), "heading", "text", start.alias("char_start"), (start + F.length("text")).alias("char_end"))


def screen_terms(text: Column, terms: Sequence[str] = X.SCREEN_TERMS) -> Column:
    """The terms that stand in the text as whole words or phrases, in the order given."""
    found = lambda low: F.array(*(F.when(T.may_hold(low, t) & low.rlike(T.phrase_pattern(t, every=False)), F.lit(t)) for t in terms))
    return F.filter(bound(F.lower(text), found), lambda t: t.isNotNull())


def _ranges(blocks: DataFrame, ident: str, matched: Column, context: int) -> DataFrame:
    """(ident, block_start, block_end, heading, char_start, char_end, text): matched blocks with those around them."""
    order = Window.partitionBy(ident).orderBy("block_index")
    changed = F.coalesce((~F.col("heading").eqNullSafe(F.lag("heading").over(order))).cast("int"), F.lit(1))
    runs = blocks.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(order)).drop("_changed")
    span = Window.partitionBy(ident, "_run")
    hit = runs.withColumns({"_lo": F.greatest(F.col("block_index") - context, F.min("block_index").over(span)), "_hi": F.least(F.col("block_index") + context, F.max("block_index").over(span))})
    hit = hit.where(matched)
    before = Window.partitionBy(ident, "_run").orderBy("_lo", "block_index").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("_lo") > F.coalesce(F.max("_hi").over(before), F.lit(-1))).cast("int")
    island = F.sum("_fresh").over(Window.partitionBy(ident, "_run").orderBy("_lo", "block_index"))
    ranges = hit.withColumn("_fresh", fresh).withColumn("_island", island).groupBy(F.col(ident).alias("_doc"), "_run", "_island").agg(F.min("_lo").alias("block_start"), F.max("_hi").alias("block_end"))
    inside = runs.drop("_run").join(ranges.drop("_run"), (F.col(ident) == F.col("_doc")) & F.col("block_index").between(F.col("block_start"), F.col("block_end")))
    ordered = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    return inside.groupBy(ident, "block_start", "block_end").agg(
        F.min_by("heading", "block_index").alias("heading"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.concat_ws("\n", F.transform(ordered, lambda b: b["text"])).alias("text")
    )


def passages(blocks: DataFrame, docs: DataFrame, ident: str, *, terms: Sequence[str] = X.SCREEN_TERMS, context: int = 0) -> DataFrame:
    """Candidate passages: matched blocks with ``context`` blocks of the same heading around, overlapping ranges merged.

    ``docs`` holds one row a document with ``ident`` and columns to carry. Adds heading, block and character range, text,
    screen_terms (of heading and text), token_count and content_sha256 (of the text alone, so that renditions meet).
    """
    if context < 0:
        raise ValueError("context cannot be negative")
    matched = F.size(screen_terms(F.col("text"), terms)) > 0
    # without context a matched block is a passage of its own, and no block needs its neighbours
    made = blocks.where(matched).select(ident, F.col("block_index").alias("block_start"), F.col("block_index").alias("block_end"), "heading", "char_start", "char_end", "text") if context == 0 else _ranges(blocks, ident, matched, context)
    titled = F.concat_ws("\n", F.when(~structural_heading(F.col("heading")), F.col("heading")), F.col("text"))
    out = made.withColumns({"analysis_text": titled, "token_count": T.token_count(F.col("text")), "content_sha256": F.sha2(display_text("text"), 256)})
    return out.withColumn("screen_terms", screen_terms(F.col("analysis_text"), terms)).join(docs, ident)


def deduplicated(candidates: DataFrame, order: Sequence[str], *, deal: str, document: str) -> tuple[DataFrame, DataFrame]:
    """(one canonical passage a text, one occurrence a candidate).

    Of equal texts a candidate with a real heading is canonical, then the least by ``order``.
    """
    furniture = F.col("heading").isNull() | structural_heading(F.col("heading"))
    # both results are of the same candidates, which cost far more to make than to keep
    rows = written(candidates.withColumns({"passage_id": F.concat(F.lit("passage_"), F.substring("content_sha256", 1, 16)), "duplicate_group_id": F.concat(F.lit("duplicate_"), F.substring("content_sha256", 1, 16))}), "candidates")
    # an aggregate with partial results: a text that stands in every document is no task's window
    first = F.min_by(F.struct(*(F.col(c) for c in rows.columns if c != "content_sha256")), F.struct(furniture.alias("_furniture"), *order))
    canonical = rows.groupBy("content_sha256").agg(first.alias("_r"), F.count(F.lit(1)).alias("occurrence_count"))
    occurrence = stable_id("occurrence_", "passage_id", deal, document, "block_start", "block_end")
    occurrences = rows.select(occurrence.alias("occurrence_id"), "passage_id", *dict.fromkeys([deal, document, *order]), "heading", *(c for c in ("block_end", "char_start", "char_end") if c not in order))
    return canonical.select(*(F.col(c) if c == "content_sha256" else F.col(f"_r.{c}").alias(c) for c in rows.columns), "occurrence_count"), occurrences


def occurrence_status(occurrences: DataFrame, canonical: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every occurrence with columns of its canonical passage."""
    return occurrences.join(canonical.select(F.col("passage_id").alias("_p"), *columns), F.col("passage_id") == F.col("_p")).drop("_p")


def representative_sources(occurrences: DataFrame, known: DataFrame, deal: str, order: Sequence[Column]) -> DataFrame:
    """One source a deal and passage, the first by ``order``; a passage that ``known`` doesn't hold is an error."""
    first = Window.partitionBy(deal, "passage_id").orderBy(*order)
    rows = occurrences.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    joined = rows.join(known.select(F.col("passage_id").alias("_p")).distinct(), F.col("passage_id") == F.col("_p"), "left")
    checked = F.when(F.col("_p").isNotNull(), F.col("passage_id")).otherwise(F.raise_error(F.concat(F.lit("unknown passage: "), F.col("passage_id"))))
    return joined.withColumn("passage_id", checked).drop("_p")


def subset(corpus: DataFrame, primary: DataFrame, ident: str) -> DataFrame:
    """Passages that a parent topic explains best (ids in ``primary``); one that the corpus doesn't hold is an error."""
    wanted = primary.select(F.col("passage_id").alias("_w")).distinct()
    rows = wanted.join(corpus, F.col("_w") == F.col(ident), "left")
    checked = F.when(F.col(ident).isNotNull(), F.col(ident)).otherwise(F.raise_error(F.concat(F.lit("not in the corpus: "), F.col("_w").cast("string"))))
    return rows.withColumn(ident, checked).select(*corpus.columns)


def parsed_hashes(raw: bytes, blocks: Sequence[str]) -> tuple[str, str]:
    """SHA-256 of a document's bytes and of the display text of its joined blocks."""
    shown = " ".join(unicodedata.normalize("NFKC", "\n".join(blocks)).split())
    return hashlib.sha256(raw).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()
