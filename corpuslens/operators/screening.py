"""Weighted evidence screening of documents: hits with offsets, target-linked hits, talent signals, labels by deal."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpuslens.functions import fixed as X
from corpuslens.functions.rules import first_match



def _rows(**fields) -> ArrayType:
    return ArrayType(StructType([StructField(name, kind()) for name, kind in fields.items()]))


HITS = _rows(label=StringType, matched=StringType, weight=IntegerType, excerpt=StringType, start=IntegerType, end=IntegerType, paragraph=IntegerType)
ANCHORS = _rows(start=IntegerType, end=IntegerType, paragraph=IntegerType)
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
_PARAGRAPH = re.compile(r"\n[\t  ]*\n+")
#: Each pattern with the longest run of letters that stands in all its matches.
_PATTERNS = [(p, w, re.compile(p, re.IGNORECASE), max(re.split(r"\\[bs]\*?|\(.*\)\??|\[.*?\]\*?|/", p), key=len)) for p, w in X.AI_PATTERNS]
#: The four other letters that a pattern without case takes for ASCII ones.
_FOLD = str.maketrans("İſıK", "isik")
_TALENT = [re.compile(p, re.IGNORECASE) for p in (X.TALENT_JOIN, X.JOIN_TALENT)]


def _folded(text: str) -> str:
    """In lower case: whatever a pattern without case finds in the text, its letters stand here."""
    return text.lower() if text.isascii() else text.translate(_FOLD).lower()


def _short(text: str, most: int = 400) -> str:
    plain = " ".join(text.split())
    return plain if len(plain) <= most else plain[: most - 3].rstrip() + "..."


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences that aren't blank."""
    ends = [(m.start(), m.end()) for m in _SENTENCE.finditer(text)]
    edges = zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)], strict=True)
    return [(lo, hi) for lo, hi in edges if text[lo:hi].strip()]


def _paragraph_of(text: str):
    """A function from places in the text to the number of their paragraph."""
    breaks = [m.end() for m in _PARAGRAPH.finditer(text)]
    return lambda at: sum(b <= at for b in breaks)


def text_hits(text: str | None) -> list[dict]:
    """Every hit of the weighted patterns inside a sentence: the heaviest first, then by place and pattern."""
    text = text or ""
    low = _folded(text)
    likely = [p for p in _PATTERNS if p[-1] in low]
    if not likely:
        return []
    paragraph, found = _paragraph_of(text), []
    for lo, hi in sentence_spans(text):
        sentence = text[lo:hi]
        low = _folded(sentence)
        for label, weight, pattern, part in likely:
            for m in pattern.finditer(sentence) if part in low else ():
                found.append({"label": label, "matched": m[0].lower(), "weight": weight, "excerpt": _short(sentence), "start": lo + m.start(), "end": lo + m.end(), "paragraph": paragraph(lo + m.start())})
    return sorted(found, key=lambda h: (-h["weight"], h["start"], h["label"]))


def text_anchors(text: str | None, names: list[str] | None) -> list[dict]:
    """Where any of the names stands as a whole word."""
    text = text or ""
    low = _folded(text)
    found = [m for n in names or () if not n.isascii() or _folded(n) in low for m in re.finditer(rf"(?<!\w){re.escape(n)}(?!\w)", text, re.IGNORECASE)]
    if not found:
        return []
    paragraph = _paragraph_of(text)
    return [{"start": m.start(), "end": m.end(), "paragraph": paragraph(m.start())} for m in found]


@F.pandas_udf(_rows(start=IntegerType, end=IntegerType, sentence=StringType))
def sentences_at(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sentences of a text with their offsets."""
    for texts in batches:
        yield texts.map(lambda t: [{"start": lo, "end": hi, "sentence": t[lo:hi]} for lo, hi in sentence_spans(t)] if t else [])


@F.pandas_udf(HITS)
def ai_hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(text_hits)


@F.pandas_udf(ANCHORS)
def anchors_at(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, names in batches:
        yield pd.Series([text_anchors(t, None if n is None else list(n)) for t, n in zip(texts, names, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def joining_excerpts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sorted distinct sentences around statements that people join."""

    def of(text: str | None) -> list[str]:
        text = text or ""
        found = set()
        for m in (m for p in _TALENT for m in p.finditer(text)):
            end = text.find(".", m.end())
            found.add(_short(text[text.rfind(".", 0, m.start()) + 1 : len(text) if end < 0 else end + 1]))
        return sorted(found)

    for texts in batches:
        yield texts.map(of)


def target_anchors(name: Column) -> Column:
    """Distinct words of a target's name, in order, that are neither short nor generic."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ((F.length(w) >= 3) | ((F.length(w) >= 2) & w.rlike("[0-9]"))) & ~w.isin(*X.AI_GENERIC_TOKENS)))


def linked_hits(hits: Column, anchors: Column, radius: int = 600) -> Column:
    """Hits with an anchor of the same paragraph within ``radius`` characters; each with the gap to the nearest."""
    near = lambda h: F.filter(anchors, lambda a: (a["paragraph"] == h["paragraph"]) & (a["start"] <= h["end"] + radius) & (a["end"] >= h["start"] - radius))
    gaps = lambda h: F.transform(near(h), lambda a: F.least(F.abs(a["start"] - h["end"]), F.abs(h["start"] - a["end"])))
    return F.filter(F.transform(hits, lambda h: F.struct(h["label"].alias("label"), h["matched"].alias("matched"), h["weight"].alias("weight"), h["excerpt"].alias("excerpt"), h["start"].alias("start"), h["end"].alias("end"), F.array_min(gaps(h)).alias("gap"))), lambda h: h["gap"].isNotNull())


def screened(hits: Column, *, strong: int = 3, qualifies: int = 5) -> Column:
    """struct(total_weight, distinct_terms, qualifies): each distinct label of weight ``strong`` or more counts once."""
    heavy = F.filter(hits, lambda h: h["weight"] >= strong)
    labels = F.array_sort(F.array_distinct(F.transform(heavy, lambda h: h["label"])))
    # a label's weight is fixed, so each distinct (label, weight) counts once
    pairs = F.array_distinct(F.transform(heavy, lambda h: F.struct(h["label"].alias("l"), h["weight"].alias("w"))))
    total = F.aggregate(pairs, F.lit(0), lambda s, p: s + p["w"])
    return F.struct(total.alias("total_weight"), labels.alias("distinct_terms"), (total >= qualifies).alias("qualifies"))


def says(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def talent_signals(docs: DataFrame, text: str) -> DataFrame:
    """Adds join_language, join_excerpts, acquihire_explicit and license_and_hire_explicit."""
    t = F.col(text)
    return docs.withColumns({"join_language": says(t, X.TALENT_JOIN) | says(t, X.JOIN_TALENT), "join_excerpts": joining_excerpts(text), "acquihire_explicit": says(t, X.ACQUIHIRE), "license_and_hire_explicit": says(t, X.LICENSE_HIRE)})


def document_screen(docs: DataFrame, text: str, target: str | None = None) -> DataFrame:
    """Adds hits (those linked to the target's name if one is given), total_weight, distinct_terms and qualifies."""
    if target is None:
        rows = docs.withColumn("hits", ai_hits(text))
    else:
        # the text goes to Python once for both
        rows = docs.withColumns({"hits": ai_hits(text), "_anchors": anchors_at(F.col(text), target_anchors(F.col(target)))}).withColumn("hits", linked_hits(F.col("hits"), F.col("_anchors"))).drop("_anchors")
    return rows.withColumn("_s", screened(F.col("hits"))).select("*", "_s.*").drop("_s")


def deal_labels(docs: DataFrame, deal: str, order: str) -> DataFrame:
    """One row a deal from screened documents with talent signals: the heaviest document's evidence (the first of equals), any document's flags, the first excerpt."""
    heavy = F.filter("hits", lambda h: h["weight"] >= 3)
    rows = docs.withColumns({"_terms": F.array_sort(F.array_distinct(F.transform(heavy, lambda h: h["matched"]))), "_best": F.try_element_at("hits", F.lit(1))["excerpt"]})
    ranked = rows.withColumn("_n", -F.row_number().over(Window.partitionBy(deal).orderBy(order)))
    best = F.max_by(F.struct("total_weight", "_terms", "_best", order), F.struct("total_weight", "_n"))
    excerpt = F.max_by(F.try_element_at("join_excerpts", F.lit(1)), F.when(F.size("join_excerpts") > 0, F.col("_n")))
    per = ranked.groupBy(deal).agg(best.alias("b"), F.bool_or("join_language").alias("join_language"), F.bool_or("acquihire_explicit").alias("acquihire_explicit"), F.bool_or("license_and_hire_explicit").alias("license_and_hire_explicit"), excerpt.alias("talent_excerpt"), F.count(F.lit(1)).alias("documents_screened"))
    label = first_match([("ai_explicit", F.col("b.total_weight") >= 5), ("ai_adjacent", F.col("b.total_weight") >= 3)], "none")
    return per.select(deal, label.alias("label"), F.col("b.total_weight").alias("weight"), F.col("b._terms").alias("terms"), F.col("b._best").alias("excerpt"), F.col(f"b.{order}").alias("source"), "join_language", "acquihire_explicit", "license_and_hire_explicit", "talent_excerpt", "documents_screened")


def deal_assessment(docs: DataFrame, deal: str, order: list[str]) -> DataFrame:
    """One row a deal: its strongest qualifying document (the first of equals), or why there is none."""
    place = Window.partitionBy(deal).orderBy(*order)
    rows = docs.withColumn("_n", -F.row_number().over(place))
    best = F.max_by(F.struct("total_weight", "distinct_terms", *order), F.when(F.col("qualifies"), F.struct("total_weight", "_n")))
    per = rows.groupBy(deal).agg(best.alias("b"), F.bool_or("qualifies").alias("qualifies"), F.bool_or("named").alias("named"))
    why = first_match([("", F.col("qualifies")), ("target_mentioned_without_local_ai_evidence", F.col("named"))], "no_target_mention_in_retrieved_documents")
    return per.select(deal, "qualifies", F.when(F.col("qualifies"), F.col("b.total_weight")).otherwise(0).alias("total_weight"), F.when(F.col("qualifies"), F.col("b.distinct_terms")).alias("distinct_terms"), *(F.when(F.col("qualifies"), F.col(f"b.{c}")).alias(c) for c in order), why.alias("missingness_reason"))
