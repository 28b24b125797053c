"""Blocks, evidence, passages, duplicate groups and wording metrics of documents."""

from __future__ import annotations

import html.parser
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from corpuslens.functions import text as T
from corpuslens.functions.ids import stable_id
from corpuslens.operators.components import connected_components
from corpuslens.plans.lineage import cut, written

BLOCK_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p div li td pre".split())
_BLOCKS = ArrayType(StructType([StructField("idx", IntegerType()), StructField("tag", StringType()), StructField("text", StringType()), StructField("heading", BooleanType())]))


class _Leaves(html.parser.HTMLParser):
    """Blocks that hold no other block, in page order; an open ``p`` or ``li`` ends where the next block begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # [tag, text parts, bold characters, has a block inside]
        self.found: list[tuple[str, str, int]] = []
        self.skip = self.bold = 0

    def _end(self) -> None:
        tag, parts, bold, outer = self.open.pop()
        text = " ".join("".join(parts).split())
        if text and not outer:
            self.found.append((tag, text, bold))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag in ("b", "strong"):
            self.bold += 1
        elif tag == "br" and self.open:
            self.open[-1][1].append(" ")
        elif tag in BLOCK_TAGS:
            if self.open and self.open[-1][0] in ("p", "li") and (tag == self.open[-1][0] or self.open[-1][0] == "p"):
                self._end()
            if self.open:
                self.open[-1][3] = True
            self.open.append([tag, [], 0, False])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("b", "strong"):
            self.bold = max(0, self.bold - 1)
        elif tag in BLOCK_TAGS and any(o[0] == tag for o in self.open):
            while self.open[-1][0] != tag:
                self._end()
            self._end()

    def handle_data(self, data: str) -> None:
        if self.open and not self.skip:
            self.open[-1][1].append(data)
            self.open[-1][2] += len("".join(data.split())) if self.bold else 0


def leaf_blocks(page: str | None) -> list[dict]:
    parser = _Leaves()
    parser.feed(page or "")
    parser.close()
    while parser.open:
        parser._end()
    out = []
    for k, (tag, text, bold) in enumerate(parser.found):
        letters = [c for c in text if c.isalpha()]
        loud = bool(letters) and sum(c.isupper() for c in letters) >= 0.8 * len(letters)
        short = len(text.split()) <= 20
        out.append({"idx": k, "tag": tag, "text": text, "heading": tag[0] == "h" or (short and (loud or bold >= len("".join(text.split()))))})
    return out


@F.pandas_udf(_BLOCKS)
def html_blocks(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(leaf_blocks)


def paragraphs(docs: DataFrame, ident: str, text: str, *, separator: str = r"\n\s*\n+") -> DataFrame:
    """(ident, block_index, text) of the non-blank paragraphs of plain text."""
    parts = F.filter(F.transform(F.split(text, separator), T.collapse), lambda p: p != "")
    return docs.select(ident, F.posexplode(parts).alias("block_index", "text"))


def split_long(blocks: DataFrame, text: str, *, most_words: int = 220) -> DataFrame:
    """Blocks of more than ``most_words`` words cut into runs of that many; adds ``piece``."""
    w = F.split(F.trim(F.col(text)), r"\s+")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / most_words).cast("int")), lambda k: F.concat_ws(" ", F.slice(w, k * most_words + 1, F.lit(most_words))))
    return blocks.select(*(c for c in blocks.columns if c != text), F.posexplode(runs).alias("piece", text))


def carry_heading(blocks: DataFrame, group: str, order: str, heading: Column) -> DataFrame:
    """The last heading at or before each block."""
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("heading", F.last(heading, ignorenulls=True).over(so_far))


def char_offsets(blocks: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Start and end of each block in the text of its blocks joined by a line feed."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))
    return blocks.withColumn("char_start", start).withColumn("char_end", start + F.length(text))


def context_islands(blocks: DataFrame, group: str, order: str, hit: Column, heading: str, *, k: int = 1) -> DataFrame:
    """(group, island, first, last, hits): ranges of ``k`` blocks around each hit, inside its run of one heading, overlapping ones merged."""
    w = Window.partitionBy(group).orderBy(order)
    changed = F.coalesce((~F.col(heading).eqNullSafe(F.lag(heading).over(w))).cast("int"), F.lit(1))
    runs = blocks.withColumn("changed", changed).select(group, F.col(order).alias("at"), hit.alias("hit"), F.sum("changed").over(w).alias("run"))
    span = Window.partitionBy(group, "run")
    hits = runs.withColumns({"lo": F.greatest(F.col("at") - k, F.min("at").over(span)), "hi": F.least(F.col("at") + k, F.max("at").over(span))}).where("hit")
    before = Window.partitionBy(group).orderBy("lo", "at").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-1))).cast("int")
    island = F.sum("fresh").over(Window.partitionBy(group).orderBy("lo", "at"))
    return hits.withColumn("fresh", fresh).withColumn("island", island).groupBy(group, "island").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.count(F.lit(1)).alias("hits"))


def token_hits(docs: DataFrame, ident: str, text: str, terms: dict[str, Sequence[str]]) -> DataFrame:
    """(ident, category, term, start, end): where terms of one or more tokens stand, by token index; at a start the longest term of a category wins."""
    table = [(category, " ".join(words), words[0], len(words)) for category, terms_ in terms.items() for words in (t.split() for t in terms_)]
    longest = max(n for *_, n in table)
    firsts = sorted({first for *_, first, _ in table})
    # one pass over the tokens keeps the places where some term may begin, with the words that it may need
    rows = docs.select(ident, T.simple_tokens(F.col(text)).alias("t"))
    begins = F.filter(F.transform("t", lambda word, i: F.when(word.isin(*firsts), i)), lambda i: i.isNotNull())
    places = rows.select(ident, F.explode(F.transform(begins, lambda i: F.struct(i.alias("start"), F.slice("t", i + 1, F.lit(longest)).alias("words")))).alias("p")).select(ident, "p.*")
    known = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(t).alias("term"), F.lit(n).alias("n")) for c, t, _, n in table))
    fits = F.filter(known, lambda k: F.concat_ws(" ", F.slice("words", F.lit(1), k["n"])) == k["term"])
    hits = places.select(ident, "start", F.inline(fits)).select(ident, "category", "term", "start", (F.col("start") + F.col("n")).alias("end"))
    best = Window.partitionBy(ident, "category", "start").orderBy(F.desc("end"), "term")
    return hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def proximity(hits: DataFrame, anchors: DataFrame, ident: str, radius: int) -> DataFrame:
    """Hits within ``radius`` of an anchor of the same document: adds the gap to the nearest one. Both are bucketed by the radius, so it is an equi-join."""
    a = anchors.select(F.col(ident).alias("_i"), F.col("start").alias("anchor"), F.explode(F.sequence(F.floor(F.col("start") / radius) - 1, F.floor(F.col("start") / radius) + 1)).alias("_b"))
    near = hits.withColumn("_b2", F.floor(F.col("start") / radius)).join(a, (F.col(ident) == F.col("_i")) & (F.col("_b2") == F.col("_b")))
    gap = F.abs(F.col("start") - F.col("anchor"))
    return near.where(gap <= radius).groupBy(*hits.columns).agg(F.min(gap).alias("gap"))


def weighted_screen(hits: DataFrame, ident: str, label: str, weight: str, *, strong: int = 3, qualifies: int = 5) -> DataFrame:
    """(ident, score, labels, qualified): the largest weight of each distinct label, summed where it is strong."""
    per = hits.groupBy(ident, label).agg(F.max(weight).alias("w"))
    out = per.groupBy(ident).agg(F.sum(F.when(F.col("w") >= strong, F.col("w")).otherwise(0)).alias("score"), F.count(F.lit(1)).alias("labels"))
    return out.withColumn("qualified", F.col("score") >= qualifies)


def exact_duplicates(docs: DataFrame, ident: str, text: Column, *, order: Sequence[Column] | None = None) -> DataFrame:
    """All rows with passage_id (of the collapsed text), occurrence_count and whether they are canonical."""
    rows = docs.withColumn("passage_id", stable_id("passage_", T.collapse(text)))
    w = Window.partitionBy("passage_id")
    return rows.withColumns({"occurrence_count": F.count(F.lit(1)).over(w), "canonical": F.row_number().over(w.orderBy(*(order or []), F.col(ident))) == 1})


def minhash(sets: DataFrame, ident: str, shingles: str, permutations: int = 12) -> DataFrame:
    """(ident, h0, h1, ...): for each permutation p the smallest first 16 hex digits of sha256("p:shingle"). Exploded, so that hashing and minima run in generated code with partial aggregation."""
    one = lambda p: F.min(F.substring(F.sha2(F.concat(F.lit(f"{p}:"), F.col("_s")), 256), 1, 16)).alias(f"h{p}")
    return sets.select(ident, F.explode(shingles).alias("_s")).groupBy(ident).agg(*(one(p) for p in range(permutations)))


def near_duplicate_families(docs: DataFrame, ident: str, tokens: Column, *, bands: int = 3, rows: int = 4, least: float = 0.72, size_ratio: float = 0.7) -> DataFrame:
    """(ident, family, members): components of pairs that share a band and pass the size and Jaccard tests.

    Equal sets are merged first, so copies cost no pair; distinct sets are joined by the bucket's key (an
    equi-join, split where skewed), so a bucket is no task's array.
    """
    # sets and their digests are made once; who needs ids and digests alone reads only those
    made = docs.select(F.col(ident).alias("id"), tokens.alias("t")).select("id", F.array_sort(T.shingles(F.col("t"))).alias("s"))
    sets = written(made.withColumn("same", F.sha2(F.to_json("s"), 256)), "sets")
    keyed = sets.where(F.col("same").isNotNull() & (F.col("same") != F.sha2(F.lit("[]"), 256)))
    reps = cut(keyed.groupBy("same").agg(F.min("id").alias("rep"), F.first("s").alias("s")))
    band = F.array(*(F.concat_ws(",", F.lit(str(b)), *(f"h{p}" for p in range(b * rows, (b + 1) * rows))) for b in range(bands)))
    banded = minhash(reps, "rep", "s", bands * rows).select("rep", F.explode(band).alias("band"))
    banded = cut(banded)
    pairs = banded.toDF("a", "band").join(banded.toDF("b", "band"), "band").where("a < b").select("a", "b").distinct()
    x, y = reps.select(F.col("rep").alias("a"), F.col("s").alias("x")), reps.select(F.col("rep").alias("b"), F.col("s").alias("y"))
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = F.size(F.array_intersect("x", "y"))
    links = pairs.join(x, "a").join(y, "b").where((small >= size_ratio * large) & (both >= least * (F.size("x") + F.size("y") - both))).select("a", "b")
    parts = connected_components(links)
    family = keyed.join(reps.select("same", "rep"), "same").join(parts, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("family"))
    out = sets.select("id").join(family, "id", "left").select("id", F.coalesce("family", "id").alias("family"))
    return out.select(F.col("id").alias(ident), "family", F.count(F.lit(1)).over(Window.partitionBy("family")).alias("members"))


def lexicon_rates(docs: DataFrame, ident: Sequence[str], tokens: Column, lexicons: dict[str, Sequence[str]], *, per: int = 100, digits: int = 4) -> DataFrame:
    """ident (which tells rows apart), tokens and, for each lexicon, its count and rate: one conditional aggregate over the tokens."""
    each = docs.select(*ident, F.explode_outer(tokens).alias("_t"))
    rows = each.groupBy(*ident).agg(F.count("_t").alias("tokens"), *(F.count_if(F.col("_t").isin(*terms)).alias(f"{name}_count") for name, terms in lexicons.items()))
    return rows.withColumns({f"{name}_rate": T.rate(F.col(f"{name}_count"), F.col("tokens"), per, digits) for name in lexicons})


def family_baseline(rows: DataFrame, family: str, metric: str, *, least: int = 5, digits: int = 4) -> DataFrame:
    """Adds the mean of the row's family (of all rows where the family is small, flagged) and the residual."""
    per = cut(rows.groupBy(family).agg(F.sum(metric).alias("_s"), F.count(metric).alias("_c"), F.count(F.lit(1)).alias("family_size")))
    overall = per.agg((F.sum("_s") / F.sum("_c")).alias("_all"))
    small = F.col("family_size") < least
    per = per.crossJoin(F.broadcast(overall)).select(F.col(family).alias("_f"), "family_size", small.alias("fallback"), F.round(F.when(small, F.col("_all")).otherwise(F.col("_s") / F.col("_c")), digits).alias("baseline"))
    return rows.join(per, F.col(family).eqNullSafe(F.col("_f"))).drop("_f").withColumn("residual", F.round(F.col(metric) - F.col("baseline"), digits))
