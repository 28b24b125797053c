"""Counts and rates of words and phrases by lexicon."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import fixed as X
from corpuslens.functions import text as T
from corpuslens.functions.text import WORD, rate


def whole(term: str, *, flexible: bool = False) -> str:
    """A pattern for a term as whole words in any case; ``flexible``: any space or hyphen between its words."""
    words = [re.escape(w) for w in term.split()]
    return r"(?iU)(?<!\w)" + (r"[\s-]+" if flexible else " ").join(words) + r"(?!\w)"


def occurrences(text: Column, terms: Sequence[str], *, flexible: bool = False, lowered: Column | None = None) -> Column:
    """How often the terms stand in the text, each by itself.

    A pattern runs only over texts that hold the words of its term; ``lowered``: the text ``folded``, if it is at hand.
    """
    low = T.folded(text) if lowered is None else lowered
    counts = [F.when(T.may_hold(low, t), F.regexp_count(text, F.lit(whole(t, flexible=flexible)))).otherwise(0) for t in terms]
    return F.coalesce(sum(counts[1:], counts[0]), F.lit(0)).cast("long")


def lexicon_counts(rows: DataFrame, text: str, lexicons: dict[str, Sequence[str]] = X.LEXICONS) -> DataFrame:
    """Adds tokens and, for each lexicon, its count and its rate per 100 tokens."""
    plain = F.regexp_replace(F.col(text), r"\s+", " ")
    out = rows.withColumn("_t", plain).withColumn("_l", T.folded(F.col("_t"))).withColumn("tokens", F.coalesce(F.regexp_count("_t", F.lit(WORD)), F.lit(0)).cast("long"))
    out = out.withColumns({f"{k}_count": occurrences(F.col("_t"), v, lowered=F.col("_l")) for k, v in lexicons.items()})
    return out.withColumns({f"{k}_rate": rate(F.col(f"{k}_count"), F.col("tokens")) for k in lexicons}).drop("_t", "_l")


def tone_features(rows: DataFrame, text: str) -> DataFrame:
    """Adds tokens, counts of positive, negative, hedging, obliging and permitting words, of outcomes and protections, net tone and the share of obligation."""
    out = rows.withColumn("_t", F.lower(F.regexp_replace(F.col(text), r"\s+", " ")))
    out = out.withColumn("_l", T.folded(F.col("_t"))).withColumn("tokens", F.coalesce(F.regexp_count("_t", F.lit(r"[a-z0-9]+(?:['-][a-z0-9]+)*")), F.lit(0)).cast("long"))
    lists = {"pos": X.TONE_POSITIVE, "neg": X.TONE_NEGATIVE, "hedge": X.TONE_HEDGES, "shall": ("shall",), "may": ("may",), "negout": X.TONE_NEGATIVE_OUTCOMES, "protect": X.TONE_PROTECTIONS}
    out = out.withColumns({f"{k}_count": occurrences(F.col("_t"), v, flexible=True, lowered=F.col("_l")) for k, v in lists.items()}).drop("_t", "_l")
    modal = F.col("shall_count") + F.col("may_count")
    net = F.when(F.col("tokens") > 0, F.round((F.col("pos_count") - F.col("neg_count")) * 100.0 / F.col("tokens"), 6)).otherwise(F.lit(0.0))
    return out.withColumns({"net_tone": net, "obligation_share": F.when(modal > 0, F.round(F.col("shall_count") / modal, 6)).otherwise(F.lit(0.0))})
