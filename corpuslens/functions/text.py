"""Text functions as column expressions; Python only where Unicode normal forms need it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslens.functions.fixed import LEGAL_SUFFIXES, PROBE_GENERIC_TOKENS

# What counts as a word and as a model's token.
WORD = r"(?U)\b[\w'’-]+\b"
MODEL_TOKEN = r"[a-z][a-z0-9]*(?:[-'][a-z0-9]+)*"


def simple_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def model_tokens(text: Column, stop: Sequence[str] = (), markers: Sequence[str] = ()) -> Column:
    """Lower-case word tokens of two letters or more, without stop words and marker tokens; repeats stay."""
    found = F.regexp_extract_all(F.lower(text), F.lit(MODEL_TOKEN), F.lit(0))
    drop = [*stop, *markers]
    return F.filter(found, lambda t: (F.length(t) > 1) & (~t.isin(*drop) if drop else F.lit(True)))


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """Adjacent runs of ``n`` tokens in order; empty if there are fewer."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(sep, *(F.get(tokens, i + k) for k in range(-1, n - 1))))


def shingles(tokens: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` tokens; the distinct tokens themselves if there are fewer."""
    return F.when(F.size(tokens) < n, F.array_distinct(tokens)).otherwise(F.array_distinct(ngrams(tokens, n)))


def phrase_pattern(term: str, *, every: bool = True) -> str:
    """A pattern for a term as whole words, any space or hyphen between its words, plural allowed on the last.

    Without ``every`` a single word has no plural, nor a last word that ends in s.
    """
    words = [re.escape(w) for w in re.split(r"[\s-]+" if every else r"\s+", term.strip().lower())]
    plural = "s?" if every or (len(words) > 1 and not words[-1].endswith("s")) else ""
    return r"(?U)(?<!\w)" + r"[\s-]+".join(words) + plural + r"(?!\w)"


def folded(text: Column) -> Column:
    """Lower case, with the four other letters that a pattern without case takes for ASCII ones as those."""
    return F.translate(F.lower(F.translate(text, "İ", "i")), "ſıK", "sik")


def may_hold(text: Column, term: str) -> Column:
    """Whether a text in lower case holds the words of a term at all: cheap, and true wherever a pattern for the term matches."""
    first, *more = (F.contains(text, F.lit(w)) for w in sorted(set(re.split(r"[\s-]+", term.strip().lower())) - {""}, key=lambda w: (-len(w), w)))
    for holds in more:
        first = first & holds
    return first


def phrase_count(text: Column, term: str) -> Column:
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(phrase_pattern(term))), F.lit(0))


def rate(count: Column, tokens: Column, per: int = 100, digits: int = 4) -> Column:
    """``count`` per ``per`` tokens; 0 for a text without tokens."""
    return F.when(tokens > 0, F.round(count * float(per) / tokens, digits)).otherwise(F.lit(0.0))


def excerpt(text: Column, start: Column, end: Column, before: int = 250, after: int = 350) -> Column:
    """Text around a 0-based match, white space collapsed."""
    lo = F.greatest(F.lit(0), start - before)
    return collapse(F.substring(text, lo + 1, F.least(F.length(text), end + after) - lo))


def clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def company_name(name: Column) -> Column:
    """Lower case, other characters to space, without a leading article and trailing legal forms."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), " +", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "^(the )+", ""), f"( ({'|'.join(LEGAL_SUFFIXES)}))+$", ""))


def employer_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))


def padded_number(value: Column, width: int = 10) -> Column:
    """Digits of ``value`` left-padded with zeros; an error if there are none or too many."""
    digits = F.regexp_replace(value.cast("string"), "[^0-9]", "")
    return F.when(F.length(digits).between(1, width), F.lpad(digits, width, "0")).otherwise(F.raise_error(F.concat(F.lit("not an identifier: "), F.coalesce(value.cast("string"), F.lit("null")))))


def sentences(text: Column) -> Column:
    """Sentences in order: split after . ! ? ; before white space and at line ends, blank ones left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


@F.pandas_udf(StringType())
def normal_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC and case-folded, which no built-in does."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def model_text(text: Column) -> Column:
    """Normal form with URLs and numbers as marker tokens and only word characters kept."""
    marked = F.regexp_replace(F.regexp_replace(normal_form(text), r"https?://\S+|www\.\S+", " urltoken "), r"(?U)\b\d[\d,.]*\b", " numbertoken ")
    return collapse(F.regexp_replace(F.regexp_replace(marked, "[’‘]", "'"), r"(?U)[^\w\s'-]", " "))


def mask_names(text: Column, aliases: Column, mask: str = "entitytoken") -> Column:
    """Each alias, longest first, replaced where it stands as whole words, in any case."""
    longest = F.array_sort(aliases, lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(F.filter(longest, lambda a: F.trim(a) != ""), lambda a: F.concat(F.lit(r"(?iU)(?<!\w)\Q"), a, F.lit(r"\E(?!\w)")))
    return F.aggregate(quoted, text, lambda t, pattern: F.regexp_replace(t, pattern, F.lit(mask)))


def distinctive_tokens(name: Column, generic: Sequence[str] = PROBE_GENERIC_TOKENS, least: int = 3) -> Column:
    """Words of a name, in order, that may tell it apart: no short and no generic ones."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= least) & ~w.isin(*generic))
