"""URL filtering by list rules and mined association rules (operator 10).

List rules fit a host with all its subdomains and a path prefix; the longest fitting rule decides. What no
list rule fits is judged by rules mined with Spark's FP-growth: labelled URLs become sets of tokens,
frequent sets that occur with the label ``block`` give rules (tokens -> block), kept from a least support
and confidence on, and only where no subset of a kept rule says the same. The rules are an inverted
index from one token of each rule (its rarest) to the rule, so a URL is compared only with rules that
hold one of its tokens.

Labelled URLs are a table of (url, label) that the caller may give. Without one they are ``labelled_urls``:
several thousand URLs drawn by a rule from words that public block lists sort sites by and from ordinary words,
ambiguous ones among both. The label table of the corpus marks texts, and its labels are independent of the
hosts of the pages (README), so it is not used. Mining is a Spark job over a table of any size; the number of
mined rules is bounded by 1 / support and the vocabulary, so the index goes to every task.

Defined results: a null URL, or one without ``://``, has an empty host and path and the verdict of a URL
without tokens (allow); a host of any case is compared in lower case (A-Z only); ports and user names
stay part of the host; of list rules of one length the first wins; without labelled URLs nothing is mined;
repeated rows are judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path): the contract's list.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Words by which public block lists sort sites, with words that often stand beside them; and ordinary words.
BLOCKED = {
    "gambling": ("casino poker roulette jackpot blackjack slots bets betting bingo lottery sportsbook bookmaker gamble", "lucky mega vegas royal spin club world play live"),
    "pharmacy": ("viagra cialis pills pharmacy meds tramadol xanax tablets rx steroids", "discount generic online express no quick order direct"),
    "adult": ("porn xxx sex nude cams escort hentai milf erotic webcam", "hot video girls tube night free live room"),
    "spam": ("spam seo backlinks linkfarm autosurf spambot clickbait traffic guestposts", "network boost rank top blast machine host power"),
    "advertising": ("ads adserver banner popunder tracker tracking telemetry doubleclick adclick analyticsads", "server pixel media count serve sync cdn edge"),
    "malware": ("warez keygen crack torrent phishing malware serials cracked", "download full zone free files mirror soft patch"),
}
ORDINARY = "library garden news university museum weather recipes railway school music river kitchen forum hospital theatre clinic statistics travel farm village history science sport cycling coffee bakery market energy climate painting chess hiking boat mountain letters journal archive physics biology poetry market shop order video room night free live world play top soft media count host files power machine win cheap farm track link adult"


def labelled_urls(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(url, label): ``n`` URLs by a rule on the row's number, a third of them blocked."""

    def pick(words: str, salt: int) -> Column:
        listed = words.split()
        return F.element_at(F.array(*map(F.lit, listed)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(listed))) + 1).cast("int"))

    kind = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3 * len(BLOCKED)))
    ordinary, other = pick(ORDINARY, 2), pick(ORDINARY, 3)
    host, label = F.concat_ws("-", ordinary, other), F.lit("allow")
    for k, (bad, beside) in enumerate(BLOCKED.values()):
        two = F.when(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(2)) == 0, F.concat_ws("-", pick(bad, 5), pick(beside, 6))).otherwise(F.concat_ws("-", pick(f"{beside} {ORDINARY}", 7), pick(bad, 8)))
        host, label = F.when(kind == k, two).otherwise(host), F.when(kind == k, F.lit("block")).otherwise(label)
    page = F.concat_ws("/", pick("en de fr es it", 9), pick(ORDINARY, 10))
    url = F.concat(F.lit("https://"), pick("www. m. blog. shop.", 11), host, F.lit(".example."), pick("com org net", 12), F.lit("/"), page)
    return spark.range(n).select(url.alias("url"), label.alias("label"))


#: Tokens that any URL may hold say nothing.
COMMON = frozenset("http https www m blog example com net org en de fr es html page ref utm source feed top".split())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the contract cuts them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = re.search(r"[/?#]", rest)
    host = rest[: end.start()] if end else rest
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def url_tokens(host: str, path: str) -> list[str]:
    """Distinct letter runs of the host and path, in order, without the common ones."""
    return list(dict.fromkeys(t for t in re.findall(r"[a-z]+", f"{host}{path}".lower()) if t not in COMMON))


def list_rule(host: str, path: str, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[str, str] | None:
    """(rule as text, verdict) of the longest rule that fits."""
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=None)  # of equal lengths the first


def mine_rules(labelled: DataFrame, *, support: float = 0.002, confidence: float = 0.9) -> list[tuple[str, ...]]:
    """Token sets that imply ``block``, mined by FP-growth from (url, label) and pruned by support, confidence and subsumption."""
    tokens = F.udf(lambda url: url_tokens(*split_url(url)), "array<string>")
    baskets = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(F.concat(tokens("url"), F.array(F.concat(F.lit("="), F.col("label")))).alias("items"))
    mined = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    rules = mined.where(F.array_contains("consequent", "=block") & ~F.exists("antecedent", lambda t: t.startswith("=")))
    found = sorted({tuple(sorted(r.antecedent)) for r in rules.select("antecedent").collect()}, key=lambda t: (len(t), t))
    kept: list[tuple[str, ...]] = []
    for rule in found:
        if not any(set(k) < set(rule) for k in kept):
            kept.append(rule)
    return kept


class RuleIndex:
    """Inverted index: the rarest token of each mined rule -> the rules."""

    def __init__(self, mined: Iterable[tuple[str, ...]]) -> None:
        mined = list(mined)
        often: dict[str, int] = {}
        for t in (t for rule in mined for t in rule):
            often[t] = often.get(t, 0) + 1
        self.index: dict[str, list[frozenset[str]]] = {}
        for rule in mined:
            self.index.setdefault(min(rule, key=lambda t: (often[t], t)), []).append(frozenset(rule))

    def blocks(self, tokens: list[str]) -> bool:
        have = set(tokens)
        return any(rule <= have for t in tokens for rule in self.index.get(t, ()))


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, support: float = 0.002, confidence: float = 0.9) -> DataFrame:
    """One row a page: id, host, path, rule (or null), verdict. One pass over the URL column, no shuffle."""
    labelled = labelled_urls(pages.sparkSession) if labelled is None else labelled
    index = RuleIndex(mine_rules(labelled, support=support, confidence=confidence))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule = list_rule(host, path, rules)
                out.append((host, path, *(rule or (None, "block" if index.blocks(url_tokens(host, path)) else "allow"))))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.string()) for c in columns)], names=["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(batches, f"id {kind}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("id", id_col)
