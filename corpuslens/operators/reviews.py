"""Human review: coding rules, packets and their keys, scores of labels, gates and the state of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.ids import seeded_rank, stable_id
from corpuslens.functions.rules import all_matches, first_match, wilson
from corpuslens.operators.relational import diverse_top

# Gates of the corpus audit and of the topic review.
LEAST_RELEVANCE, MOST_MISSED = 0.90, 0.05
LEAST_FIT, LEAST_EXACT, LEAST_COEFFICIENT = 0.80, 0.80, 0.70
FIT_CODES = ("fit", "partial", "not_fit")


def canonical_url(url: Column, host: str) -> Column:
    """https, lower-case host without www, path without a trailing slash; no query or fragment. Other hosts and schemes are an error."""
    scheme, name = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    bare = F.regexp_replace(name, r"^www\.", "")
    fine = (scheme == "https") & ((bare == host) | name.endswith(f".{host}"))
    return F.when(fine, F.concat(F.lit("https://"), F.when(bare == host, bare).otherwise(name), path)).otherwise(F.raise_error(F.concat(F.lit("not an https URL of the host: "), F.coalesce(url, F.lit("null")))))


def unwrapped_url(url: Column) -> Column:
    """The document behind a viewer link (``...ix?doc=/path``), else the URL."""
    inner = F.regexp_extract(url, r"[?&]doc=([^&#]+)", 1)
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(url.rlike(r"/ix\?doc=") & (inner != ""), F.concat(root, inner)).otherwise(url)


def coding_violations(rows: DataFrame, retrieved: DataFrame, *, key: str, stages: Sequence[str], stage_values: Sequence[str], done_stage: Sequence[str], overall: str, overall_values: Sequence[str], done_overall: Sequence[str], required: Sequence[str], source: str) -> DataFrame:
    """(key, rule): what keeps a row of manual coding from being valid or complete.

    Completed rows need completed stages, their required fields, and a source among the deal's ``retrieved`` (key, url).
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    done = F.col(overall).isin(*done_overall)
    held = retrieved.select(F.col(key).alias("_k"), F.col("url").alias("_u")).distinct()
    joined = rows.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(key))).join(held, (F.col(key) == F.col("_k")) & (F.col(source) == F.col("_u")), "left")
    rules = [("missing_key", blank(key)), ("duplicate_key", F.col("_same") > 1), (f"invalid_{overall}", ~F.coalesce(F.col(overall).isin(*overall_values), F.lit(False)))]
    rules += [(f"invalid_{s}", ~F.coalesce(F.col(s).isin(*stage_values), F.lit(False))) for s in stages]
    rules += [(f"complete_with_open_{s}", done & ~F.coalesce(F.col(s).isin(*done_stage), F.lit(False))) for s in stages]
    rules += [(f"complete_without_{c}", done & blank(c)) for c in required]
    rules.append(("source_not_retrieved", done & ~blank(source) & F.col("_u").isNull()))
    return joined.select(key, F.explode(all_matches(rules)).alias("rule"))


def audit_rows(selected: DataFrame, counts: DataFrame, coding: DataFrame, key: str) -> DataFrame:
    """Selected deals with their run's counts (0 where it has none) and their coding (pending where there is none); coding of others is an error."""
    other = coding.join(selected.select(key), key, "left_anti").select(F.col(key).alias("_bad")).limit(1)
    numbers = [c for c in counts.columns if c != key]
    words = [c for c in coding.columns if c != key]
    rows = selected.join(counts.withColumn("_c", F.lit(1)), key, "left").join(coding.withColumn("_m", F.lit(1)), key, "left")
    rows = rows.select(*selected.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), *(F.when(F.col("_m").isNull() & F.lit(c.endswith("status")), "pending").otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in words))
    return rows.crossJoin(F.broadcast(other.agg(F.max("_bad").alias("_bad")))).withColumn(key, F.when(F.col("_bad").isNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("coding of a deal that is not selected: "), F.col("_bad"))))).drop("_bad")


def source_recall(coded: DataFrame, documents: DataFrame, passages: DataFrame) -> DataFrame:
    """What became of each manually coded source: not retrieved, excluded, without a passage, or found.

    coded: deal_id, url, code; documents: deal_id, url, document_id, included; passages: deal_id, document_id of included ones.
    """
    held = documents.select(F.col("deal_id").alias("_d"), F.col("url").alias("_u"), "document_id", "included").dropDuplicates(["_d", "_u"])
    per = passages.groupBy(F.col("deal_id").alias("_pd"), F.col("document_id").alias("_pi")).agg(F.count(F.lit(1)).alias("qualifying_passages"))
    rows = coded.join(held, (F.col("deal_id") == F.col("_d")) & (F.col("url") == F.col("_u")), "left").join(per, (F.col("deal_id") == F.col("_pd")) & (F.col("document_id") == F.col("_pi")), "left")
    positive = (F.coalesce("code", F.lit("")) != "") & ~F.lower("code").startswith("no_")
    n = F.coalesce("qualifying_passages", F.lit(0))
    status = first_match([("source_not_retrieved", F.col("document_id").isNull()), ("positive_source_excluded", positive & ~F.col("included")), ("positive_source_has_no_qualifying_passage", positive & (n == 0))], "pass")
    return rows.select("deal_id", "url", "code", positive.alias("expected_positive"), "document_id", n.alias("qualifying_passages"), status.alias("validation_status"))


def label_scores(rows: DataFrame, decision: str, good: Column, dimensions: Sequence[str]) -> DataFrame:
    """(decision, scope, level, successes, total, rate, low, high) overall and by each dimension: one pass over grouping sets."""
    marked = rows.select(decision, good.alias("_good"), *dimensions)
    each = marked.select(decision, "_good", F.inline(F.array(F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("level")), *(F.struct(F.lit(d).alias("scope"), F.col(d).cast("string").alias("level")) for d in dimensions))))
    per = each.groupBy(decision, "scope", "level").agg(F.count_if("_good").alias("successes"), F.count(F.lit(1)).alias("total"))
    interval = wilson(F.col("successes"), F.col("total"))
    return per.withColumns({"rate": F.col("successes") / F.col("total"), "low": interval["low"], "high": interval["high"]})


def audit_gate(scores: DataFrame, decision: str, *, least: float = LEAST_RELEVANCE, most: float = MOST_MISSED) -> DataFrame:
    """One row: both overall rates, whether each meets its bound, and the gate. A decision without rows fails it."""
    overall = scores.where("scope = 'overall'")
    row = overall.agg(F.max(F.when(F.col(decision) == "included", F.col("rate"))).alias("included_rate"), F.max(F.when(F.col(decision) == "excluded", F.col("rate"))).alias("excluded_rate"))
    good, missed = F.coalesce(F.col("included_rate") >= least, F.lit(False)), F.coalesce(F.col("excluded_rate") < most, F.lit(False))
    return row.withColumns({"included_passes": good, "excluded_passes": missed, "gate_status": F.when(good & missed, "pass").otherwise("fail")})


def topic_scores(pairs: DataFrame, topic: str, one: str, two: str) -> DataFrame:
    """By topic: what two reviewers said of its items, pooled rates, exact agreement, Cohen's kappa and Gwet's AC1, and the coefficient that counts."""
    n = F.count(F.lit(1)).cast("double")
    share = lambda c, code: F.count_if(F.col(c) == code) / n
    per = pairs.groupBy(topic).agg(
        F.count(F.lit(1)).alias("item_count"), *(share(c, code).alias(f"{side}_{code}") for side, c in (("one", one), ("two", two)) for code in FIT_CODES), (F.count_if(F.col(one) == F.col(two)) / n).alias("exact_agreement")
    )
    a, b = ({code: F.col(f"{side}_{code}") for code in FIT_CODES} for side in ("one", "two"))
    total = lambda parts: sum(parts[1:], parts[0])
    by_chance = total([a[c] * b[c] for c in FIT_CODES])
    common = total([(a[c] + b[c]) / 2 * (1 - (a[c] + b[c]) / 2) for c in FIT_CODES]) / (len(FIT_CODES) - 1)
    kappa = F.when(F.abs(1 - by_chance) > 1e-12, (F.col("exact_agreement") - by_chance) / (1 - by_chance))
    ac1 = (F.col("exact_agreement") - common) / (1 - common)
    out = per.withColumns({"pooled_fit": (a["fit"] + b["fit"]) / 2, "pooled_partial": (a["partial"] + b["partial"]) / 2, "cohen_kappa": kappa, "gwet_ac1": ac1})
    return out.withColumns({"coefficient": F.coalesce("cohen_kappa", "gwet_ac1"), "metric_used": F.when(F.col("cohen_kappa").isNull(), "gwet_ac1").otherwise("cohen_kappa")})


def topic_gate(scores: DataFrame) -> DataFrame:
    """Adds why each topic's review fails, if it does, and its gate."""
    rules = [("pooled_fit", F.col("pooled_fit") < LEAST_FIT), ("exact_agreement", F.col("exact_agreement") < LEAST_EXACT), ("coefficient", F.col("coefficient") < LEAST_COEFFICIENT)]
    return scores.withColumn("failed", all_matches(rules)).withColumn("gate_status", F.when(F.size("failed") == 0, "pass").otherwise("fail"))


def topic_packet(assigned: DataFrame, *, seed: int | str, topic: str, family: str, weight: str, ident: str, public: Sequence[str], each: int = 10) -> tuple[DataFrame, DataFrame]:
    """(packet, key): the best passages of each topic, of different families first, under blind names and in a seeded order."""
    chosen = diverse_top(assigned.where(F.col("primary_topic")), [topic], family, F.col(weight), ident, each)
    blind, item = stable_id("theme_", F.lit(str(seed)), topic, length=8), stable_id("item_", F.lit(str(seed)), topic, ident, length=12)
    rows = chosen.withColumns({"blind_topic_id": blind, "item_id": item, "_order": seeded_rank(seed, F.lit("topic-review"), topic, ident)})
    rank = F.row_number().over(Window.partitionBy("blind_topic_id").orderBy("_order"))
    rows = rows.withColumn("item_rank", rank)
    return rows.select("item_id", "blind_topic_id", "item_rank", *public), rows.select("item_id", "blind_topic_id", topic, ident, weight)


def ranked_candidates(rows: DataFrame, ident: str, score: str, *, seed: str, chosen: int) -> DataFrame:
    """Rank by score, then by a seeded hash of the id: the first ``chosen`` are selected and the others in reserve."""
    order = Window.orderBy(F.desc(score), seeded_rank(seed, ident), ident)
    top = rows.orderBy(F.desc(score), seeded_rank(seed, ident), ident).limit(chosen).withColumn("rank", F.row_number().over(order))
    marked = rows.join(top.select(F.col(ident).alias("_i"), "rank"), F.col(ident).eqNullSafe(F.col("_i")), "left").drop("_i")
    return marked.withColumn("selection_status", F.when(F.col("rank").isNotNull(), "selected_candidate").otherwise("reserve_candidate"))


def corpus_state(audit: dict | None, score: dict | None, *, expected: str | None = None, audit_hash: str | None = None) -> dict:
    """The validation state of one corpus from its audit and score manifests (null where there is none).

    A state is never borrowed from another corpus: a manifest with another candidate hash leaves this one pending.
    ``audit_hash``: the SHA-256 of the audit manifest's file, which the score manifest must name.
    """

    def total(manifest: dict) -> int | None:
        counts = manifest.get("sample_counts")
        whole = isinstance(counts, dict) and counts and all(type(v) is int and v > 0 for v in counts.values())
        return sum(counts.values()) if whole else None

    state = lambda status, why: {"status": status, "detail": why}
    pending = "pending_human_corpus_validation"
    fits = lambda m: expected is None or m.get("candidate_csv_sha256", "") == expected
    if score is None:
        if audit is None:
            return state("no_corpus_validation", "neither an audit packet nor scores")
        return state(pending, "the packet is of another corpus" if not fits(audit) else "labels are not scored" if audit.get("labels_are_human_attested") else "the packet has no labels")
    checks = [
        ("the scores are of another corpus", fits(score)),
        ("labels are not attested", score.get("labels_present") is True and score.get("labels_are_human_attested") is True),
        ("the scores name another audit", audit is None or (bool(score.get("audit_manifest_sha256")) and score.get("audit_manifest_sha256") == audit_hash)),
        ("audit and scores are of different corpora", audit is None or audit.get("candidate_csv_sha256", "") == score.get("candidate_csv_sha256", "")),
        ("sample counts differ", audit is None or (total(audit) is not None and total(score) in (None, total(audit)))),
    ]
    for why, holds in checks:
        if not holds:
            return state(pending, why)
    wanted, done = total(audit) if audit is not None else total(score), score.get("completed_item_count")
    if type(done) is not int or done < 1 or done != wanted:
        return state(pending, "not every sampled row is coded")
    gate = str(score.get("gate_status", "")).lower()
    if score.get("audit_status") != "scored_human_labels" or gate not in ("pass", "fail"):
        return state(pending, "no completed pass or fail")
    return state("accepted_human_corpus_validation" if gate == "pass" else "failed_human_corpus_validation", f"the audit's gate is {gate}")


def report_gate(diagnostics: DataFrame, corpus: str) -> DataFrame:
    """One row: how many diagnostics pass, warn and fail, and whether the report may be released; a corpus that is not accepted is a warning or a failure of its own."""
    rows = diagnostics.agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "warning").alias("warned"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "not_applicable").alias("open"))
    accepted, refused = F.lit(corpus == "accepted_human_corpus_validation"), F.lit(corpus == "failed_human_corpus_validation")
    return rows.withColumn("gate_passed", (F.col("warned") == 0) & (F.col("failed") == 0) & (F.col("passed") > 0) & accepted).withColumn("corpus_diagnostic", F.when(accepted, "pass").when(refused, "fail").otherwise("warning"))


def linked_manifests(child: dict, parent: dict, parent_hash: str, fields: dict[str, str]) -> list[str]:
    """What breaks the chain from a manifest to the one it was made from: the hash it names, and fields that must agree."""
    broken = [] if child.get(fields.get("hash", "audit_manifest_sha256")) == parent_hash else ["hash"]
    return broken + [a for a, b in fields.items() if a != "hash" and child.get(a) != parent.get(b)]
