"""Classifiers and gates over deals, filings, documents and passages: one CASE each, in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import fixed as X
from corpuslens.functions.rules import first_match


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case; false for null."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def starts_with_any(value: Column, prefixes: Sequence[str]) -> Column:
    held = F.upper(F.coalesce(value, F.lit("")))
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: held.startswith(p))


def relevant_document(document_type: Column, is_primary: Column) -> Column:
    """A filing's primary document, or an agreement, contract or press exhibit."""
    return F.coalesce(is_primary, F.lit(False)) | starts_with_any(document_type, X.RELEVANT_TYPE_PREFIXES)


def document_family(form: Column, document_type: Column) -> Column:
    """The family of the first rule whose prefix fits the type; else of the first that fits the form; else ``other``."""
    upper = {"type": F.upper(F.coalesce(document_type, F.lit(""))), "form": F.upper(F.coalesce(form, F.lit("")))}
    return first_match([(family, upper[of].startswith(prefix)) for of in ("type", "form") for prefix, family in X.FAMILY_RULES], "other")


def form_score(form: Column) -> Column:
    """Triage priority of a filing's form."""
    table = F.create_map(*(F.lit(v) for pair in X.FORM_SCORES.items() for v in pair))
    return F.coalesce(F.try_element_at(table, form), F.lit(1))


def filing_links(filings: DataFrame, filed: str, announced: str, effective: str, form: str, *, route: str = "acquirer_confirmed_cik") -> DataFrame:
    """Filings with their distance in days from both anchor dates, their priority and a pending status."""
    return filings.withColumns(
        {
            "discovery_route": F.lit(route),
            "days_from_announcement": F.datediff(F.col(filed), F.col(announced)),
            "days_from_effective": F.datediff(F.col(filed), F.col(effective)),
            "priority": form_score(F.col(form)),
            "manual_status": F.lit("pending"),
        }
    )


def approved_deals(reviewed: DataFrame, decisions: dict[str, str], *, target_status: str, target_id: str) -> DataFrame:
    """Rows whose every human decision has its approving value; a confirmed target without an id is an error. Adds ``approved_target``."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    kept = reviewed.where(" AND ".join(f"lower(trim(coalesce({c}, ''))) = '{v}'" for c, v in decisions.items()))
    blank = F.trim(F.coalesce(F.col(target_id), F.lit(""))) == ""
    target = F.when(plain(target_status) != "confirmed", F.lit(None).cast("string")).when(blank, F.raise_error(F.lit("a confirmed target has no id"))).otherwise(F.trim(F.col(target_id)))
    return kept.withColumn("approved_target", target)


def selected_roster(reviewed: DataFrame, key: str, status: str, value: str = "selected") -> DataFrame:
    """Selected rows; a blank or repeated key among them is an error."""
    rows = reviewed.where(F.lower(F.trim(F.coalesce(F.col(status), F.lit("")))) == value).withColumn(key, F.trim(F.col(key)))
    same = F.count(F.lit(1)).over(Window.partitionBy(key))
    fine = (F.coalesce(F.col(key), F.lit("")) != "") & (same == 1)
    return rows.withColumn(key, F.when(fine, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("blank or repeated key: "), F.coalesce(F.col(key), F.lit(""))))))


def preview_eligibility(rows: DataFrame, key: str, prior: DataFrame, *, date: str, code: str, codes: Sequence[str], registrant: str, confidence: str) -> DataFrame:
    """Adds ``reason``: why a row can't enter a validation preview, checked in order, or ``eligible_preview_candidate``."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    seen = prior.select(F.trim(F.col(key).cast("string")).alias("_prior")).where("_prior <> ''").distinct()
    joined = rows.withColumn("_key", text(key)).join(seen, F.col("_key") == F.col("_prior"), "left")
    joined = joined.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("_key")))
    rules = [
        ("excluded_missing_deal_id", F.col("_key") == ""),
        ("excluded_duplicate_deal_id", F.col("_same") > 1),
        ("excluded_prior_pilot_candidate", F.col("_prior").isNotNull()),
        ("excluded_invalid_announcement_date", F.try_to_date(text(date), "yyyy-MM-dd").isNull()),
        ("excluded_outside_target_sic_screen", ~text(code).isin(*codes)),
        ("excluded_missing_acquirer_cik_candidate", text(registrant) == ""),
        ("excluded_low_or_unresolved_acquirer_match", ~F.lower(text(confidence)).isin("high", "medium")),
    ]
    return joined.withColumn("reason", first_match(rules, "eligible_preview_candidate")).drop("_key", "_prior", "_same")


def public_group(value: Column) -> Column:
    v = F.rtrim(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit("."))
    return F.when(v == "public", "public").when(v != "", "non_public").otherwise("unknown")


def form_group(value: Column) -> Column:
    return F.when(F.lower(F.coalesce(value, F.lit(""))).contains("merger"), "merger").otherwise("non_merger")


def value_group(value: Column) -> Column:
    v = F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), ",", "")))
    return F.when(v.isin("", "na", "n/a", "np", "not provided"), "value_missing").when(v.try_cast("double").isNull(), "value_invalid").otherwise("value_reported")


def document_eligibility(document_type: Column, form: Column, evidence: Column, in_transaction: Column, near_target: Column, text: Column) -> Column:
    """Why a document is in or out of the corpus: the first of eight rules that holds."""
    kind, form = F.upper(F.coalesce(document_type, F.lit(""))), F.upper(F.coalesce(form, F.lit("")))
    language, action = matches(text, X.TRANSACTION_LANGUAGE), matches(text, X.EMPLOYEE_ACTION)
    report_exhibit = (form == "8-K") & kind.startswith("EX-") & ~starts_with_any(kind, ("EX-2.", "EX-99."))
    return first_match(
        [
            ("included_ex2_transaction_agreement", kind.startswith("EX-2.")),
            ("included_transaction_specific_form", form.isin(*X.TRANSACTION_FORMS)),
            ("included_transaction_evidence", evidence > 0),
            ("included_transaction_employee_action_exhibit", report_exhibit & near_target & language & action),
            ("excluded_nontransaction_8k_exhibit", report_exhibit),
            ("included_transaction_accession", in_transaction),
            ("included_target_transaction_proximity", near_target & language),
        ],
        "excluded_unrelated_event_window_document",
    )


def bare_caption(raw: Column) -> Column:
    """A heading of at most twelve words that says nothing is done."""
    words = F.regexp_count(raw, F.lit(r"[a-z][a-z0-9]*(?:[-'][a-z0-9]+)*"))
    return F.coalesce((words > 0) & (words <= 12) & ~matches(raw, X.CAPTION_ACTION), F.lit(False))


def passage_eligibility(terms: Column, model_text: Column, raw: Column | None = None) -> Column:
    """Why a passage is in or out of the model: the first of ten exclusions that holds, or ``included_employee_context``."""
    says = lambda pattern: matches(model_text, pattern)
    holds = lambda names: F.arrays_overlap(terms, F.array(*map(F.lit, names)))
    treatment, leadership, pay = says(X.EMPLOYEE_TREATMENT), says(X.LEADERSHIP), says(X.COMPENSATION)
    acts = treatment | leadership | pay
    specific = F.size(F.array_except(terms, F.array(*map(F.lit, X.GENERIC_TERMS)))) > 0
    people = (holds(X.AWARD_TERMS) & says(X.AWARD_TREATMENT)) | treatment | says(X.HUMAN) | says(X.GENERIC_PEOPLE) | pay
    leaders = F.lit(False) if raw is None else F.coalesce(F.regexp_count(raw, F.lit(X.INDEX_LEADER)) >= 2, F.lit(False))
    caption = F.lit(False) if raw is None else bare_caption(raw)
    return first_match(
        [
            ("excluded_navigation_or_index_fragment", (says(X.NAVIGATION) & ~treatment) | leaders),
            ("excluded_bare_employee_caption", caption),
            ("excluded_safe_harbor_or_forward_looking_context", says(X.SAFE_HARBOR)),
            ("excluded_accounting_or_financial_context", says(X.ACCOUNTING)),
            ("excluded_nonemployee_union_context", says(X.NONEMPLOYEE_UNION) & ~says(X.LABOR)),
            ("excluded_nonemployee_privacy_or_ip_context", says(X.PRIVACY_IP) & ~holds(X.STRONG_TERMS) & ~leadership),
            ("excluded_proxy_solicitation_logistics", says(X.PROXY_SOLICITATION) & ~acts),
            ("excluded_litigation_allegation_context", says(X.LITIGATION) & ~acts),
            ("excluded_generic_representative_definition", says(X.REPRESENTATIVE_DEFINITION) & ~acts),
            ("excluded_generic_term_without_people_context", ~specific & ~people),
        ],
        "included_employee_context",
    )


def target_aliases(name: Column) -> Column:
    """Sorted ways to write a target's name: normalized, without legal forms, and its one long word before a legal form."""
    normal = F.concat_ws(" ", F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    words = F.split(normal, " ")
    stripped = F.concat_ws(" ", F.filter(words, lambda w: ~w.isin(*X.TARGET_SUFFIXES)))
    lone = F.when((F.size(words) == 2) & F.element_at(words, -1).isin(*X.TARGET_SUFFIXES) & (F.length(words[0]) >= 5), words[0])
    return F.array_sort(F.array_distinct(F.filter(F.array(normal, stripped, lone), lambda a: F.length(a) >= 4)))


def party_aliases(name: Column) -> Column:
    """``target_aliases`` and the name's long words that are not generic; the longest first."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 5) & ~w.isin(*X.GENERIC_ENTITY_TOKENS))
    keyed = F.transform(F.array_union(target_aliases(name), words), lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda s: s["a"])


def names_party(text: Column, aliases: Column) -> Column:
    """Whether an alias stands in the normalized text as whole words."""
    normal = F.concat(F.lit(" "), F.concat_ws(" ", F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))), F.lit(" "))
    return F.exists(aliases, lambda a: normal.contains(F.concat(F.lit(" "), a, F.lit(" "))))


def confidence_tier(weight: Column, named: Column) -> Column:
    return F.when((weight >= 8) & named, "high").when(((weight >= 5) & named) | (weight >= 10), "medium").otherwise("low")


def legal_form(raw: Column) -> Column:
    """A stable label of a raw transaction form."""
    value = F.trim(F.coalesce(raw, F.lit("")))
    table = F.create_map(*(F.lit(v) for pair in X.LEGAL_FORMS.items() for v in pair))
    return F.when(value == "", "unknown").otherwise(F.coalesce(F.try_element_at(table, F.lower(value)), F.concat(F.lit("unmapped_sdc_form:"), value)))


def ai_category(qualifies: Column, joins: Column, acquihire: Column, licence: Column, form: Column) -> Column:
    return first_match(
        [
            ("unknown", ~qualifies & ~(joins | acquihire)),
            ("license_and_hire", licence),
            ("ai_assets_or_ip", form == "asset purchase (certain assets)"),
            ("acqui_hire_or_team", acquihire),
            ("strategic_or_minority_investment", form.isin("majority stock acquisition", "remaining-interest step acquisition")),
            ("ai_company_acquisition", form.isin("statutory merger", "asset purchase")),
        ],
        "ai_related_transaction",
    )


def talent_motive(joins: Column, acquihire: Column) -> Column:
    return F.when(acquihire, "documented_acqui_hire_language").when(joins, "documented_team_join_language").otherwise("not_documented_in_reviewed_sources")


def link_status(retrieved: Column, linked: Column) -> Column:
    """What became of a document: retrieved and about the target, retrieved and not, or never retrieved."""
    return F.when(~retrieved, "retrieval_failed").when(linked, "target_linked").otherwise("excluded_no_target_link")


def screened_out(rows: DataFrame, column: str, prefixes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` starts with none of the prefixes, one row with how many were dropped)."""
    hit = starts_with_any(F.col(column), [p.upper() for p in prefixes])
    return rows.where(~hit), rows.agg(F.count_if(hit).alias("excluded"))


def release_status(gate_passed: Column, corpus: Column) -> Column:
    """One release state of a report: its gate's pass; else the state of a corpus that blocks it; else a failure."""
    return first_match([("pass", gate_passed), ("fail", corpus.isin("failed_human_corpus_validation", "accepted_human_corpus_validation"))]).otherwise(corpus)


def retrieval_queue(probed: DataFrame, *, positive: Sequence[str], limit: int | None = None, **literals: str) -> DataFrame:
    """Probe-positive rows in the order of the probe's ranks, with literal columns; ``limit`` is the caller's."""
    queue = probed.where(F.col("probe_status").isin(*positive)).withColumns({k: F.lit(v) for k, v in literals.items()})
    return queue if limit is None else queue.limit(limit)


def manifest_rows(candidates: DataFrame, assessed: DataFrame, deal: str) -> DataFrame:
    """The frozen manifest: each candidate with its assessment, closing date and status; a deal that was never assessed says so.

    candidates: deal, closing_date, ...; assessed: deal, qualifies, distinct_terms, missingness_reason.
    """
    held = assessed.select(F.col(deal).alias("_d"), "qualifies", "distinct_terms", "missingness_reason")
    rows = candidates.join(held, F.col(deal) == F.col("_d"), "left")
    evidence = F.coalesce(F.nullif(F.concat_ws("; ", "distinct_terms"), F.lit("")), F.nullif("missingness_reason", F.lit("")), F.lit("assessment_failed"))
    return rows.withColumns(
        {
            "ai_relevance_evidence": evidence,
            "verification_status": F.when(F.col("_d").isNull(), "assessment_failed").when(F.col("qualifies"), "machine_verified_pending_human_review").otherwise("not_qualifying"),
            "deal_status": F.when(F.col("closing_date").isNull(), "unclear").otherwise("completed"),
            "closing_date": F.coalesce(F.col("closing_date").cast("string"), F.lit("unknown")),
        }
    ).drop("_d", "distinct_terms", "missingness_reason", "qualifies")
