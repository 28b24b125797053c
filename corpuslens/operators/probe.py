"""Which deals have transaction filings: probe outcomes, their evidence, and the orders retrieval follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import fixed as X
from corpuslens.functions.rules import event_window, first_match
from corpuslens.functions.text import distinctive_tokens


def named_in(text: Column, name: Column) -> Column:
    """Whether a distinctive word of the name stands in the text; false if the name has none."""
    words = F.concat(F.lit(" "), F.concat_ws(" ", F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))), F.lit(" "))
    return F.exists(distinctive_tokens(name), lambda w: words.contains(F.concat(F.lit(" "), w, F.lit(" "))))


def agreement_candidates(filings: DataFrame, deal: str, *, most: int = 3, days: int = 21) -> DataFrame:
    """Filings worth opening for an agreement, at most ``most`` a deal: registrations first, then reports near the announcement, the nearest in time first."""
    gap = F.abs(F.datediff("filed", "announced"))
    kind = F.when(F.col("form").isin(*X.REGISTRATION_FORMS), 0).when(F.col("form").isin(*X.REPORT_FORMS) & (gap <= days), 1)
    order = Window.partitionBy(deal).orderBy("kind", "gap", "accession")
    return filings.withColumns({"kind": kind, "gap": gap}).where("kind IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def probe(deals: DataFrame, filings: DataFrame, documents: DataFrame, *, forms: Sequence[str], proxy_forms: Sequence[str], announcement_forms: Sequence[str]) -> DataFrame:
    """One row a deal: its window, what was filed in it, the agreement found and the status these give.

    deals: deal_id, cik, announced, effective, target_name. filings: cik, accession, form, filed. documents: accession,
    document_type, is_primary, text. A deal without an announcement date has failed.
    """
    framed = deals.withColumn("w", event_window(F.col("announced"), F.col("effective")))
    keyed = filings.where(F.col("form").isin(*forms)).select(F.col("cik").alias("_cik"), "accession", "form", "filed")
    inside = framed.join(keyed, (F.col("cik") == F.col("_cik")) & F.col("filed").between(F.col("w.start"), F.col("w.end")))
    inside = inside.select("deal_id", "announced", "target_name", "accession", "form", "filed")
    ordered = F.array_sort(F.collect_list(F.struct("filed", "accession", "form")))
    per = inside.groupBy("deal_id").agg(
        F.count(F.lit(1)).alias("windowed_filings"), F.array_distinct(F.transform(ordered, lambda f: f["form"])).alias("forms"),
        F.bool_or(F.col("form").isin(*proxy_forms)).alias("has_proxy"), F.bool_or(F.col("form").isin(*announcement_forms)).alias("has_announcement"),
        F.min_by("accession", F.when(F.col("form").isin(*proxy_forms), F.struct("filed", "accession"))).alias("proxy_accession"),
    )
    exhibits = documents.withColumn("agreement", F.coalesce(F.upper("document_type").startswith("EX-2."), F.lit(False)))
    opened = agreement_candidates(inside, "deal_id").select("deal_id", "place", "accession", "target_name").join(exhibits, "accession")
    found = opened.groupBy("deal_id", "place", "accession").agg(
        F.array_sort(F.collect_list(F.when(F.col("agreement"), F.col("document_type")))).alias("types"), F.bool_or((F.col("agreement") | F.col("is_primary")) & named_in(F.col("text"), F.col("target_name"))).alias("named")
    )
    found = found.where(F.size("types") > 0)
    first = found.groupBy("deal_id").agg(F.min_by(F.struct(F.col("accession").alias("agreement_accession"), F.col("types").alias("agreement_exhibit_types"), F.col("named").alias("agreement_named")), "place").alias("a")).select("deal_id", "a.*")
    proxies = per.select(F.col("deal_id").alias("_deal"), "proxy_accession").join(documents.where("is_primary").select(F.col("accession").alias("_a"), "text"), F.col("proxy_accession") == F.col("_a"))
    proxies = proxies.join(deals.select("deal_id", "target_name"), F.col("_deal") == F.col("deal_id")).groupBy("_deal").agg(F.bool_or(named_in(F.col("text"), F.col("target_name"))).alias("proxy_named"))
    rows = framed.join(per, "deal_id", "left").join(first, "deal_id", "left").join(proxies, F.col("deal_id") == F.col("_deal"), "left")
    status = first_match(
        [
            ("probe_failed", F.col("announced").isNull()),
            ("agreement_exhibit", F.col("agreement_accession").isNotNull()),
            ("merger_proxy", F.coalesce("has_proxy", F.lit(False))),
            ("announcement_only", F.coalesce("has_announcement", F.lit(False))),
        ],
        "no_transaction_filing",
    )
    checked = F.col("probe_status").isin("agreement_exhibit", "merger_proxy")
    named = F.when(F.col("probe_status") == "agreement_exhibit", F.col("agreement_named")).otherwise(F.col("proxy_named"))
    hit = first_match([("not_checked", ~checked), ("no_distinctive_target_tokens", F.size(distinctive_tokens(F.col("target_name"))) == 0), ("yes", F.coalesce(named, F.lit(False)))], "no")
    out = rows.withColumn("probe_status", status).withColumn("target_name_hit", hit)
    return out.select("deal_id", "probe_status", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.coalesce("windowed_filings", F.lit(0)).alias("windowed_filings"), "forms", "agreement_accession", "agreement_exhibit_types", "target_name_hit", F.when(F.col("w.status") != "closing_observed", F.col("w.status")).otherwise("").alias("probe_note"))


def probe_rows(probed: DataFrame) -> DataFrame:
    """The printed form of probe results: lists joined, missing values blank, and on what the match rests."""
    basis = F.when(F.col("target_name_hit") == "yes", "machine_target_name_in_acquirer_filing").otherwise("machine_form_and_window_only")
    lists = {"probe_forms": F.concat_ws("; ", "forms"), "agreement_exhibit_types": F.concat_ws("; ", "agreement_exhibit_types"), "agreement_accession": F.coalesce("agreement_accession", F.lit("")), "windowed_filings": F.col("windowed_filings").cast("string"), "cik_confirmation_basis": basis}
    return probed.withColumns(lists).drop("forms")


def probe_rank(status: Column) -> Column:
    """Place of a probe status, the best first."""
    table = F.create_map(*(F.lit(v) for pair in X.PROBE_RANK.items() for v in pair))
    return F.coalesce(F.try_element_at(table, status), F.lit(len(X.PROBE_RANK)))


def by_probe_rank(rows: DataFrame, value: str, ident: str) -> DataFrame:
    """Best status first, then a named target, more filings, higher value, id."""
    return rows.orderBy(probe_rank(F.col("probe_status")), (F.col("target_name_hit") != "yes").asc(), F.desc("windowed_filings"), F.desc_nulls_last(value), ident)


def by_pool_order(rows: DataFrame, value: str, confidence: str, date: str, ident: str) -> DataFrame:
    """Highest value first, missing values last; then high confidence, earlier date, id."""
    return rows.orderBy(F.desc_nulls_last(value), (F.col(confidence) != "high").asc(), date, ident)


def retrieval_order(documents: DataFrame, filing: str, deal: str, *, documents_each: int = 6, filings_each: int = 12, filing_order: Sequence[str] = ("filed", "accession")) -> DataFrame:
    """Documents to fetch: exhibits by priority, then the primary document, then by name; so many a filing, of so many filings a deal."""
    kind = F.upper(F.coalesce("document_type", F.lit("")))
    priority = first_match([(str(k), kind.startswith(p)) for k, p in enumerate(X.EXHIBIT_PRIORITY)], str(len(X.EXHIBIT_PRIORITY))).cast("int")
    name = F.when(F.col("is_primary"), "").otherwise(F.col("document_name"))
    rows = documents.withColumns({"priority": priority, "place": F.row_number().over(Window.partitionBy(filing).orderBy(priority, name, "document_name"))})
    chosen = rows.select(deal, *dict.fromkeys([filing, *filing_order])).distinct().withColumn("filing_place", F.row_number().over(Window.partitionBy(deal).orderBy(*filing_order))).where(F.col("filing_place") <= filings_each)
    chosen = chosen.select(F.col(deal).alias("_d"), F.col(filing).alias("_f"), "filing_place")
    return rows.where(F.col("place") <= documents_each).join(chosen, (F.col(deal) == F.col("_d")) & (F.col(filing) == F.col("_f"))).drop("_d", "_f")


def retrieval_inventory(wanted: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Every wanted document with one terminal status: retrieved, empty or missing from the cache."""
    held = bodies.select(F.col(key).alias("_k"), "body").dropDuplicates(["_k"])
    rows = wanted.join(held, F.col(key) == F.col("_k"), "left")
    status = first_match([("missing_body", F.col("_k").isNull()), ("empty_body", F.trim(F.coalesce("body", F.lit(""))) == "")], "retrieved")
    return rows.withColumns({"status": status, "char_count": F.coalesce(F.length("body"), F.lit(0)), "content_sha256": F.when(F.col("_k").isNotNull(), F.sha2(F.coalesce("body", F.lit("")), 256))}).drop("_k", "body")
