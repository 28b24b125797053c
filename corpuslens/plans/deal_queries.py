"""Queries over deals and filings, and over reviews of them, drawn from the order tables by their keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.functions import fixed as X
from corpuslens.operators import architecture as A
from corpuslens.operators import corpus as C
from corpuslens.operators import eligibility as E
from corpuslens.operators import probe as P
from corpuslens.operators import reviews as V
from corpuslens.plans.registry import pick, query, quoted, sql_case, sql_list, sql_pick, table
from corpuslens.sources import registers as G

FORMS = ("8-K", "S-4", "425", "10-Q", "DEFM14A", "SC TO-T", "8-K/A")
PROXIES, ANNOUNCEMENTS = ("DEFM14A", "SC TO-T"), ("8-K", "8-K/A", "425")
WANTED = ("8-K", "8-K/A", "S-4", "425", "DEFM14A", "SC TO-T")
TYPES = ("EX-2.1", "8-K", "EX-99.1", "EX-10.2", "EX-2.2", "EX-23", "")
_DAY = "CAST(o_orderdate AS DATE)"
CLOSED_SQL = "(SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS closed FROM lineitem GROUP BY 1)"


def _closed(spark, d):
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("closed"))
    return table(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("announced", F.to_date("o_orderdate"))


_SCORES = "CASE form " + " ".join(f"WHEN {quoted(f)} THEN {n}" for f, n in X.FORM_SCORES.items()) + " ELSE 1 END"


@query(f"SELECT o_orderkey, l_linenumber, form, CAST(date_diff('day', announced, filed) AS INTEGER) AS days_from_announcement, CAST(date_diff('day', closed, filed) AS INTEGER) AS days_from_effective, CAST({_SCORES} AS INTEGER) AS priority FROM (SELECT o_orderkey, l_linenumber, {sql_pick(FORMS, 'o_orderkey + l_linenumber')} AS form, {_DAY} AS announced, closed, CAST(l_shipdate AS DATE) AS filed FROM lineitem l JOIN orders ON l.l_orderkey = o_orderkey JOIN {CLOSED_SQL} c ON c.l_orderkey = o_orderkey)")
def filing_links(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.to_date("l_shipdate").alias("filed"))
    rows = lines.join(_closed(spark, d).select("o_orderkey", "announced", "closed"), F.col("k") == F.col("o_orderkey")).withColumn("form", pick(FORMS, F.col("o_orderkey") + F.col("l_linenumber")))
    return E.filing_links(rows, "filed", "announced", "closed", "form").select("o_orderkey", "l_linenumber", "form", "days_from_announcement", "days_from_effective", "priority")


def _probe_inputs(spark, d):
    k = F.col("o_orderkey")
    names = table(spark, d, "part").select("p_partkey", "p_name")
    n = names.count()
    deals = _closed(spark, d).withColumn("p", F.pmod(k, F.lit(n))).join(names, F.col("p") == F.col("p_partkey"))
    deals = deals.select(k.alias("deal_id"), F.col("o_custkey").alias("cik"), F.when(k % 50 != 0, F.col("announced")).alias("announced"), F.col("closed").alias("effective"), F.col("p_name").alias("target_name"))
    filings = table(spark, d, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").cast("string").alias("accession"), pick(FORMS, k).alias("form"), F.to_date("o_orderdate").alias("filed"))
    lines = table(spark, d, "lineitem").join(names, F.col("l_partkey") == F.col("p_partkey"))
    documents = lines.select(F.col("l_orderkey").cast("string").alias("accession"), pick(TYPES, F.col("l_orderkey") + F.col("l_linenumber")).alias("document_type"), (F.col("l_linenumber") == 1).alias("is_primary"), F.col("p_name").alias("text"))
    return deals, filings, documents


PROBE_SQL = f"""(WITH n AS (SELECT count(*) AS n FROM part), o AS (SELECT o_orderkey AS deal_id, o_custkey AS cik, CASE WHEN o_orderkey % 50 <> 0 THEN {_DAY} END AS announced, closed AS effective, p_name AS target_name FROM orders LEFT JOIN {CLOSED_SQL} ON l_orderkey = o_orderkey, n, part WHERE p_partkey = o_orderkey % n.n),
    w AS (SELECT *, announced - 30 AS s, CASE WHEN effective >= announced THEN effective + 30 ELSE announced + 365 END AS e, CASE WHEN effective >= announced THEN '' WHEN effective IS NOT NULL THEN 'invalid_effective_date' ELSE 'closing_missing' END AS note, list_filter(regexp_extract_all(lower(target_name), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({sql_list(X.PROBE_GENERIC_TOKENS)}, x)) AS tk FROM o),
    f AS (SELECT o_custkey AS cik, CAST(o_orderkey AS VARCHAR) AS accession, {sql_pick(FORMS, 'o_orderkey')} AS form, {_DAY} AS filed FROM orders), i AS (SELECT deal_id, announced, tk, f.* FROM w JOIN f ON w.cik = f.cik AND filed BETWEEN s AND e AND list_contains({sql_list(WANTED)}, form)),
    per AS (SELECT deal_id, count(*) AS n, bool_or(list_contains({sql_list(PROXIES)}, form)) AS px, bool_or(list_contains({sql_list(ANNOUNCEMENTS)}, form)) AS an, first(accession ORDER BY filed, accession) FILTER (WHERE list_contains({sql_list(PROXIES)}, form)) AS pa FROM i GROUP BY 1),
    c AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY kind, gap, accession) AS place FROM (SELECT *, abs(date_diff('day', announced, filed)) AS gap, CASE WHEN form IN ('S-4', 'S-4/A', '424B3') THEN 0 WHEN form IN ('8-K', '8-K/A') AND abs(date_diff('day', announced, filed)) <= 21 THEN 1 END AS kind FROM i) WHERE kind IS NOT NULL),
    d AS (SELECT CAST(l_orderkey AS VARCHAR) AS accession, {sql_pick(TYPES, 'l_orderkey + l_linenumber')} AS t, l_linenumber = 1 AS pr, string_split(lower(p_name), ' ') AS words FROM lineitem JOIN part ON l_partkey = p_partkey),
    g AS (SELECT deal_id, place, c.accession, bool_or(t LIKE 'EX-2.%') AS has, bool_or((t LIKE 'EX-2.%' OR pr) AND len(list_intersect(words, tk)) > 0) AS named FROM c JOIN d ON c.accession = d.accession WHERE place <= 3 GROUP BY ALL), a AS (SELECT deal_id, first(accession ORDER BY place) AS acc, first(named ORDER BY place) AS named FROM g WHERE has GROUP BY 1),
    p AS (SELECT per.deal_id, bool_or(len(list_intersect(words, tk)) > 0) AS named FROM per JOIN w USING (deal_id) JOIN d ON pa = d.accession WHERE pr GROUP BY 1),
    r AS (SELECT w.*, coalesce(n, 0) AS n, acc, a.named AS an_, p.named AS pn_, CASE WHEN announced IS NULL THEN 'probe_failed' WHEN acc IS NOT NULL THEN 'agreement_exhibit' WHEN px THEN 'merger_proxy' WHEN an THEN 'announcement_only' ELSE 'no_transaction_filing' END AS st FROM w LEFT JOIN per USING (deal_id) LEFT JOIN a USING (deal_id) LEFT JOIN p USING (deal_id))
    SELECT deal_id, st AS probe_status, n AS windowed_filings, acc AS agreement_accession, CASE WHEN st NOT IN ('agreement_exhibit', 'merger_proxy') THEN 'not_checked' WHEN len(tk) = 0 THEN 'no_distinctive_target_tokens' WHEN coalesce(CASE WHEN st = 'agreement_exhibit' THEN an_ ELSE pn_ END, false) THEN 'yes' ELSE 'no' END AS target_name_hit, note AS probe_note FROM r)"""


def _probed(spark, d):
    return P.probe(*_probe_inputs(spark, d), forms=WANTED, proxy_forms=PROXIES, announcement_forms=ANNOUNCEMENTS)


@query(f"SELECT deal_id, probe_status, windowed_filings, coalesce(agreement_accession, '') AS agreement_accession, target_name_hit, CASE WHEN target_name_hit = 'yes' THEN 'machine_target_name_in_acquirer_filing' ELSE 'machine_form_and_window_only' END AS cik_confirmation_basis, probe_note FROM {PROBE_SQL}")
def disclosure_probe(spark, d):
    rows = P.probe_rows(_probed(spark, d))
    return rows.select("deal_id", "probe_status", F.col("windowed_filings").cast("long").alias("windowed_filings"), "agreement_accession", "target_name_hit", "cik_confirmation_basis", "probe_note")


@query(f"SELECT deal_id, probe_status, 'machine_probe_confirmed' AS cik_match_confidence, 'selected' AS pilot_status FROM {PROBE_SQL} WHERE probe_status IN ('agreement_exhibit', 'merger_proxy') ORDER BY CASE probe_status WHEN 'agreement_exhibit' THEN 0 ELSE 1 END, target_name_hit <> 'yes', windowed_filings DESC, -deal_id DESC, deal_id LIMIT 300")
def retrieval_queue(spark, d):
    ranked = P.by_probe_rank(_probed(spark, d).withColumn("value", -F.col("deal_id")), "value", "deal_id")
    return E.retrieval_queue(ranked, positive=("agreement_exhibit", "merger_proxy"), limit=300, cik_match_confidence="machine_probe_confirmed", pilot_status="selected").select("deal_id", "probe_status", "cik_match_confidence", "pilot_status")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END DESC NULLS LAST, o_orderpriority <> '1-URGENT', o_orderdate, o_orderkey LIMIT 200")
def pool_order(spark, d):
    rows = table(spark, d, "orders").withColumns({"value": F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice")), "confidence": F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low")})
    return P.by_pool_order(rows, "value", "confidence", "o_orderdate", "o_orderkey").limit(200).select("o_orderkey", "o_totalprice")


@query(f"""WITH d AS (SELECT o_custkey, l_orderkey, {_DAY} AS filed, l_linenumber, l_suppkey, {sql_pick(TYPES, 'l_orderkey + l_linenumber')} AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN t LIKE 'EX-99%' THEN 0 WHEN t LIKE 'EX-2%' THEN 1 WHEN t LIKE 'EX-10%' THEN 2 ELSE 3 END, CASE WHEN l_linenumber = 1 THEN '' ELSE nm END, nm) AS place FROM (SELECT *, 'd' || l_linenumber || '-' || l_suppkey AS nm FROM d)),
    f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY filed, l_orderkey) AS fp FROM (SELECT DISTINCT o_custkey, l_orderkey, filed FROM d)) SELECT p.l_orderkey, nm AS document_name, CAST(place AS INTEGER) AS place, CAST(fp AS INTEGER) AS filing_place FROM p JOIN f ON p.l_orderkey = f.l_orderkey WHERE place <= 6 AND fp <= 12""")
def retrieval_plan(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("filed"))
    rows = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("o_custkey", "l_orderkey", "filed", pick(TYPES, F.col("l_orderkey") + F.col("l_linenumber")).alias("document_type"), (F.col("l_linenumber") == 1).alias("is_primary"), F.concat(F.lit("d"), F.col("l_linenumber"), F.lit("-"), F.col("l_suppkey")).alias("document_name"))
    return P.retrieval_order(rows, "l_orderkey", "o_custkey", filing_order=("filed", "l_orderkey")).select("l_orderkey", "document_name", "place", "filing_place")


@query("SELECT o_orderkey, CASE WHEN d.doc_id IS NULL THEN 'missing_body' WHEN trim(coalesce(text, '')) = '' THEN 'empty_body' ELSE 'retrieved' END AS status, CAST(coalesce(length(text), 0) AS INTEGER) AS char_count, CASE WHEN d.doc_id IS NOT NULL THEN sha256(coalesce(text, '')) END AS content_sha256 FROM orders LEFT JOIN documents d ON o_orderkey = d.doc_id")
def retrieval_inventory(spark, d):
    bodies = table(spark, d, "documents").select(F.col("doc_id").alias("o_orderkey"), F.col("text").alias("body"))
    return P.retrieval_inventory(table(spark, d, "orders").select("o_orderkey"), bodies, "o_orderkey")


_DECIDED = {"cik": "o_orderstatus", "scope": "o_orderpriority", "pilot": "o_custkey"}


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'T' || o_custkey END AS approved_target FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '5%' AND o_custkey % 2 = 0")
def approved_deals(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", " Confirmed").otherwise("open").alias("cik"), F.when(~F.col("o_orderpriority").startswith("5"), "in_scope").otherwise("").alias("scope"), F.when(F.col("o_custkey") % 2 == 0, "SELECTED").alias("pilot"),
        F.when(k % 4 == 0, "confirmed").otherwise("pending").alias("target_status"), F.concat(F.lit("T"), F.col("o_custkey")).alias("target_id"),
    )
    return E.approved_deals(rows, {"cik": "confirmed", "scope": "in_scope", "pilot": "selected"}, target_status="target_status", target_id="target_id").select("o_orderkey", "approved_target")


@query("SELECT CAST(c_custkey AS VARCHAR) AS deal_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def selected_roster(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.lit(" "), F.col("c_custkey")).alias("deal_id"), F.when(F.col("c_mktsegment") == "BUILDING", "Selected").alias("status"))
    return E.selected_roster(rows, "deal_id", "status").select("deal_id")


CODES = ("7370", "7371", "7372", "3674", "2834", "6021")
_CODE = sql_pick(CODES, "o_orderkey")
_VALUES = ("1,250.5", "", "n/a", "abc", "300", "NP")
_STATUSES = ("Public", "Priv.", "", "public.", "Sub.")


@query(f"""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN 'twice' ELSE CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dt, {_CODE} AS code, CASE WHEN o_custkey % 9 > 0 THEN CAST(o_custkey AS VARCHAR) ELSE ' ' END AS cik, CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'medium' ELSE 'low' END AS conf, {sql_pick(_STATUSES, 'o_orderkey')} AS st, {sql_pick(_VALUES, 'o_orderkey')} AS v FROM orders)
    SELECT o_orderkey, CASE WHEN id = '' THEN 'excluded_missing_deal_id' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'excluded_duplicate_deal_id' WHEN o_orderkey % 31 = 0 THEN 'excluded_prior_pilot_candidate' WHEN dt = 'soon' THEN 'excluded_invalid_announcement_date' WHEN code NOT IN ('7370', '7371', '7372', '3674') THEN 'excluded_outside_target_sic_screen' WHEN trim(cik) = '' THEN 'excluded_missing_acquirer_cik_candidate' WHEN conf = 'low' THEN 'excluded_low_or_unresolved_acquirer_match' ELSE 'eligible_preview_candidate' END AS reason,
    CASE WHEN st LIKE '_ublic%' THEN 'public' WHEN st <> '' THEN 'non_public' ELSE 'unknown' END || '|' || CASE WHEN v IN ('', 'n/a', 'NP') THEN 'value_missing' WHEN v = 'abc' THEN 'value_invalid' ELSE 'value_reported' END AS stratum FROM b""")
def preview_reasons(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 97 == 0, "").when(k % 89 == 0, "twice").otherwise(k.cast("string")).alias("deal_id"), F.when(k % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), pick(CODES, k).alias("code"),
        F.when(F.col("o_custkey") % 9 > 0, F.col("o_custkey").cast("string")).otherwise(" ").alias("cik"), F.when(F.col("o_orderstatus") == "F", "High").when(F.col("o_orderstatus") == "O", "medium").otherwise("low").alias("confidence"), pick(_STATUSES, k).alias("status"), pick(_VALUES, k).alias("value"),
    )
    prior = table(spark, d, "orders").where("o_orderkey % 31 = 0").select(F.col("o_orderkey").cast("string").alias("deal_id"))
    out = E.preview_eligibility(rows, "deal_id", prior, date="date", code="code", codes=CODES[:4], registrant="cik", confidence="confidence")
    return out.select("o_orderkey", "reason", F.concat_ws("|", E.public_group(F.col("status")), E.value_group(F.col("value"))).alias("stratum"))


# Coded values by attribute, drawn by the customer's key.
CODED = {
    "legal_transaction_form": ("merger", "asset purchase", "unknown"),
    "scope_and_control": ("control_transferred", "control_of_purchased_assets_only|business_unit_assets", "unknown", "licence_only", ""),
    "ip_treatment": ("licensed", "transferred"),
    "business_product_continuity": ("discontinued", "continued", "unknown"),
    "workforce_movement": ("named_founder|team", "team", ""),
    "talent_motive_explicit": ("yes", "no", "unknown", "perhaps"),
    "talent_salience_signal": ("yes", "no"),
}
BASES, KINDS = ("direct_passage", "inferred_from_legal_form", "unknown"), ("verbatim", "paraphrase")


def _register(spark, d):
    k = F.col("c_custkey")
    rows = [F.struct(F.lit(a).alias("attribute"), pick(CODED[a], F.floor(k / (n + 1)) + n).alias("machine_value"), pick(BASES, k + n).alias("evidence_basis"), F.lit(n).alias("n")) for n, a in enumerate(X.ATTRIBUTES)]
    long = table(spark, d, "customer").select(k.cast("string").alias("deal_id"), k, F.inline(F.array(*rows))).where((k + F.col("n")) % 23 > 0)
    status = F.when(F.col("machine_value") == "unknown", pick(("unknown", "direct"), k)).otherwise("direct")
    url = pick(("https://a.example.org/d", "http://a.example.org/d", ""), k)
    return long.select("deal_id", "attribute", "machine_value", "evidence_basis", status.alias("evidence_status"), pick(KINDS, F.floor(k / 2)).alias("excerpt_kind"), pick(("d1", "", "d2"), F.floor(k / 3)).alias("document_id"), url.alias("source_url"), pick(("some words", ""), F.floor(k / 5)).alias("evidence_excerpt"))


REGISTER_SQL = "(" + " UNION ALL ".join(
    f"SELECT CAST(c_custkey AS VARCHAR) AS deal_id, c_custkey AS k, '{a}' AS attribute, {sql_pick(CODED[a], f'c_custkey // {n + 1} + {n}')} AS v, {sql_pick(BASES, f'c_custkey + {n}')} AS basis, {sql_pick(KINDS, 'c_custkey // 2')} AS kind, {sql_pick(('d1', '', 'd2'), 'c_custkey // 3')} AS doc, {sql_pick(('https://a.example.org/d', 'http://a.example.org/d', ''), 'c_custkey')} AS url, {sql_pick(('some words', ''), 'c_custkey // 5')} AS ex FROM customer WHERE (c_custkey + {n}) % 23 > 0"
    for n, a in enumerate(X.ATTRIBUTES)
) + ")"
_KNOWN = "(v <> 'unknown' AND basis <> 'unknown')"
_RULES = [
    ("missing_required", "trim(v) = ''"), ("claim_not_verbatim", f"{_KNOWN} AND kind <> 'verbatim'"), ("claim_without_document", f"{_KNOWN} AND doc = ''"), ("claim_without_source", f"{_KNOWN} AND url NOT LIKE 'https://%'"), ("claim_without_excerpt", f"{_KNOWN} AND ex = ''"),
    ("unknown_value_with_status", "v = 'unknown' AND k % 2 = 1"), ("talent_not_yes_no_unknown", "attribute IN ('talent_motive_explicit', 'talent_salience_signal') AND v NOT IN ('yes', 'no', 'unknown')"),
]


@query(f"WITH r AS {REGISTER_SQL} SELECT deal_id, attribute, unnest(list_filter([" + ", ".join(f"CASE WHEN {h} THEN '{n}' END" for n, h in _RULES) + f"], lambda x: x IS NOT NULL)) AS rule FROM r UNION ALL SELECT d.deal_id, a, 'missing_attribute' FROM (SELECT DISTINCT deal_id FROM r) d, (SELECT unnest({sql_list(X.ATTRIBUTES)}) AS a) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.deal_id = d.deal_id AND r.attribute = a)")
def register_violations(spark, d):
    return A.register_violations(_register(spark, d))


_SCOPE, _WORK = "list_filter(string_split(coalesce(scope_and_control, ''), '|'), lambda x: x <> '')", "list_filter(string_split(coalesce(workforce_movement, ''), '|'), lambda x: x <> '')"
_MOVED = f"len(list_intersect({_SCOPE}, ['control_transferred', 'control_of_purchased_assets_only'])) > 0"
_BASE = f"CASE WHEN list_contains({_SCOPE}, 'business_unit_assets') THEN 'asset_acquisition' ELSE 'full_acquisition' END"
_ARCH = f"""CASE WHEN len({_SCOPE}) = 0 OR list_distinct({_SCOPE}) = ['unknown'] THEN ['unknown', 'high'] WHEN NOT {_MOVED} AND ip_treatment = 'licensed' AND len({_WORK}) > 0 THEN ['hire_and_license; reverse_acquihire', 'medium'] WHEN NOT {_MOVED} THEN ['mixed', 'high']
    WHEN talent_motive_explicit = 'yes' AND business_product_continuity = 'discontinued' THEN ['traditional_acquihire', 'low'] WHEN talent_motive_explicit = 'yes' THEN [{_BASE} || '; acquisition_with_talent_emphasis', 'medium'] WHEN talent_salience_signal = 'yes' THEN [{_BASE} || '; acquisition_with_talent_salience', 'medium']
    WHEN len(list_filter({_WORK}, lambda x: starts_with(x, 'named_'))) > 0 OR talent_motive_explicit = 'unknown' THEN [{_BASE}, 'medium'] ELSE [{_BASE}, 'low'] END"""
_WIDE = f"(SELECT deal_id, {', '.join(f'''max(v) FILTER (WHERE attribute = '{a}') AS {a}''' for a in X.ATTRIBUTES)}, count(*) FILTER (WHERE basis = 'direct_passage') AS direct_evidence_count, count(*) FILTER (WHERE basis = 'inferred_from_legal_form') AS inferred_evidence_count, count(*) FILTER (WHERE v = 'unknown') AS unknown_attribute_count, string_agg('arch_' || substr(sha256(deal_id || ':' || attribute), 1, 12), '; ' ORDER BY list_position({sql_list(X.ATTRIBUTES)}, attribute)) AS evidence_ids FROM {REGISTER_SQL} GROUP BY 1)"


@query(f"SELECT *, {_ARCH}[1] AS machine_suggested_archetypes, {_ARCH}[2] AS archetype_ambiguity FROM {_WIDE}")
def deal_architecture(spark, d):
    return A.deal_architecture(_register(spark, d))


_TOPICS_SQL = "(SELECT CAST(label * 3 AS VARCHAR) AS deal_id, vec_id % 4 AS topic_id, vec_id, abs(embedding[1])::DOUBLE AS w FROM embeddings)"


@query(f"""WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS deal_id, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey // 2 AS VARCHAR) ELSE '' END AS other_id FROM customer WHERE c_nationkey < 20), t AS (SELECT deal_id, topic_id, round(sum(w), 4) AS normalized_weight, first(vec_id ORDER BY w DESC, vec_id) FILTER (WHERE vec_id % 3 = 0) AS ex FROM {_TOPICS_SQL} GROUP BY 1, 2)
    SELECT a.deal_id, topic_id, normalized_weight, ex AS example_passage_id, CASE WHEN t.deal_id IS NULL THEN 'deal_absent_from_topic_matrix' ELSE '' END AS zero_state FROM a LEFT JOIN t ON t.deal_id = CASE WHEN other_id = '' THEN a.deal_id ELSE other_id END""")
def architecture_topics(spark, d):
    assigned = table(spark, d, "embeddings").select((F.col("label") * 3).cast("string").alias("deal_id"), (F.col("vec_id") % 4).alias("topic_id"), F.col("vec_id").alias("passage_id"), F.abs(F.col("embedding")[0]).cast("double").alias("topic_weight"), (F.col("vec_id") % 3 == 0).alias("primary_topic"))
    topics = assigned.groupBy("deal_id", "topic_id").agg(F.round(F.sum("topic_weight"), 4).alias("normalized_weight"))
    return A.architecture_topics(_architecture(spark, d), topics, assigned).select("deal_id", "topic_id", "normalized_weight", "example_passage_id", "zero_state")


def _architecture(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").where("c_nationkey < 20").select(k.cast("string").alias("deal_id"), F.when(k % 2 == 0, F.floor(k / 2).cast("string")).otherwise("").alias("other_id"))


@query("""WITH a AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey // 2 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS deal_id FROM customer WHERE c_nationkey < 20), t AS (SELECT DISTINCT CAST(label * 3 AS VARCHAR) AS deal_id FROM embeddings)
    SELECT deal_id, 'without_topics' AS side FROM a ANTI JOIN t USING (deal_id) UNION ALL SELECT deal_id, 'without_architecture' FROM t ANTI JOIN a USING (deal_id)""")
def architecture_unmatched(spark, d):
    topics = table(spark, d, "embeddings").select((F.col("label") * 3).cast("string").alias("deal_id"))
    return A.unmatched(_architecture(spark, d), topics)


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'kept' WHEN q <> '' THEN 'repaired' ELSE 'withdrawn' END AS repair, CASE WHEN o_orderkey % 2 = 0 THEN 'said' WHEN q <> '' THEN trim(q) ELSE '' END AS evidence_excerpt, CASE WHEN o_orderkey % 2 = 1 AND coalesce(q, '') = '' THEN 'unknown' ELSE 'yes' END AS machine_value
    FROM (SELECT o_orderkey, regexp_extract(coalesce(text, ''), 'license[^.]*\.') AS q FROM orders LEFT JOIN documents ON doc_id = o_orderkey)""")
def repaired_quotes(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", k.alias("document_id"), F.when(k % 2 == 0, "verbatim").otherwise("paraphrase").alias("excerpt_kind"), F.lit("said").alias("evidence_excerpt"), F.lit("yes").alias("machine_value"), F.lit("direct").alias("evidence_status"))
    bodies = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("body"))
    return A.repaired_quotes(rows, bodies, F.lit(r"license[^.]*\.")).select("o_orderkey", "repair", "evidence_excerpt", "machine_value")


_Z = "1.959963984540054"
_LOW = f"greatest(0, (r + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(r * (1 - r) / n + {_Z} * {_Z} / (4.0 * n * n))) / (1 + {_Z} * {_Z} / n))"


def _labelled(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rows.withColumn("decision", F.when(F.col("doc_id") % 3 > 0, "included").otherwise("excluded"))


LABELLED_SQL = "(SELECT *, CASE WHEN doc_id % 3 > 0 THEN 'included' ELSE 'excluded' END AS decision FROM labels JOIN documents USING (doc_id))"
_SCORES_SQL = f"(SELECT decision, CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'overall' END AS scope, coalesce(source, lang, 'all') AS level, count(*) FILTER (WHERE quality = 1) AS successes, count(*) AS total FROM {LABELLED_SQL} GROUP BY GROUPING SETS ((decision), (decision, source), (decision, lang)))"


@query(f"SELECT decision, scope, level, successes, total, round({_LOW}, 6) AS low FROM (SELECT *, successes * 1.0::DOUBLE / total AS r, total AS n FROM {_SCORES_SQL})")
def audit_scores(spark, d):
    return V.label_scores(_labelled(spark, d), "decision", F.col("quality") == 1, ["source", "lang"]).select("decision", "scope", "level", "successes", "total", F.round("low", 6).alias("low"))


@query(f"SELECT round(i, 6) AS included_rate, round(x, 6) AS excluded_rate, i >= 0.9 AS included_passes, x < 0.05 AS excluded_passes, CASE WHEN i >= 0.9 AND x < 0.05 THEN 'pass' ELSE 'fail' END AS gate_status FROM (SELECT avg(quality) FILTER (WHERE decision = 'included') AS i, avg(quality) FILTER (WHERE decision = 'excluded') AS x FROM {LABELLED_SQL})")
def audit_gate(spark, d):
    scores = V.label_scores(_labelled(spark, d), "decision", F.col("quality") == 1, ["source"])
    return V.audit_gate(scores, "decision").withColumns({"included_rate": F.round("included_rate", 6), "excluded_rate": F.round("excluded_rate", 6)})


def _codes(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("source", F.when(k % 10 < 8, "fit").when(k % 10 == 8, "partial").otherwise("not_fit").alias("one"), F.when(k % 7 == 0, "partial").when(k % 10 < 8, "fit").otherwise("not_fit").alias("two"))


_CODES_SQL = "(SELECT source, CASE WHEN doc_id % 10 < 8 THEN 'fit' WHEN doc_id % 10 = 8 THEN 'partial' ELSE 'not_fit' END AS a, CASE WHEN doc_id % 7 = 0 THEN 'partial' WHEN doc_id % 10 < 8 THEN 'fit' ELSE 'not_fit' END AS b FROM documents)"
_AGREE_SQL = f"(SELECT source, count(*) AS item_count, avg((a = b)::INTEGER) AS po, {', '.join(f'''avg((a = '{c}')::INTEGER) AS a{n}, avg((b = '{c}')::INTEGER) AS b{n}''' for n, c in enumerate(V.FIT_CODES))} FROM {_CODES_SQL} GROUP BY 1)"
_PE, _GE = "(a0 * b0 + a1 * b1 + a2 * b2)", "(((a0 + b0) / 2 * (1 - (a0 + b0) / 2) + (a1 + b1) / 2 * (1 - (a1 + b1) / 2) + (a2 + b2) / 2 * (1 - (a2 + b2) / 2)) / 2)"
_KAPPA, _AC1 = f"((po - {_PE}) / (1 - {_PE}))", f"((po - {_GE}) / (1 - {_GE}))"


@query(f"SELECT source, item_count, round(po, 6) AS exact_agreement, round((a0 + b0) / 2, 6) AS pooled_fit, round(CASE WHEN abs(1 - {_PE}) > 1e-12 THEN {_KAPPA} END, 6) AS cohen_kappa, round({_AC1}, 6) AS gwet_ac1, CASE WHEN abs(1 - {_PE}) > 1e-12 THEN 'cohen_kappa' ELSE 'gwet_ac1' END AS metric_used, CASE WHEN (a0 + b0) / 2 >= 0.8 AND po >= 0.8 AND CASE WHEN abs(1 - {_PE}) > 1e-12 THEN {_KAPPA} ELSE {_AC1} END >= 0.7 THEN 'pass' ELSE 'fail' END AS gate_status FROM {_AGREE_SQL}")
def topic_review_scores(spark, d):
    out = V.topic_gate(V.topic_scores(_codes(spark, d), "source", "one", "two"))
    return out.select("source", "item_count", *(F.round(c, 6).alias(c) for c in ("exact_agreement", "pooled_fit", "cohen_kappa", "gwet_ac1")), "metric_used", "gate_status")


@query("""SELECT 'item_' || substr(sha256('7:' || lang || ':' || doc_id), 1, 12) AS item_id, 'theme_' || substr(sha256('7:' || lang), 1, 8) AS blind_topic_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('7:topic-review:' || lang || ':' || doc_id)) AS INTEGER) AS item_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY fresh DESC, n_chars DESC, doc_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1 AS fresh FROM documents WHERE doc_id % 2 = 0)) WHERE place <= 10""")
def topic_review_packet(spark, d):
    rows = table(spark, d, "documents").withColumn("primary_topic", F.col("doc_id") % 2 == 0)
    return V.topic_packet(rows, seed=7, topic="lang", family="source", weight="n_chars", ident="doc_id", public=[])[0]


@query("""SELECT o.o_orderkey AS deal_id, 'u' || o.o_custkey AS url, CASE WHEN c.c_custkey IS NULL THEN 'source_not_retrieved' WHEN o.o_orderkey % 3 > 0 AND NOT c.inc THEN 'positive_source_excluded' WHEN o.o_orderkey % 3 > 0 AND coalesce(n, 0) = 0 THEN 'positive_source_has_no_qualifying_passage' ELSE 'pass' END AS validation_status, coalesce(n, 0) AS qualifying_passages
    FROM orders o LEFT JOIN (SELECT c_custkey, c_custkey % 4 > 0 AS inc FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_orderkey = o.o_orderkey AND c.c_custkey IS NOT NULL""")
def source_recall(spark, d):
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(k.alias("deal_id"), F.concat(F.lit("u"), F.col("o_custkey")).alias("url"), F.when(k % 3 > 0, "pay").otherwise("no_terms").alias("code"), "o_custkey")
    held = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", (F.col("c_custkey") % 4 > 0).alias("included"))
    documents = orders.join(held, F.col("o_custkey") == F.col("c_custkey")).select("deal_id", "url", F.col("c_custkey").cast("string").alias("document_id"), "included")
    passages = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o")).join(documents.select("deal_id", "document_id"), F.col("o") == F.col("deal_id")).select("deal_id", "document_id")
    return V.source_recall(orders.drop("o_custkey"), documents, passages).select("deal_id", "url", "validation_status", "qualifying_passages")


_STAGES = ("reviewed", "pending", "odd")


@query(f"""WITH r AS (SELECT o_orderkey AS k, {sql_pick(('complete', 'pending', 'strange'), 'o_orderkey')} AS o, {sql_pick(_STAGES, 'o_orderkey // 3')} AS s, CASE WHEN o_orderkey % 5 > 0 THEN 'x' ELSE '' END AS f, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'u' || (o_custkey % 50) END AS u, CASE WHEN o_orderkey % 61 = 0 THEN -1 ELSE o_orderkey END AS id FROM orders)
    SELECT id AS deal_id, unnest(list_filter([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate_key' END, CASE WHEN o NOT IN ('complete', 'pending') THEN 'invalid_overall' END, CASE WHEN s NOT IN ('reviewed', 'pending') THEN 'invalid_stage' END, CASE WHEN o = 'complete' AND s <> 'reviewed' THEN 'complete_with_open_stage' END, CASE WHEN o = 'complete' AND f = '' THEN 'complete_without_finding' END, CASE WHEN o = 'complete' AND u = '' THEN 'complete_without_source' END, CASE WHEN o = 'complete' AND u <> '' AND NOT (id = k AND CAST(substr(u, 2) AS INTEGER) < 25) THEN 'source_not_retrieved' END], lambda x: x IS NOT NULL)) AS rule FROM r""")
def coding_violations(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.when(k % 61 == 0, -1).otherwise(k).cast("string").alias("deal_id"), pick(("complete", "pending", "strange"), k).alias("overall"), pick(_STAGES, F.floor(k / 3)).alias("stage"), F.when(k % 5 > 0, "x").otherwise("").alias("finding"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("u"), F.col("o_custkey") % 50)).alias("source"))
    retrieved = table(spark, d, "orders").where("o_custkey % 50 < 25 AND o_orderkey % 61 > 0").select(k.cast("string").alias("deal_id"), F.concat(F.lit("u"), F.col("o_custkey") % 50).alias("url"))
    out = V.coding_violations(rows, retrieved, key="deal_id", stages=["stage"], stage_values=["reviewed", "pending"], done_stage=["reviewed"], overall="overall", overall_values=["complete", "pending"], done_overall=["complete"], required=["finding", "source"], source="source")
    return out.select(F.col("deal_id").cast("long").alias("deal_id"), "rule")


@query("""SELECT c_custkey, coalesce(f, 0) AS filings, coalesce(v, 0) AS documents, CASE WHEN m IS NULL THEN 'pending' ELSE m END AS review_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS f, count(DISTINCT o_orderdate) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT c_custkey AS k, lower(c_mktsegment) AS m FROM customer WHERE c_custkey % 3 = 0) ON k = c_custkey""")
def audit_rows(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("filings"), F.count_distinct("o_orderdate").alias("documents"))
    coding = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.lower("c_mktsegment").alias("review_status"))
    return V.audit_rows(table(spark, d, "customer").select("c_custkey"), counts, coding, "c_custkey")


@query("SELECT c_custkey, score, CAST(CASE WHEN place <= 40 THEN place END AS INTEGER) AS rank, CASE WHEN place <= 40 THEN 'selected_candidate' ELSE 'reserve_candidate' END AS selection_status FROM (SELECT c_custkey, c_nationkey % 4 AS score, row_number() OVER (ORDER BY c_nationkey % 4 DESC, sha256('preflight:' || c_custkey), c_custkey) AS place FROM customer)")
def candidate_ranks(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 4).alias("score"))
    return V.ranked_candidates(rows, "c_custkey", "score", seed="preflight", chosen=40)


PATTERNS = (("anvil", 5), ("red", 3), (r"s(?:mall|teel)", 2))
_SCORE = " + ".join(f"CASE WHEN regexp_matches(p_name, '{p}', 'i') THEN {w} ELSE 0 END" for p, w in PATTERNS)


@query(f"SELECT p_name, min(p_brand) AS p_brand, CAST(max({_SCORE}) AS INTEGER) AS score FROM part WHERE 1990 + p_size BETWEEN 1995 AND 2025 AND {_SCORE} > 0 GROUP BY 1")
def name_candidates(spark, d):
    rows = table(spark, d, "part").select("p_name", "p_brand", F.make_date(F.lit(1990) + F.col("p_size"), F.lit(1), F.lit(1)).alias("date"))
    return G.scored_candidates(rows, ident="p_name", name="p_name", date="date", file="p_brand", patterns=PATTERNS, first_year=1995, last_year=2025).select("p_name", "p_brand", "score")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def approved_sources(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Approved ").otherwise("draft").alias("review_status"), F.lit("https://a.example.org/").alias("url"), F.lit("press").alias("source_class"), F.lit("words").alias("excerpt"))
    return G.approved_sources(rows, classes=["press"]).select("o_orderkey")


@query("""WITH t AS (SELECT 'CUSTOMER ' || o_custkey AS e, year(o_orderdate) AS y, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(20,4))) AS s FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2), a AS (SELECT c_custkey, 'CUSTOMER ' || c_custkey AS e, 1995 + c_custkey % 3 AS a, 1997 + c_custkey % 3 AS b FROM customer)
    SELECT c_custkey AS deal_id, CAST(g.y AS INTEGER) AS fiscal_year, CASE WHEN g.y = a THEN 'pre' WHEN g.y = b THEN 'post' ELSE '' END AS period, coalesce(n, 0) AS cases, CAST(coalesce(s, 0) AS DOUBLE) AS total FROM a, (SELECT unnest(range(1995, 2000)) AS y) g LEFT JOIN t ON t.e = a.e AND t.y = g.y""")
def coverage_grid(spark, d):
    years = list(range(1995, 2000))
    k, name = F.col("c_custkey"), F.concat(F.lit("Customer #"), F.col("o_custkey"))
    aliases = table(spark, d, "customer").select(k.alias("deal_id"), F.concat(F.lit("CUSTOMER "), k).alias("employer"), (F.lit(1995) + k % 3).alias("pre_year"), (F.lit(1997) + k % 3).alias("post_year"))
    cases = table(spark, d, "orders").select(name.alias("n"), F.when(F.col("o_orderstatus").isin("F", "O"), "Certified - x").otherwise("Denied").alias("s"), F.format_number("o_totalprice", 2).alias("v"), F.year("o_orderdate").alias("y"))
    kept = cases.where(F.upper("s").startswith("CERTIFIED")).select(F.trim(F.regexp_replace(F.upper("n"), "[^A-Z0-9]+", " ")).alias("employer"), F.col("y").alias("fiscal_year"), F.regexp_replace("v", ",", "").cast("decimal(20,4)").alias("x"))
    totals = kept.groupBy("employer", "fiscal_year").agg(F.count(F.lit(1)).alias("cases"), F.sum("x").alias("total"))
    return G.coverage_grid(aliases, totals, years).select("deal_id", "fiscal_year", "period", "cases", F.col("total").cast("double").alias("total"))


@query(r"SELECT page_id, 'https://' || lower(regexp_extract(url, '^https://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1), '/') AS canonical FROM pages WHERE url LIKE 'https://%' AND regexp_matches(url, '^https://[^/]*example[.]org/')")
def canonical_urls(spark, d):
    rows = table(spark, d, "pages").where(F.col("url").rlike("^https://[^/]*example[.]org/"))
    return rows.select("page_id", V.canonical_url(V.unwrapped_url(F.col("url")), "example.org").alias("canonical"))


@query("SELECT o_orderkey, file AS source_file, CAST(rn AS INTEGER) AS source_row, o_totalprice FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS file, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) AS rn FROM orders) WHERE rn % 5 = 0")
def nth_rows(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").withColumn("source_file", F.when(k % 2 == 0, "a").otherwise("b")).withColumn("source_row", F.row_number().over(Window.partitionBy("source_file").orderBy("o_orderkey")))
    wanted = rows.where("source_row % 5 = 0").select("o_orderkey", "source_file", "source_row")
    return G.nth_row(rows.select("source_file", "source_row", "o_totalprice"), wanted)


# Aggregates over the same tables.
@query("""WITH r AS (SELECT source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT source, CAST(sum(n - 1) AS BIGINT) AS repeats, round(sum(n - 1) * 1.0::DOUBLE / sum(n), 6) AS share FROM (SELECT source, t, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1""")
def text_repeats(spark, d):
    rows = table(spark, d, "documents").select("source", F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256).alias("t"))
    per = rows.groupBy("source", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.sum(F.col("n") - 1).alias("repeats"), F.sum("n").alias("n"))
    return per.select("source", "repeats", F.round(F.col("repeats") / F.col("n"), 6).alias("share"))


@query(f"SELECT upper(t) AS label, count(*) AS passages, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN t = '' THEN 'primary document' ELSE t END AS t FROM (SELECT {sql_pick(TYPES, 'l_orderkey + l_linenumber')} AS t FROM lineitem)) GROUP BY 1 ORDER BY passages DESC, label LIMIT 8")
def document_mix(spark, d):
    kind = pick(TYPES, F.col("l_orderkey") + F.col("l_linenumber"))
    per = table(spark, d, "lineitem").groupBy(F.upper(F.when(kind == "", "primary document").otherwise(kind)).alias("label")).agg(F.count(F.lit(1)).alias("passages"))
    total = per.agg(F.sum("passages").alias("all"))
    return per.crossJoin(F.broadcast(total)).select("label", "passages", F.round(F.col("passages") / F.col("all"), 6).alias("share")).orderBy(F.desc("passages"), "label").limit(8)


@query("SELECT o_orderpriority, round(max(n) * 1.0::DOUBLE / sum(n), 6) AS largest_share, CASE WHEN max(n) * 1.0::DOUBLE / sum(n) > 0.35 THEN 'rejected' ELSE 'accepted' END AS gate FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def concentration_gate(spark, d):
    per = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).groupBy("o_orderpriority").agg((F.max("n") / F.sum("n")).alias("s"))
    return per.select("o_orderpriority", F.round("s", 6).alias("largest_share"), F.when(F.col("s") > 0.35, "rejected").otherwise("accepted").alias("gate"))


@query("SELECT conv_id, string_agg(role, '; ' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.concat_ws("; ", F.array_distinct(ordered)).alias("roles"))


@query("""SELECT 'catalog' AS step, count(*) AS n FROM orders UNION ALL SELECT 'queued', count(*) FILTER (WHERE o_orderstatus <> 'P') FROM orders UNION ALL SELECT 'with_filings', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'modelled', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 4)""")
def assembled_funnel(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    one = orders.agg(F.count(F.lit(1)).alias("catalog"), F.count_if(F.col("o_orderstatus") != "P").alias("queued")).select(F.inline(F.array(*(F.struct(F.lit(c).alias("step"), F.col(c).alias("n")) for c in ("catalog", "queued")))))
    two = lines.agg(F.count(F.lit(1)).alias("with_filings"), F.count_if(F.col("n") >= 4).alias("modelled")).select(F.inline(F.array(*(F.struct(F.lit(c).alias("step"), F.col(c).alias("n")) for c in ("with_filings", "modelled")))))
    return one.unionByName(two)


@query("SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' ELSE 'priority' END AS dimension, coalesce(o_orderstatus, o_orderpriority) AS level, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def means_by_dimension(spark, d):
    long = table(spark, d, "orders").select("o_totalprice", F.inline(F.array(F.struct(F.lit("status").alias("dimension"), F.col("o_orderstatus").alias("level")), F.struct(F.lit("priority").alias("dimension"), F.col("o_orderpriority").alias("level")))))
    return long.groupBy("dimension", "level").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""SELECT lang, term, n FROM (SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS place FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) WHERE length(term) > 2 AND term NOT IN ('the', 'and', 'die', 'les', 'los') GROUP BY 1, 2) WHERE place <= 40""")
def group_clouds(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin("the", "and", "die", "les", "los"))
    per = words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).where("place <= 40").drop("place")


@query("""SELECT o_orderkey, n_name, coalesce(k, 'unknown') AS label, parts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT l_orderkey, count(*) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN (SELECT c_custkey AS i, c_mktsegment AS k FROM customer WHERE c_acctbal > 5000) ON i = o_custkey WHERE o_orderstatus = 'F'""")
def deal_profiles(spark, d):
    deals = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("parts"))
    buyers = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("k")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = deals.join(parts, F.col("o_orderkey") == F.col("l_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "n_name", F.coalesce("k", F.lit("unknown")).alias("label"), "parts")


@query(f"SELECT o_orderkey, 'other' AS kind FROM orders WHERE o_orderkey < 0 UNION ALL SELECT o_orderkey, {sql_case([('dropped', 't LIKE ' + quoted('EX-99%'))], 'kept')} FROM (SELECT o_orderkey, {sql_pick(TYPES, 'o_orderkey')} AS t FROM orders WHERE o_orderstatus = 'F') WHERE t NOT LIKE 'EX-99%'")
def topic_subset(spark, d):
    k = F.col("o_orderkey")
    corpus = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", pick(TYPES, k).alias("document_type"))
    primary = table(spark, d, "orders").where("o_orderstatus = 'F'").select(k.alias("passage_id"))
    chosen = C.subset(corpus, primary, "o_orderkey")
    return E.screened_out(chosen, "document_type", ["ex-99"])[0].select("o_orderkey", F.lit("kept").alias("kind"))


@query(f"""SELECT o_orderkey, CASE WHEN closed IS NULL THEN 'unknown' ELSE CAST(closed AS VARCHAR) END AS closing_date, CASE WHEN closed IS NULL THEN 'unclear' ELSE 'completed' END AS deal_status, CASE WHEN o_orderkey % 3 = 0 THEN 'assessment_failed' WHEN o_orderkey % 3 = 1 THEN 'deep learning; robotics' ELSE 'no_target_mention' END AS ai_relevance_evidence,
    CASE WHEN o_orderkey % 3 = 0 THEN 'assessment_failed' WHEN o_orderkey % 3 = 1 THEN 'machine_verified_pending_human_review' ELSE 'not_qualifying' END AS verification_status FROM orders LEFT JOIN {CLOSED_SQL} ON l_orderkey = o_orderkey""")
def manifest_rows(spark, d):
    k = F.col("o_orderkey")
    assessed = table(spark, d, "orders").where("o_orderkey % 3 > 0").select("o_orderkey", (k % 3 == 1).alias("qualifies"), F.when(k % 3 == 1, F.array(F.lit("deep learning"), F.lit("robotics"))).alias("distinct_terms"), F.when(k % 3 == 1, "").otherwise("no_target_mention").alias("missingness_reason"))
    return E.manifest_rows(_closed(spark, d).select("o_orderkey", F.col("closed").alias("closing_date")), assessed, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'pass' WHEN o_orderkey % 3 = 0 THEN 'fail' WHEN o_orderkey % 3 = 1 THEN 'pending_human_corpus_validation' ELSE 'fail' END AS release FROM orders")
def release_states(spark, d):
    k = F.col("o_orderkey")
    corpus = pick(("failed_human_corpus_validation", "pending_human_corpus_validation", "accepted_human_corpus_validation"), k)
    return table(spark, d, "orders").select("o_orderkey", E.release_status(k % 5 == 0, corpus).alias("release"))


@query("SELECT o_orderkey, 'v1: ' || code || ' ' || CASE code WHEN '7370' THEN 'services' ELSE 'software' END AS rationale FROM (SELECT o_orderkey, " + _CODE + " AS code FROM orders) WHERE code IN ('7370', '7372') UNION ALL SELECT o_orderkey, NULL FROM (SELECT o_orderkey, " + _CODE + " AS code FROM orders) WHERE code NOT IN ('7370', '7372')")
def code_screen(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.code_rationale(pick(CODES, F.col("o_orderkey")), {"7370": "services", "7372": "software"}, "v1").alias("rationale"))


@query("""SELECT c_custkey, v, CAST(n AS INTEGER) AS n FROM (SELECT c_custkey, c_mktsegment AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n <= 12""")
def first_documents(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("n"))
    return rows.where("n <= 12")


@query("""SELECT o_orderstatus AS status, o_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY len(regexp_extract_all(o_orderpriority, '[A-Z]')) DESC, o_orderkey) AS place FROM orders) WHERE place <= 40""")
def ordered_tops(spark, d):
    rows = table(spark, d, "orders").withColumn("status", F.col("o_orderstatus"))
    order = Window.partitionBy("status").orderBy(F.regexp_count("o_orderpriority", F.lit("[A-Z]")).desc(), "o_orderkey")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 40").select("status", "o_orderkey", "place")


@query("SELECT o_orderkey, round(o_totalprice / 7, 3) AS x, CASE WHEN shown LIKE '%.%' THEN rtrim(rtrim(shown, '0'), '.') ELSE shown END AS shown FROM (SELECT o_orderkey, o_totalprice, printf('%.10f', round(o_totalprice / 7, 3)) AS shown FROM orders)")
def plain_numbers(spark, d):
    from corpuslens.operators.reporting import plain_number

    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 7, 3).alias("x")).withColumn("shown", plain_number(F.col("x")))
