"""Queries over passages of deal documents, drawn from fixed sentences by the keys of the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import fixed as X
from corpuslens.functions import text as T
from corpuslens.operators import corpus as C
from corpuslens.operators import eligibility as E
from corpuslens.operators import reporting as R
from corpuslens.operators import screening as S
from corpuslens.plans.registry import pick, query, quoted, sql_case, sql_list, sql_pick, sql_says, table

#: Sentences that exercise the gates; every pair of them is some passage.
SENTENCES = (
    "Continuing employees shall receive base salary and welfare benefits after the closing of the merger.",
    "Table of contents and exhibits follow on the next page.",
    "Forward-looking statements involve risks and uncertainties.",
    "Compensation expense for the fiscal year was recorded in millions.",
    "The European Union approved the combination.",
    "Source code and intellectual property remain confidential information of the seller.",
    "Proxies may be solicited by mail or telephone.",
    "The plaintiff filed a complaint that alleged wrongful conduct.",
    "Representatives shall mean directors, officers and agents of each party.",
    "A retention bonus will be paid to key employees who remain employed until the effective time.",
    "Each stock option vested at closing is converted into restricted stock units.",
    "The founder joins the research team of the buyer.",
    "Our engineers will join the artificial intelligence platform group.",
    "The acquirer licensed an AI model and is hiring rather than buying the robotics company.",
    "Employee matters ........ 84 and vesting ...... 91",
    "Personnel and workforce",
    "The union contract covers labor and wages of all workers.",
    "Revenue growth drives the valuation and proves nothing.",
    "It does not predict the outcome of the transaction.",
    "Machine learning and computer vision support the products of Zeta Labs.",
    "The weather was mild.",
    "Quarter revenue 12 13 14 15 16 17 18 19 20 and adjusted EBITDA 5%.",
    "The management team continues to serve under the chief executive of the parent.",
)
_N = len(SENTENCES)
ONE, TWO = sql_pick(SENTENCES, "o_orderkey"), sql_pick(SENTENCES, f"o_orderkey // {_N}")
TEXT_SQL = f"(SELECT *, {ONE} || chr(10) || chr(10) || {TWO} AS text FROM orders)"
TYPES, FORMS = ("EX-2.1", "EX-10.3", "EX-99.1", "8-K", "", "EX-23.1"), ("8-K", "S-4", "425", "10-Q", "DEFM14A", "SC TO-T", "8-K/A")
NAMES = ("Zeta Labs Inc", "The Mild Company", "Parent Holdings Corp", "AI Data Systems", "Weather plc")
TYPE_SQL, FORM_SQL, NAME_SQL = sql_pick(TYPES, "o_orderkey"), sql_pick(FORMS, "o_orderkey // 6"), sql_pick(NAMES, "o_orderkey // 7")


def passages(spark, d):
    k = F.col("o_orderkey")
    both = F.concat(pick(SENTENCES, k), F.lit("\n\n"), pick(SENTENCES, F.floor(k / _N)))
    return table(spark, d, "orders").withColumn("text", both)


def documents(spark, d):
    k = F.col("o_orderkey")
    return passages(spark, d).withColumns({"document_type": pick(TYPES, k), "form": pick(FORMS, F.floor(k / 6)), "name": pick(NAMES, F.floor(k / 7))})


def _term_sql(term: str, text: str) -> str:
    words = [w.replace("(", r"\(").replace(")", r"\)") for w in term.split()]
    plural = "s?" if len(words) > 1 and not words[-1].endswith("s") else ""
    return f"regexp_matches(lower({text}), {quoted(r'(^|[^\w])' + r'[\s-]+'.join(words) + plural + r'([^\w]|$)')})"


def _terms_sql(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_term_sql(t, text)} THEN {quoted(t)} END" for t in X.SCREEN_TERMS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT o_orderkey, array_to_string({_terms_sql('text')}, '|') AS terms FROM {TEXT_SQL}")
def screening_terms(spark, d):
    return passages(spark, d).select("o_orderkey", F.concat_ws("|", C.screen_terms(F.col("text"))).alias("terms"))


def _gate_sql() -> str:
    says = lambda p: sql_says("m", p)
    treat, lead, pay = says(X.EMPLOYEE_TREATMENT), says(X.LEADERSHIP), says(X.COMPENSATION)
    acts = f"({treat} OR {lead} OR {pay})"
    has = lambda names: f"len(list_intersect(terms, {sql_list(names)})) > 0"
    leaders = r"len(regexp_extract_all(raw, '(?:\.\s*){4,}\s*\d{1,4}(?:[^0-9]|$)')) >= 2"
    words = "len(regexp_extract_all(raw, '[a-z][a-z0-9]*(?:[-''][a-z0-9]+)*'))"
    specific = f"len(list_filter(terms, lambda x: NOT list_contains({sql_list(X.GENERIC_TERMS)}, x))) > 0"
    people = f"(({has(X.AWARD_TERMS)}) AND {says(X.AWARD_TREATMENT)}) OR {treat} OR {says(X.HUMAN)} OR {says(X.GENERIC_PEOPLE)} OR {pay}"
    return sql_case(
        [
            ("excluded_navigation_or_index_fragment", f"({says(X.NAVIGATION)} AND NOT {treat}) OR {leaders}"),
            ("excluded_bare_employee_caption", f"{words} BETWEEN 1 AND 12 AND NOT {sql_says('raw', X.CAPTION_ACTION)}"),
            ("excluded_safe_harbor_or_forward_looking_context", says(X.SAFE_HARBOR)),
            ("excluded_accounting_or_financial_context", says(X.ACCOUNTING)),
            ("excluded_nonemployee_union_context", f"{says(X.NONEMPLOYEE_UNION)} AND NOT {says(X.LABOR)}"),
            ("excluded_nonemployee_privacy_or_ip_context", f"{says(X.PRIVACY_IP)} AND NOT ({has(X.STRONG_TERMS)}) AND NOT {lead}"),
            ("excluded_proxy_solicitation_logistics", f"{says(X.PROXY_SOLICITATION)} AND NOT {acts}"),
            ("excluded_litigation_allegation_context", f"{says(X.LITIGATION)} AND NOT {acts}"),
            ("excluded_generic_representative_definition", f"{says(X.REPRESENTATIVE_DEFINITION)} AND NOT {acts}"),
            ("excluded_generic_term_without_people_context", f"NOT ({specific}) AND NOT ({people})"),
        ],
        "included_employee_context",
    )


@query(f"SELECT o_orderkey, {_gate_sql()} AS reason FROM (SELECT o_orderkey, {ONE} AS raw, lower({ONE}) AS m, {_terms_sql(ONE)} AS terms FROM orders)")
def passage_reasons(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", pick(SENTENCES, F.col("o_orderkey")).alias("raw"))
    return rows.select("o_orderkey", E.passage_eligibility(C.screen_terms(F.col("raw")), F.lower("raw"), F.col("raw")).alias("reason"))


_LANGUAGE, _ACTION = sql_says("text", X.TRANSACTION_LANGUAGE), sql_says("text", X.EMPLOYEE_ACTION)
_EXHIBIT = "(form = '8-K' AND dt LIKE 'EX-%' AND dt NOT LIKE 'EX-2.%' AND dt NOT LIKE 'EX-99.%')"
_NEAR = "list_bool_or(list_transform(aliases, lambda a: contains(norm, ' ' || a || ' ')))"
_NORMAL = "' ' || array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ') || ' '"
ALIASES_SQL = "list_sort(list_distinct(list_filter([n, array_to_string(list_filter(string_split(n, ' '), lambda w: NOT list_contains({s}, w)), ' '), CASE WHEN len(string_split(n, ' ')) = 2 AND list_contains({s}, string_split(n, ' ')[2]) AND length(string_split(n, ' ')[1]) >= 5 THEN string_split(n, ' ')[1] END], lambda a: length(a) >= 4)))".format(s=sql_list(X.TARGET_SUFFIXES))


@query(
    f"""WITH b AS (SELECT o_orderkey, {TYPE_SQL} AS dt, {FORM_SQL} AS form, text, {_NORMAL.format('text')} AS norm, array_to_string(regexp_extract_all(lower({NAME_SQL}), '[a-z0-9]+'), ' ') AS n FROM {TEXT_SQL}), a AS (SELECT *, {ALIASES_SQL} AS aliases FROM b),
    f AS (SELECT *, {_NEAR} AS near FROM a) SELECT o_orderkey, array_to_string(aliases, '|') AS aliases, """
    + sql_case(
        [
            ("included_ex2_transaction_agreement", "dt LIKE 'EX-2.%'"),
            ("included_transaction_specific_form", f"list_contains({sql_list(X.TRANSACTION_FORMS)}, form)"),
            ("included_transaction_evidence", "o_orderkey % 7 = 0"),
            ("included_transaction_employee_action_exhibit", f"{_EXHIBIT} AND near AND {_LANGUAGE} AND {_ACTION}"),
            ("excluded_nontransaction_8k_exhibit", _EXHIBIT),
            ("included_transaction_accession", "o_orderkey % 11 = 0"),
            ("included_target_transaction_proximity", f"near AND {_LANGUAGE}"),
        ],
        "excluded_unrelated_event_window_document",
    )
    + " AS reason FROM f"
)
def document_reasons(spark, d):
    k, aliases = F.col("o_orderkey"), E.target_aliases(F.col("name"))
    reason = E.document_eligibility(F.col("document_type"), F.col("form"), F.when(k % 7 == 0, 1).otherwise(0), k % 11 == 0, E.names_party(F.col("text"), aliases), F.col("text"))
    return documents(spark, d).select("o_orderkey", F.concat_ws("|", aliases).alias("aliases"), reason.alias("reason"))


_PREFIX = lambda of: [(family, f"{of} LIKE '{prefix}%'") for prefix, family in X.FAMILY_RULES]


@query(f"SELECT family, form, count(*) AS n, count(*) FILTER (WHERE dt LIKE 'EX-2.%' OR dt LIKE 'EX-10.%' OR dt LIKE 'EX-99.%' OR o_orderkey % 4 = 0) AS relevant FROM (SELECT *, {sql_case(_PREFIX('dt') + _PREFIX('form'), 'other')} AS family FROM (SELECT o_orderkey, {TYPE_SQL} AS dt, {FORM_SQL} AS form FROM orders)) GROUP BY 1, 2")
def document_families(spark, d):
    rows = documents(spark, d).withColumns({"family": E.document_family(F.col("form"), F.col("document_type")), "relevant": E.relevant_document(F.col("document_type"), F.col("o_orderkey") % 4 == 0)})
    return rows.groupBy("family", "form").agg(F.count(F.lit(1)).alias("n"), F.count_if("relevant").alias("relevant"))


def _sql_pattern(pattern: str) -> str:
    return pattern.replace("(?=", "(?:")


_WEIGHTS = "[" + ", ".join(f"CASE WHEN {sql_says('{t}', _sql_pattern(p))} THEN {w if w >= 3 else 0} ELSE 0 END" for p, w in X.AI_PATTERNS) + "]"


def _weights(text: str) -> str:
    return _WEIGHTS.replace("{t}", text)


@query(f"SELECT o_orderkey, CAST(list_sum(w) AS INTEGER) AS total_weight, len(list_filter(w, lambda x: x > 0)) AS terms, list_sum(w) >= 5 AS qualifies FROM (SELECT o_orderkey, {_weights('text')} AS w FROM {TEXT_SQL})")
def ai_screen(spark, d):
    rows = S.document_screen(passages(spark, d).select("o_orderkey", "text"), "text")
    return rows.select("o_orderkey", "total_weight", F.size("distinct_terms").cast("long").alias("terms"), "qualifies")


_ANCHORS = f"list_distinct(list_filter(regexp_extract_all(lower({NAME_SQL}), '[a-z0-9]+'), lambda w: (length(w) >= 3 OR (length(w) = 2 AND regexp_matches(w, '[0-9]'))) AND NOT list_contains({sql_list(X.AI_GENERIC_TOKENS)}, w)))"
_LINKED = "list_bool_or(list_transform(anchors, lambda a: contains(' ' || array_to_string(regexp_extract_all(lower(p), '[a-z0-9]+'), ' ') || ' ', ' ' || a || ' ')))"
LINKED_SQL = f"""(WITH p AS (SELECT o_orderkey, anchors, unnest(string_split(text, chr(10) || chr(10))) AS p FROM (SELECT *, {_ANCHORS} AS anchors FROM {TEXT_SQL})), l AS (SELECT o_orderkey, {_weights('p')} AS w FROM p WHERE {_LINKED}),
    u AS (SELECT o_orderkey, [{", ".join(f"max(w[{k + 1}])" for k in range(len(X.AI_PATTERNS)))}] AS w FROM l GROUP BY 1) SELECT o.*, text, coalesce(list_sum(w), 0) AS total FROM {TEXT_SQL} o LEFT JOIN u USING (o_orderkey))"""


@query(f"SELECT o_orderkey, CAST(total AS INTEGER) AS total_weight, total >= 5 AS qualifies FROM {LINKED_SQL}")
def target_linked_screen(spark, d):
    rows = S.document_screen(documents(spark, d).select("o_orderkey", "text", "name"), "text", "name")
    return rows.select("o_orderkey", "total_weight", "qualifies")


_JOINS = f"({sql_says('text', X.TALENT_JOIN)} OR {sql_says('text', X.JOIN_TALENT)})"
_HIRE, _LICENCE = sql_says("text", X.ACQUIHIRE), sql_says("text", X.LICENSE_HIRE)


@query(f"SELECT o_orderkey, {_JOINS} AS joins, {_HIRE} AS acquihire, {_LICENCE} AS licence FROM {TEXT_SQL}")
def talent_signals(spark, d):
    rows = S.talent_signals(passages(spark, d), "text")
    return rows.select("o_orderkey", F.col("join_language").alias("joins"), F.col("acquihire_explicit").alias("acquihire"), F.col("license_and_hire_explicit").alias("licence"))


@query(f"""SELECT o_custkey, {sql_case([('ai_explicit', 'max(total) >= 5'), ('ai_adjacent', 'max(total) >= 3')], 'none')} AS label, CAST(max(total) AS INTEGER) AS weight, first(o_orderkey ORDER BY total DESC, o_orderkey) AS source, bool_or({_JOINS}) AS joins, bool_or({_HIRE}) AS acquihire, count(*) AS documents
    FROM {LINKED_SQL} GROUP BY 1""")
def deal_ai_labels(spark, d):
    rows = S.talent_signals(S.document_screen(documents(spark, d).select("o_custkey", "o_orderkey", "text", "name"), "text", "name"), "text")
    out = S.deal_labels(rows, "o_custkey", "o_orderkey")
    return out.select("o_custkey", "label", "weight", "source", F.col("join_language").alias("joins"), F.col("acquihire_explicit").alias("acquihire"), F.col("documents_screened").alias("documents"))


@query(f"""SELECT o_custkey, bool_or(total >= 5) AS qualifies, CAST(coalesce(max(total) FILTER (WHERE total >= 5), 0) AS INTEGER) AS total_weight, first(o_orderkey ORDER BY total DESC, o_orderkey) FILTER (WHERE total >= 5) AS o_orderkey,
    CASE WHEN bool_or(total >= 5) THEN '' WHEN bool_or(named) THEN 'target_mentioned_without_local_ai_evidence' ELSE 'no_target_mention_in_retrieved_documents' END AS missingness_reason FROM (SELECT *, {_LINKED.replace('(p)', '(text)').replace('anchors', _ANCHORS)} AS named FROM {LINKED_SQL}) GROUP BY 1""")
def deal_assessments(spark, d):
    rows = S.document_screen(documents(spark, d).select("o_custkey", "o_orderkey", "text", "name"), "text", "name")
    rows = rows.withColumn("named", F.size(S.anchors_at(F.col("text"), S.target_anchors(F.col("name")))) > 0)
    return S.deal_assessment(rows, "o_custkey", ["o_orderkey"]).drop("distinct_terms")


RAW_FORMS = ("Merger", "Acq. of Assets", "Acq. Maj. Int.", " ", "Acq. Cert. Asts.", "Spinoff", "Acq. Rem. Int.")
_RAW = sql_pick(RAW_FORMS, "o_orderkey")
_LEGAL = "CASE WHEN trim(raw) = '' THEN 'unknown' " + " ".join(f"WHEN lower(trim(raw)) = {quoted(k)} THEN {quoted(v)}" for k, v in X.LEGAL_FORMS.items()) + " ELSE 'unmapped_sdc_form:' || trim(raw) END"


@query(
    f"WITH b AS (SELECT o_orderkey, {_RAW} AS raw, o_orderkey % 13 AS w, o_orderkey % 2 = 0 AS named, o_orderkey % 5 = 0 AS joins, o_orderkey % 17 = 0 AS hire, o_orderkey % 19 = 0 AS lic FROM orders), f AS (SELECT *, {_LEGAL} AS form FROM b) SELECT o_orderkey, form, "
    + "CASE WHEN w >= 8 AND named THEN 'high' WHEN (w >= 5 AND named) OR w >= 10 THEN 'medium' ELSE 'low' END AS confidence, "
    + sql_case([("unknown", "w < 5 AND NOT (joins OR hire)"), ("license_and_hire", "lic"), ("ai_assets_or_ip", "form = 'asset purchase (certain assets)'"), ("acqui_hire_or_team", "hire"), ("strategic_or_minority_investment", "form IN ('majority stock acquisition', 'remaining-interest step acquisition')"), ("ai_company_acquisition", "form IN ('statutory merger', 'asset purchase')")], "ai_related_transaction")
    + " AS category, CASE WHEN hire THEN 'documented_acqui_hire_language' WHEN joins THEN 'documented_team_join_language' ELSE 'not_documented_in_reviewed_sources' END AS motive, CASE WHEN w = 0 THEN 'retrieval_failed' WHEN named THEN 'target_linked' ELSE 'excluded_no_target_link' END AS link FROM f"
)
def deal_classes(spark, d):
    k = F.col("o_orderkey")
    w, named, joins, hire, lic, form = k % 13, k % 2 == 0, k % 5 == 0, k % 17 == 0, k % 19 == 0, E.legal_form(pick(RAW_FORMS, k))
    return table(spark, d, "orders").select("o_orderkey", form.alias("form"), E.confidence_tier(w, named).alias("confidence"), E.ai_category(w >= 5, joins, hire, lic, form).alias("category"), E.talent_motive(joins, hire).alias("motive"), E.link_status(w != 0, named).alias("link"))


def _b(key: str) -> str:
    return sql_says("body", R.LINT[key])


_ARRANGED = f"({_b('arrangement')} OR {_b('benefit')} OR ({_b('equity_subject')} AND {_b('equity_treatment')}))"
_WORDS = r"len(regexp_extract_all(body, '[\w''’]+(?:-[\w''’]+)*'))"
_LINT_SQL = [
    ("too_short", f"{_WORDS} < 12 AND NOT {_b('high_signal')}"),
    ("call_transcript_noise", _b("call")),
    ("generic_accounting_noise", f"{_b('accounting_report')} OR ({_b('accounting')} AND NOT {_b('arrangement_detail')})"),
    ("title_or_contact_block", f"{_b('title')} AND NOT {_b('action')}"),
    ("privacy_or_ip_noise", _b("privacy")),
    ("non_human_retain_use", f"{_b('retain_use')} AND NOT {_b('human')}"),
    ("generic_risk_boilerplate", f"{_b('risk')} AND NOT {_ARRANGED}"),
    ("generic_legal_boilerplate", f"{_b('party_list')} AND NOT {_b('deal_action')}"),
    ("generic_financial_metric", f"{_b('metric')} AND NOT {_b('deal_action')}"),
    ("definition_or_proxy_noise", _b("definition")),
    ("generic_litigation_language", f"{_b('litigation')} AND NOT {_b('deal_action')}"),
    ("proxy_interest_or_counsel_noise", _b("counsel")),
    ("aggregate_securities_valuation", f"{_b('valuation')} AND NOT {_b('human')}"),
    ("no_employee_arrangement_evidence", f"NOT {_ARRANGED} AND NOT {_b('high_signal')}"),
    ("no_human_capital_subject", f"NOT {_b('human')} AND NOT {_ARRANGED}"),
    ("no_acquisition_employee_context", f"NOT {_b('deal_context')} AND NOT {_b('high_signal')}"),
    ("numeric_table_noise", rf"len(regexp_extract_all(body, '\$?\d[\d,]*(?:\.\d+)?%?|—')) >= 8 AND len(regexp_extract_all(body, '\$?\d[\d,]*(?:\.\d+)?%?|—')) > {_WORDS} / 3 AND NOT {_b('deal_action')}"),
    ("no_substantive_employee_language", f"NOT {_b('language')}"),
    ("no_substantive_action", f"NOT {_b('action')} AND NOT {_b('high_signal')}"),
]
LINT_REASONS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {holds} THEN {quoted(name)} END" for name, holds in _LINT_SQL) + "], lambda x: x IS NOT NULL)"
BODY_SQL = rf"(SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM {TEXT_SQL})"


@query(f"SELECT o_orderkey, array_to_string({LINT_REASONS_SQL}, '|') AS reasons FROM {BODY_SQL}")
def passage_lints(spark, d):
    return passages(spark, d).select("o_orderkey", F.concat_ws("|", R.passage_lint(F.col("text"))).alias("reasons"))


@query(f"""SELECT o_orderpriority AS topic, o_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY least({_WORDS}, 120) DESC, o_totalprice DESC, o_orderkey) AS place FROM {BODY_SQL} WHERE o_orderstatus = 'F' AND len({LINT_REASONS_SQL}) = 0) WHERE place <= 3""")
def topic_representatives(spark, d):
    rows = passages(spark, d).withColumns({"topic": F.col("o_orderpriority"), "primary_topic": F.col("o_orderstatus") == "F"})
    return R.representatives(rows, "topic", "o_orderkey", "text", "o_totalprice").select("topic", "o_orderkey", "place")


_CLAIM_SQL = " UNION ALL ".join(f"SELECT o_orderkey, {quoted(c)} AS category, m FROM (SELECT o_orderkey, unnest(regexp_extract_all(s, {quoted('(?i).*?' + p)})) AS m FROM s)" for c, p in R.CLAIMS)


@query(rf"WITH s AS (SELECT o_orderkey, unnest(string_split(text, chr(10))) AS s FROM {TEXT_SQL}), c AS ({_CLAIM_SQL}) SELECT o_orderkey, category, count(*) AS n FROM c WHERE NOT {sql_says('m', R.NEGATION + '.*')} GROUP BY 1, 2")
def claim_lints(spark, d):
    return R.claim_lint(passages(spark, d), "o_orderkey", "text").select("o_orderkey", "category", F.col("n").cast("long").alias("n"))


_COUNT = lambda terms: " + ".join(f"len(regexp_extract_all(body, {quoted(r'(?i)\b' + t.replace('(', r'\(').replace(')', r'\)') + (r'\b' if t[-1].isalnum() else ''))}))" for t in terms)


@query("SELECT o_orderkey, CAST(tokens AS BIGINT) AS tokens, " + ", ".join(f"CAST({k} AS BIGINT) AS {k}_count, CASE WHEN tokens > 0 THEN round({k} * 100.0::DOUBLE / tokens, 4) ELSE 0 END AS {k}_rate" for k in X.LEXICONS) + f" FROM (SELECT o_orderkey, {_WORDS} AS tokens, " + ", ".join(f"{_COUNT(v)} AS {k}" for k, v in X.LEXICONS.items()) + f" FROM {BODY_SQL})")
def lexicon_wording(spark, d):
    from corpuslens.operators.wording import lexicon_counts

    return lexicon_counts(passages(spark, d).select("o_orderkey", "text"), "text", X.LEXICONS).drop("text")


_TONE = {"pos": X.TONE_POSITIVE, "neg": X.TONE_NEGATIVE, "hedge": X.TONE_HEDGES, "shall": ("shall",), "may": ("may",), "negout": X.TONE_NEGATIVE_OUTCOMES, "protect": X.TONE_PROTECTIONS}


@query("SELECT o_orderkey, CAST(tokens AS BIGINT) AS tokens, " + ", ".join(f"CAST({k} AS BIGINT) AS {k}_count" for k in _TONE) + f", CASE WHEN tokens > 0 THEN round((pos - neg) * 100.0::DOUBLE / tokens, 6) ELSE 0 END AS net_tone, CASE WHEN shall + may > 0 THEN round(shall * 1.0::DOUBLE / (shall + may), 6) ELSE 0 END AS obligation_share FROM (SELECT o_orderkey, len(regexp_extract_all(lower(body), '[a-z0-9]+(?:[''-][a-z0-9]+)*')) AS tokens, " + ", ".join(f"{_COUNT(v)} AS {k}" for k, v in _TONE.items()) + f" FROM {BODY_SQL})")
def tone_features(spark, d):
    from corpuslens.operators.wording import tone_features as features

    return features(passages(spark, d).select("o_orderkey", "text"), "text").drop("text")


BLOCKS_SQL = f"(SELECT o_orderkey, o_custkey, CAST(i - 1 AS INTEGER) AS block_index, p[i] AS text, CAST(CASE WHEN i = 1 THEN 0 ELSE length(p[1]) + 1 END AS BIGINT) AS char_start FROM (SELECT o_orderkey, o_custkey, p, unnest(range(1, 3)) AS i FROM (SELECT *, string_split(text, chr(10) || chr(10)) AS p FROM {TEXT_SQL})))"


@query(f"SELECT o_orderkey, block_index, text, char_start, char_start + length(text) AS char_end FROM {BLOCKS_SQL}")
def parsed_blocks(spark, d):
    return C.document_blocks(passages(spark, d).select("o_orderkey", "text"), "o_orderkey", "text").drop("heading")


def _corpus(spark, d):
    docs = passages(spark, d).select("o_orderkey", "o_custkey", "text")
    found = C.passages(C.document_blocks(docs, "o_orderkey", "text"), docs.drop("text"), "o_orderkey")
    return C.deduplicated(found, ["o_custkey", "o_orderkey", "block_start", "block_end"], deal="o_custkey", document="o_orderkey")


HIT_SQL = f"(SELECT *, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM {BLOCKS_SQL} WHERE len({_terms_sql('text')}) > 0)"


@query(f"SELECT 'passage_' || substr(h, 1, 16) AS passage_id, first(o_custkey ORDER BY o_custkey, o_orderkey, block_index) AS o_custkey, first(o_orderkey ORDER BY o_custkey, o_orderkey, block_index) AS o_orderkey, count(*) AS occurrence_count FROM {HIT_SQL} GROUP BY h")
def passage_corpus(spark, d):
    return _corpus(spark, d)[0].select("passage_id", "o_custkey", "o_orderkey", "occurrence_count")


@query(f"SELECT 'occurrence_' || substr(sha256('passage_' || substr(h, 1, 16) || ':' || o_custkey || ':' || o_orderkey || ':' || block_index || ':' || block_index), 1, 16) AS occurrence_id, o_orderkey, char_start, count(*) OVER (PARTITION BY h) AS occurrence_count FROM {HIT_SQL}")
def passage_occurrences(spark, d):
    canonical, occurrences = _corpus(spark, d)
    return C.occurrence_status(occurrences, canonical, ["occurrence_count"]).select("occurrence_id", "o_orderkey", "char_start", "occurrence_count")


@query(f"SELECT o_custkey, 'passage_' || substr(h, 1, 16) AS passage_id, min(o_orderkey) AS o_orderkey FROM {HIT_SQL} GROUP BY 1, 2")
def passage_sources(spark, d):
    canonical, occurrences = _corpus(spark, d)
    return C.representative_sources(occurrences, canonical, "o_custkey", [F.col("o_orderkey"), F.col("block_start")]).select("o_custkey", "passage_id", "o_orderkey")


HEADINGS = ("Table of Contents", "Article VII", "ARTICLE VII COVENANTS AND AGREEMENTS", "Page 12", "A-3", "iv", "12.4", "Employee Matters", "Annex B", " . ", "Exhibit 10.1", "x", "Part II: Pay")


@query(rf"SELECT o_orderkey, heading, coalesce(bare <> '' AND regexp_matches(bare, {quoted(X.STRUCTURAL_HEADING)}, 'i'), false) AS furniture FROM (SELECT o_orderkey, heading, trim(heading, ' .:-') AS bare FROM (SELECT o_orderkey, {sql_pick(HEADINGS, 'o_orderkey')} AS heading FROM orders))")
def structural_headings(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", pick(HEADINGS, F.col("o_orderkey")).alias("heading"))
    return rows.withColumn("furniture", C.structural_heading(F.col("heading")))


@query(r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s) <> '')) AS sentences FROM conversations")
def sentence_counts(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.size(S.sentences_at("text")).cast("long").alias("sentences"))


@query(f"SELECT o_orderkey, trim(regexp_replace(regexp_replace({_NORMAL.format(ONE)}, ' zeta labs inc | zeta labs | zeta ', ' entitytoken ', 'g'), ' +', ' ', 'g')) AS masked FROM orders")
def masked_names(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", T.simple_tokens(pick(SENTENCES, F.col("o_orderkey")))).alias("plain"))
    return rows.select("o_orderkey", T.collapse(T.mask_names(F.col("plain"), F.array(*map(F.lit, ("zeta", "zeta labs", "zeta labs inc"))))).alias("masked"))
