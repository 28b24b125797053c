"""Registered queries over the shared tables, and the SQL each of them must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions import rules as R
from corpuslens.functions import text as T
from corpuslens.functions.ids import hash_half, seeded_rank, stable_id
from corpuslens.operators import documents as D
from corpuslens.operators import relational as O
from corpuslens.operators import topics as P
from corpuslens.plans.lineage import cut
from corpuslens.plans.registry import ORACLE_SQL, QUERIES, query

TERMS = {"article": ("the", "a"), "link": ("and", "is", "on"), "legal": ("license", "licensed under", "apache license")}
SEED = 20260823
TOKENS_SQL = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _t(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _closing(spark, d):
    last = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("closed"))
    return _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("announced"), "o_totalprice", "o_orderstatus").join(last, "o_orderkey", "left")


CLOSING_SQL = "(SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS announced, o_totalprice, o_orderstatus, closed FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS closed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@query(f"""SELECT o_orderkey, CAST(announced - 30 AS DATE) AS start, CAST(CASE WHEN closed >= announced THEN closed + 30 ELSE announced + 365 END AS DATE) AS "end",
    CASE WHEN closed >= announced THEN 'closing_observed' WHEN closed IS NOT NULL THEN 'invalid_effective_date' ELSE 'closing_missing' END AS status FROM {CLOSING_SQL}""")
def event_window(spark, d):
    return _closing(spark, d).select("o_orderkey", R.event_window(F.col("announced"), F.col("closed")).alias("w")).select("o_orderkey", "w.*")


@query(f"""SELECT o_orderkey, count(*) AS filings, min(s) AS first, max(s) AS last FROM {CLOSING_SQL} JOIN (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS s FROM lineitem WHERE l_returnflag IN ('A', 'R')) ON l_orderkey = o_orderkey
    WHERE s BETWEEN announced - 30 AND announced + 60 GROUP BY 1""")
def filings_in_window(spark, d):
    windows = _closing(spark, d).select("o_orderkey", F.date_sub("announced", 30).alias("start"), F.date_add("announced", 60).alias("end"))
    filings = _t(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("s"))
    return O.within_windows(filings, windows, "o_orderkey", "s").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("filings"), F.min("s").alias("first"), F.max("s").alias("last"))


@query("""WITH reg AS (SELECT s_name AS ticker, s_nationkey AS nk, s_suppkey FROM supplier), seeds AS (SELECT c_custkey, 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS ticker, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS nk FROM customer),
    one AS (SELECT c_custkey, s_suppkey, 'exact_ticker' AS method FROM seeds JOIN reg ON seeds.ticker = reg.ticker)
    SELECT * FROM one UNION ALL SELECT c_custkey, s_suppkey, CASE WHEN s_suppkey IS NULL THEN 'unresolved' ELSE 'exact_nk' END FROM seeds LEFT JOIN reg ON seeds.nk = reg.nk WHERE c_custkey NOT IN (SELECT c_custkey FROM one)""")
def entity_resolution(spark, d):
    registry = _t(spark, d, "supplier").select(F.col("s_name").alias("ticker_"), F.col("s_nationkey").alias("nk_"), "s_suppkey")
    seeds = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("ticker"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("nk"))
    return O.resolve_entities(seeds, registry, seed_id="c_custkey", first=("ticker", "ticker_"), fallback=("nk", "nk_"), value="s_suppkey")


@query("""SELECT s_nationkey, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(s_suppkey) END AS s_suppkey, CASE WHEN count(DISTINCT s_suppkey) > 1 THEN 'ambiguous' ELSE 'matched' END AS status
    FROM (SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END, CASE WHEN s_acctbal > 5000 THEN 1 WHEN s_acctbal > 0 THEN 2 ELSE 3 END) AS r FROM supplier) WHERE r = 1 GROUP BY 1""")
def best_match_ambiguity(spark, d):
    tier = F.when(F.col("s_acctbal") > 5000, 1).when(F.col("s_acctbal") > 0, 2).otherwise(3)
    return O.best_match(_t(spark, d, "supplier"), "s_nationkey", "s_suppkey", tier, confirmed=F.col("s_suppkey") % 5 == 0, conflicts="flag")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def deal_catalog(spark, d):
    customers = _t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey")
    nations = _t(spark, d, "nation").select("n_nationkey", "n_name")
    return _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


FUNNEL_SQL = "CASE WHEN year(o_orderdate) < 1996 THEN 'out_of_range' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority LIKE '5%' THEN 'off_screen' WHEN o_totalprice < 50000 THEN 'below_floor' ELSE 'included' END"


@query(f"SELECT {FUNNEL_SQL} AS reason, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def screening_funnel(spark, d):
    rules = [("out_of_range", F.year("o_orderdate") < 1996), ("pending", F.col("o_orderstatus") == "P"), ("off_screen", F.col("o_orderpriority").startswith("5")), ("below_floor", F.col("o_totalprice") < 50000)]
    return O.exclusion_funnel(_t(spark, d, "orders"), rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' WHEN grouping(y) = 0 THEN 'year' ELSE 'value' END AS stratum, coalesce(o_orderstatus, CAST(y AS VARCHAR), v) AS level, count(*) AS eligible, count(*) FILTER (WHERE k % 10 = 0) AS preview
    FROM (SELECT o_orderstatus, year(o_orderdate) AS y, CASE WHEN o_totalprice IS NULL THEN 'missing' WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS v, o_orderkey AS k FROM orders) GROUP BY GROUPING SETS ((o_orderstatus), (y), (v))""")
def eligibility_strata(spark, d):
    rows = _t(spark, d, "orders").select("o_orderstatus", F.year("o_orderdate").cast("string").alias("y"), F.when(F.col("o_totalprice").isNull(), "missing").when(F.col("o_totalprice") > 100000, "high").otherwise("low").alias("v"), F.col("o_orderkey").alias("k"))
    long = rows.select("k", F.expr("stack(3, 'status', o_orderstatus, 'year', y, 'value', v) AS (stratum, level)"))
    return long.groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("k") % 10 == 0).alias("preview"))


@query(f"""SELECT c_custkey, c_mktsegment, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('{SEED}:' || c_custkey), c_custkey) AS place FROM customer) ORDER BY place, c_mktsegment LIMIT 40""")
def round_robin_sample(spark, d):
    return O.round_robin(_t(spark, d, "customer"), ["c_mktsegment"], [seeded_rank(SEED, "c_custkey"), F.col("c_custkey")], 40).select("c_custkey", "c_mktsegment", "place")


@query("""WITH f AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1 AS fresh FROM documents)
    SELECT doc_id, lang, source, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY fresh DESC, n_chars DESC, doc_id) AS place FROM f) WHERE place <= 25""")
def family_diverse_topn(spark, d):
    return O.diverse_top(_t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang"], "source", F.col("n_chars"), "doc_id", 25).select("doc_id", "lang", "source", "place")


@query(f"""SELECT 'audit_' || substr(sha256('{SEED}' || chr(31) || doc_id), 1, 16) AS blind_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, toxic ORDER BY sha256('{SEED}:' || doc_id), doc_id) AS place
    FROM documents JOIN labels USING (doc_id)) ORDER BY place, lang, toxic LIMIT 60""")
def blinded_packet(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    return O.blinded_packet(rows, "doc_id", seed=SEED, public=["n_chars"], strata=["lang", "toxic"], limit=60)[0]


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_restrict(spark, d):
    chosen = _t(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return O.restrict(_t(spark, d, "customer"), chosen, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_exclude(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


_TERM_ROWS = ", ".join(f"('{c}', '{t}', '{t.split()[0]}', '{' '.join(t.split()[1:])}', {len(t.split())})" for c, ts in TERMS.items() for t in ts)
HITS_SQL = f"""(WITH w AS (SELECT doc_id, unnest(t) AS w, unnest(range(0, len(t))) AS s FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)), l AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY s) AS w2 FROM w)
    SELECT doc_id, category, term, s AS start, s + k AS "end" FROM (SELECT l.doc_id, l.s, v.*, row_number() OVER (PARTITION BY doc_id, category, s ORDER BY k DESC, term) AS r FROM l JOIN (VALUES {_TERM_ROWS}) AS v(category, term, one, two, k) ON w = one AND (k = 1 OR w2 = two)) WHERE r = 1)"""


def _hits(spark, d):
    return D.token_hits(_t(spark, d, "documents"), "doc_id", "text", TERMS)


@query(f"SELECT doc_id, category, term, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\" FROM {HITS_SQL}")
def keyword_evidence(spark, d):
    return _hits(spark, d)


@query(f"SELECT doc_id, list_sort(list_intersect({TOKENS_SQL}, ['the', 'and', 'is', 'on', 'license'])) AS terms FROM documents WHERE len(list_intersect({TOKENS_SQL}, ['the', 'and', 'is', 'on', 'license'])) > 0".replace("list_sort(list_intersect", "array_to_string(list_sort(list_distinct(list_intersect").replace("'license'])) AS terms", "'license']))), '|') AS terms"))
def term_screen(spark, d):
    wanted = F.array(*map(F.lit, ("the", "and", "is", "on", "license")))
    rows = _t(spark, d, "documents").select("doc_id", F.array_sort(F.array_intersect(F.array_distinct(T.simple_tokens(F.col("text"))), wanted)).alias("t"))
    return rows.where(F.size("t") > 0).select("doc_id", F.concat_ws("|", "t").alias("terms"))


@query(f"""SELECT doc_id, CAST(sum(CASE WHEN w >= 3 THEN w ELSE 0 END) AS BIGINT) AS score, count(*) AS labels, sum(CASE WHEN w >= 3 THEN w ELSE 0 END) >= 5 AS qualified FROM (SELECT doc_id, category, max(length(term)) AS w FROM {HITS_SQL} GROUP BY 1, 2) GROUP BY 1""")
def weighted_screen(spark, d):
    hits = _hits(spark, d).withColumn("w", F.length("term"))
    return D.weighted_screen(hits, "doc_id", "category", "w")


@query(f"""WITH h AS {HITS_SQL} SELECT x.doc_id, CAST(x.start AS INTEGER) AS start, CAST(min(abs(x.start - a.start)) AS INTEGER) AS gap FROM h x JOIN h a ON x.doc_id = a.doc_id AND x.category = 'article' AND a.category = 'legal' AND abs(x.start - a.start) <= 12 GROUP BY 1, 2""")
def proximity_hits(spark, d):
    hits = _hits(spark, d)
    return D.proximity(hits.where("category = 'article'").select("doc_id", "start"), hits.where("category = 'legal'").select("doc_id", "start"), "doc_id", 12).select("doc_id", "start", F.col("gap").cast("int").alias("gap"))


@query(f"""SELECT doc_id, CASE WHEN len({TOKENS_SQL}) < 12 THEN 'too_short' WHEN regexp_matches(text, 'License|license') THEN 'legal_line' WHEN regexp_matches(text, '[0-9]{{3}}-[0-9]{{4}}') THEN 'contact' WHEN regexp_matches(text, '%%%|&&&') THEN 'junk' ELSE 'included' END AS reason FROM documents""")
def passage_gate(spark, d):
    rules = [("too_short", F.size(T.simple_tokens(F.col("text"))) < 12), ("legal_line", F.col("text").rlike("License|license")), ("contact", F.col("text").rlike("[0-9]{3}-[0-9]{4}")), ("junk", F.col("text").rlike("%%%|&&&"))]
    return O.exclusion_funnel(_t(spark, d, "documents"), rules).select("doc_id", "reason")


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS block_index, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents))""")
def paragraph_blocks(spark, d):
    return D.paragraphs(_t(spark, d, "documents"), "doc_id", "text", separator="\n")


@query("""WITH c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS ch FROM (SELECT conv_id, turn, CASE WHEN turn < 4 THEN 'opening' ELSE 'rest' END AS role, text FROM conversations)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c), m AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, run) AS a, max(turn) OVER (PARTITION BY conv_id, run) AS b FROM r),
    h AS (SELECT conv_id, turn, greatest(turn - 1, a) AS lo, least(turn + 1, b) AS hi FROM m WHERE length(text) % 3 = 0), f AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY conv_id ORDER BY lo, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fr FROM h),
    i AS (SELECT *, sum(fr) OVER (PARTITION BY conv_id ORDER BY lo, turn) AS island FROM f) SELECT conv_id, CAST(island AS BIGINT) AS island, min(lo) AS first, max(hi) AS last, count(*) AS hits FROM i GROUP BY 1, 2""")
def context_islands(spark, d):
    rows = _t(spark, d, "conversations").withColumn("part", F.when(F.col("turn") < 4, "opening").otherwise("rest"))
    return D.context_islands(rows, "conv_id", "turn", F.length("text") % 3 == 0, "part", k=1)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations")
def heading_carry(spark, d):
    return D.carry_heading(_t(spark, d, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("text"))).select("conv_id", "turn", "heading")


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM conversations")
def char_offsets(spark, d):
    return D.char_offsets(_t(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "char_start")


@query()
def html_block_list(spark, d):
    return _t(spark, d, "pages").select("page_id", F.inline(D.html_blocks("html")))


@query(r"""SELECT doc_id, 'passage_' || substr(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 16) AS passage_id, count(*) OVER (PARTITION BY trim(regexp_replace(text, '\s+', ' ', 'g'))) AS occurrence_count, doc_id = min(doc_id) OVER (PARTITION BY trim(regexp_replace(text, '\s+', ' ', 'g'))) AS canonical FROM documents""")
def exact_dedupe(spark, d):
    return D.exact_duplicates(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text")).select("doc_id", "passage_id", "occurrence_count", "canonical")


_BANDS = ", ".join(f"'{b}' || " + " || ".join(f"',' || min(substr(sha256('{p}:' || s), 1, 16))" for p in range(b * 4, b * 4 + 4)) for b in range(3))


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, unnest(t) AS w, unnest(range(0, len(t))) AS i, len(t) AS n FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)),
    g AS (SELECT *, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)), s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN n < 3 THEN w ELSE w || ' ' || w2 || ' ' || w3 END AS s FROM g WHERE n < 3 OR w3 IS NOT NULL),
    z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), b AS MATERIALIZED (SELECT doc_id, unnest([{_BANDS}]) AS band FROM s GROUP BY doc_id), c AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.band = y.band AND x.doc_id < y.doc_id),
    l AS (SELECT a, b FROM (SELECT c.a, c.b, count(*) AS m FROM c JOIN s x ON c.a = x.doc_id JOIN s y ON c.b = y.doc_id AND x.s = y.s GROUP BY 1, 2) JOIN z p ON a = p.doc_id JOIN z q ON b = q.doc_id WHERE least(p.n, q.n) >= 0.7 * greatest(p.n, q.n) AND m >= 0.72 * (p.n + q.n - m)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS node, doc_id AS top FROM documents UNION SELECT e.b, r.top FROM r JOIN e ON r.node = e.a),
    f AS (SELECT node AS doc_id, min(top) AS family FROM r GROUP BY 1) SELECT doc_id, family, count(*) OVER (PARTITION BY family) AS members FROM f""")
def provision_families(spark, d):
    return D.near_duplicate_families(_t(spark, d, "documents"), "doc_id", T.simple_tokens(F.col("text")))


LEXICONS = {"article": ("the", "a", "la", "der"), "link": ("and", "et", "und", "is"), "space": ("in", "on", "at", "dans")}
TONE_SQL = f"""(SELECT doc_id, source, lang, len(t) AS tokens, {", ".join(f"len(list_filter(t, lambda x: x IN {v})) AS {k}_count, CASE WHEN len(t) > 0 THEN round(len(list_filter(t, lambda x: x IN {v})) * 100.0::DOUBLE / len(t), 4) ELSE 0 END AS {k}_rate" for k, v in LEXICONS.items())}
    FROM (SELECT doc_id, source, lang, {TOKENS_SQL} AS t FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY doc_id) = 1)))"""


def _tone(spark, d):
    """Rates of every document; of equal texts the first counts. Only ids, digests and counts are shuffled."""
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang", "text").withColumn("passage_id", F.sha2(T.collapse(F.col("text")), 256))
    rates = D.lexicon_rates(docs, ["doc_id", "source", "lang", "passage_id"], T.simple_tokens(F.col("text")), LEXICONS)
    rest = [c for c in rates.columns if c != "passage_id"]
    return rates.groupBy("passage_id").agg(F.min_by(F.struct(*rest), "doc_id").alias("r")).select("r.*")


@query(f"SELECT doc_id, tokens, article_count, article_rate, link_rate, space_rate FROM {TONE_SQL}")
def lexicon_tone(spark, d):
    return _tone(spark, d).select("doc_id", F.col("tokens").cast("long").alias("tokens"), F.col("article_count").cast("long").alias("article_count"), "article_rate", "link_rate", "space_rate")


@query(f"""WITH t AS {TONE_SQL}, f AS (SELECT source, avg(article_rate) AS m, count(*) AS n FROM t GROUP BY 1)
    SELECT lang, count(*) AS passages, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(article_rate), 3) AS article_rate, round(avg(article_rate - round(CASE WHEN n < 5 THEN (SELECT avg(article_rate) FROM t) ELSE m END, 4)), 3) AS residual FROM t JOIN f USING (source) GROUP BY 1""")
def deal_tone(spark, d):
    rows = D.family_baseline(cut(_tone(spark, d)), "source", "article_rate", least=5)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("passages"), F.sum("tokens").cast("long").alias("tokens"), F.round(F.avg("article_rate"), 3).alias("article_rate"), F.round(F.avg("residual"), 3).alias("residual"))


def _equals(term):
    return lambda x: x == term


@query(f"""WITH w AS (SELECT source, unnest({TOKENS_SQL}) AS term FROM documents), n AS (SELECT source, count(*) AS tokens FROM w GROUP BY 1), g AS (SELECT source, term FROM (SELECT DISTINCT source FROM documents), (VALUES ('the'), ('and'), ('license')) AS v(term)),
    c AS (SELECT g.source, g.term, count(w.term) AS uses FROM g LEFT JOIN w ON g.source = w.source AND g.term = w.term GROUP BY 1, 2) SELECT source, term, uses, round(uses * 1000.0::DOUBLE / tokens, 4) AS per_thousand, round(uses * 1.0::DOUBLE / sum(uses) OVER (PARTITION BY source), 6) AS share FROM c JOIN n USING (source)""")
def term_usage(spark, d):
    terms = ("the", "and", "license")
    t = _t(spark, d, "documents").select("source", T.simple_tokens(F.col("text")).alias("t"))
    per = t.groupBy("source").agg(F.sum(F.size("t")).alias("tokens"), *(F.sum(F.size(F.filter("t", _equals(k)))).alias(k) for k in terms))
    long = per.select("source", "tokens", F.inline(F.array(*(F.struct(F.lit(k).alias("term"), F.col(k).alias("uses")) for k in terms))))
    return long.select("source", "term", "uses", F.round(F.col("uses") * 1000.0 / F.col("tokens"), 4).alias("per_thousand"), F.round(F.col("uses") / F.sum("uses").over(Window.partitionBy("source")), 6).alias("share"))


VOCAB_SQL = f"""(SELECT term, count(*) AS df, CAST(sum(c) AS BIGINT) AS tf, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 8) AS idf FROM (SELECT term, doc_id, count(*) AS c FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) WHERE length(term) > 1 GROUP BY 1, 2)
    GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM documents) ORDER BY round(sum(c) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1), 6) DESC, term LIMIT 750)"""


def _counted(spark, d):
    """(documents, their term counts)."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return docs.count(), P.term_counts(docs, "doc_id", F.filter(T.simple_tokens(F.col("text")), lambda t: F.length(t) > 1))


@query(f"SELECT term, df, tf, round(idf, 6) AS idf FROM {VOCAB_SQL}")
def tfidf_vocabulary(spark, d):
    n, counts = _counted(spark, d)
    return P.tfidf_vocabulary(counts, n).withColumn("idf", F.round("idf", 6))


@query(f"""WITH v AS {VOCAB_SQL}, r AS (SELECT doc_id, w.term, (1 + ln(c)) * idf AS x FROM (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY 1, 2) w JOIN v ON w.term = v.term)
    SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS value FROM r""")
def tfidf_matrix(spark, d):
    n, counts = _counted(spark, d)
    return P.tfidf_matrix(counts, "doc_id", P.tfidf_vocabulary(counts, n))


@query(f"""SELECT g AS gram, count(*) AS n FROM (SELECT unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g FROM (SELECT {TOKENS_SQL} AS t FROM documents)) GROUP BY 1 HAVING count(*) >= 5""")
def ngram_counts(spark, d):
    return P.gram_counts(_t(spark, d, "documents"), T.simple_tokens(F.col("text")), 5)


@query(f"""WITH t AS (SELECT {TOKENS_SQL} AS t FROM documents), v(x) AS (VALUES ('and'), ('die'), ('license'), ('of'), ('the')), n AS (SELECT count(*)::DOUBLE AS n FROM t),
    c AS (SELECT a.x AS a, b.x AS b, (SELECT count(*) FROM t WHERE list_contains(t, a.x)) / n AS pa, (SELECT count(*) FROM t WHERE list_contains(t, b.x)) / n AS pb, (SELECT count(*) FROM t WHERE list_contains(t, a.x) AND list_contains(t, b.x)) / n AS p FROM v a, v b, n WHERE a.x < b.x)
    SELECT a, b, round(CASE WHEN p <= 0 THEN -1 WHEN p >= 1 THEN 1 ELSE ln(p / (pa * pb)) / -ln(p) END, 6) AS npmi FROM c""")
def npmi_pairs(spark, d):
    return P.npmi(_t(spark, d, "documents"), "doc_id", T.simple_tokens(F.col("text")), ["and", "die", "license", "of", "the"])


@query()
def nmf_topics(spark, d):
    n, counts = _counted(spark, d)
    vocabulary = cut(P.tfidf_vocabulary(counts, n))  # its terms are needed here, its weights in the matrix
    names = [r.term for r in vocabulary.select("term").collect()]  # bounded by the vocabulary's size
    return P.fit_topics(P.tfidf_matrix(counts, "doc_id", vocabulary), "doc_id", k=4, terms=names)[0]


@query("""WITH e AS (SELECT vec_id, label, unnest(range(1, 65)) AS d, embedding FROM embeddings), m AS (SELECT label, d, avg(embedding[d]::DOUBLE) AS m FROM e GROUP BY 1, 2), c AS (SELECT label, sum(m * m) AS mm FROM m GROUP BY 1),
    s AS (SELECT e.vec_id, m.label, round(sum(embedding[e.d]::DOUBLE * m) / (sqrt(sum(embedding[e.d]::DOUBLE * embedding[e.d]::DOUBLE)) * sqrt(any_value(mm))), 6) AS s FROM e JOIN m ON e.d = m.d JOIN c ON m.label = c.label GROUP BY 1, 2)
    SELECT vec_id, label AS nearest, s AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1""")
def nearest_centroid(spark, d):
    return P.nearest_centroid(_t(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query("""WITH s AS (SELECT n_name, o_orderpriority, sum(l_extendedprice * (1 - l_discount)) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), p AS (SELECT *, a / sum(a) OVER (PARTITION BY n_name) AS share FROM s),
    l AS (SELECT n_name, sum(share * share) AS hhi, list_sort(list(share), 'DESC') AS s, arg_min(o_orderpriority, (-share, o_orderpriority)) AS dominant FROM p GROUP BY 1) SELECT n_name, round(hhi, 6) AS hhi, dominant, round(s[1], 6) AS top_share, round(s[1] - coalesce(s[2], 0), 6) AS margin, s[1] - coalesce(s[2], 0) < 0.1 AS mixed FROM l""".replace("arg_min(o_orderpriority, (-share, o_orderpriority))", "first(o_orderpriority ORDER BY share DESC, o_orderpriority)"))
def share_profile(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = _t(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return O.share_profile(joined, "n_name", "o_orderpriority", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("""WITH g AS (SELECT n_nationkey, f FROM nation, (VALUES ('A'), ('N'), ('R')) AS v(f)), s AS (SELECT s_nationkey, l_returnflag, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY s_nationkey) AS share FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
    SELECT f AS topic, round(avg(coalesce(share, 0)), 6) AS salience FROM g LEFT JOIN s ON n_nationkey = s_nationkey AND f = l_returnflag GROUP BY 1""")
def salience_with_zeros(spark, d):
    used = _t(spark, d, "lineitem").select("l_suppkey", "l_returnflag").join(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = used.groupBy("s_nationkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("s_nationkey")))
    grid = _t(spark, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, "ANR"))).alias("topic"))
    joined = grid.join(share, (F.col("n_nationkey") == F.col("s_nationkey")) & (F.col("topic") == F.col("l_returnflag")), "left")
    return joined.groupBy("topic").agg(F.round(F.avg(F.coalesce("share", F.lit(0.0))), 6).alias("salience"))


@query("""SELECT status, count(*) AS deals, CAST(sum(passages) AS BIGINT) AS passages FROM (SELECT o_orderkey, coalesce(p, 0) AS passages, CASE WHEN p IS NULL THEN 'not_retrieved' WHEN kept = 0 THEN 'zero_yield' WHEN kept < 3 OR docs < 2 THEN 'below_gate' ELSE 'modelled' END AS status
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS p, count(*) FILTER (WHERE l_quantity > 10) AS kept, count(DISTINCT l_suppkey) AS docs FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1""")
def yield_gate(spark, d):
    per = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("p"), F.count_if(F.col("l_quantity") > 10).alias("kept"), F.count_distinct("l_suppkey").alias("docs"))
    joined = _t(spark, d, "orders").select("o_orderkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    gated = O.exclusion_funnel(joined, [("not_retrieved", F.col("p").isNull()), ("zero_yield", F.col("kept") == 0), ("below_gate", (F.col("kept") < 3) | (F.col("docs") < 2))], kept="modelled", reason="status")
    return gated.groupBy("status").agg(F.count(F.lit(1)).alias("deals"), F.sum(F.coalesce("p", F.lit(0))).alias("passages"))


_W = "1.959963984540054"


@query(f"""SELECT scope, level, n, good, round(greatest(0, (good * 1.0::DOUBLE / n + {_W} * {_W} / (2 * n) - {_W} * sqrt(good * 1.0::DOUBLE / n * (1 - good * 1.0::DOUBLE / n) / n + {_W} * {_W} / (4.0 * n * n))) / (1 + {_W} * {_W} / n)), 6) AS low, round(least(1, (good * 1.0::DOUBLE / n + {_W} * {_W} / (2 * n) + {_W} * sqrt(good * 1.0::DOUBLE / n * (1 - good * 1.0::DOUBLE / n) / n + {_W} * {_W} / (4.0 * n * n))) / (1 + {_W} * {_W} / n)), 6) AS high
    FROM (SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'overall' END AS scope, coalesce(source, lang, '') AS level, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (source), (lang)))""")
def wilson_by_scope(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    rows.createOrReplaceTempView("_wilson")
    per = spark.sql("SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'overall' END AS scope, coalesce(source, lang, '') AS level, count(*) AS n, count_if(quality = 1) AS good FROM _wilson GROUP BY GROUPING SETS ((), (source), (lang))")
    w = R.wilson(F.col("good"), F.col("n"))
    return per.select("scope", "level", "n", "good", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query("""SELECT n, round(po, 6) AS observed, round((po - pe) / (1 - pe), 6) AS kappa, round((po - ge) / (1 - ge), 6) AS ac1 FROM (SELECT n, po, p1 * p2 + (1 - p1) * (1 - p2) AS pe, (p1 + p2) * (1 - (p1 + p2) / 2) AS ge
    FROM (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END)::DOUBLE AS po, avg(quality)::DOUBLE AS p1, avg(toxic)::DOUBLE AS p2 FROM labels))""")
def rater_agreement(spark, d):
    return P.rater_agreement(_t(spark, d, "labels"), "quality", "toxic")


@query("""WITH x AS (SELECT label, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END AS b FROM embeddings), c AS (SELECT label, b, count(*) AS c FROM x GROUP BY 1, 2), i AS (SELECT sum(c * (c - 1) / 2)::DOUBLE AS i, sum(c) AS n FROM c),
    r AS (SELECT sum(c * (c - 1) / 2)::DOUBLE AS r FROM (SELECT sum(c) AS c FROM c GROUP BY label)), s AS (SELECT sum(c * (c - 1) / 2)::DOUBLE AS s FROM (SELECT sum(c) AS c FROM c GROUP BY b)) SELECT CAST(n AS BIGINT) AS n, round((i - r * s / (n * (n - 1) / 2)) / ((r + s) / 2 - r * s / (n * (n - 1) / 2)), 6) AS ari FROM i, r, s""")
def adjusted_rand(spark, d):
    bucket = F.when(F.col("embedding")[0] > 0, 1).otherwise(0) + F.when(F.col("embedding")[1] > 0, 2).otherwise(0)
    return P.adjusted_rand(_t(spark, d, "embeddings").select("label", bucket.alias("bucket")), "label", "bucket")


@query("SELECT c_nationkey, count(*) FILTER (WHERE year(o_orderdate) < 1998) AS pre, count(*) FILTER (WHERE year(o_orderdate) >= 1998) AS post, round(coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) < 1998), 0), 2) AS pre_sum FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def hist_pre_post(spark, d):
    rows = _t(spark, d, "orders").select("o_custkey", "o_totalprice", (F.year("o_orderdate") < 1998).alias("before")).join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey").agg(F.count_if("before").alias("pre"), F.count_if(~F.col("before")).alias("post"), F.round(F.sum(F.when(F.col("before"), F.col("o_totalprice")).otherwise(0)), 2).alias("pre_sum"))


@query("""SELECT user_id, count(DISTINCT event_type) AS kinds, arg_min(event_type, event_id) AS first, round(max(value), 6) AS peak, arg_max(event_id, (value, -event_id)) AS peak_event FROM events GROUP BY 1""".replace("arg_max(event_id, (value, -event_id))", "first(event_id ORDER BY value DESC, event_id)"))
def event_profile(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.min_by("event_type", "event_id").alias("first"), F.round(F.max("value"), 6).alias("peak"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("peak_event"))


KINDS = ("view", "signup", "click", "error", "purchase")


@query("SELECT user_id, " + ", ".join(f'count(*) FILTER (WHERE event_type = \'{k}\') AS "{k}"' for k in KINDS) + " FROM events GROUP BY 1")
def evidence_pivot(spark, d):
    return _t(spark, d, "events").groupBy("user_id").pivot("event_type", list(KINDS)).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT n_nationkey AS id, 'nation' AS kind, n_name AS name, CAST(NULL AS DOUBLE) AS acctbal FROM nation UNION ALL SELECT s_suppkey, 'supplier', s_name, s_acctbal FROM supplier")
def union_by_name(spark, d):
    a = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT c_custkey FROM customer EXCEPT ALL SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def except_ids(spark, d):
    return _t(spark, d, "customer").select("c_custkey").exceptAll(_t(spark, d, "orders").where("o_orderstatus = 'P' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query(f"SELECT unnest({TOKENS_SQL}) AS term FROM documents WHERE lang = 'en' INTERSECT SELECT unnest({TOKENS_SQL}) FROM documents WHERE lang = 'de'")
def intersect_terms(spark, d):
    t = lambda lang: _t(spark, d, "documents").where(F.col("lang") == lang).select(F.explode(T.simple_tokens(F.col("text"))).alias("term"))
    return t("en").intersect(t("de"))


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 0 THEN NULL ELSE 'positive' END, CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE 'status' END, CASE WHEN year(o_orderdate) >= 1996 THEN NULL ELSE 'year' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def violations(spark, d):
    return O.violations(_t(spark, d, "orders"), [("positive", F.col("o_totalprice") > 0), ("status", F.col("o_orderstatus").isin("F", "O")), ("year", F.year("o_orderdate") >= 1996)], "o_orderkey")


@query("""SELECT coalesce(a.k, b.k) AS o_custkey, a.v AS before, b.v AS after, CASE WHEN a.k IS NULL THEN 'gained' WHEN b.k IS NULL THEN 'lost' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS change
    FROM (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1) b ON a.k = b.k""")
def cycle_changes(spark, d):
    cycle = lambda when: _t(spark, d, "orders").where(when).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("v"))
    return O.changes(cycle("year(o_orderdate) < 1998"), cycle("year(o_orderdate) >= 1998"), "o_custkey", "v")


@query("SELECT doc_id, 'doc_' || substr(sha256(source || ':' || doc_id), 1, 16) AS id, CAST(('0x' || substr(sha256(doc_id || ''), 16, 1))::INTEGER % 2 AS INTEGER) AS half FROM documents")
def stable_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", stable_id("doc_", "source", "doc_id").alias("id"), hash_half("doc_id").alias("half"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def json_extract(spark, d):
    e = _t(spark, d, "events").select("event_id", "props", F.json_object_keys("props").alias("k"))
    return e.select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.try_element_at("k", F.lit(1))).alias("first_value"), F.size("k").cast("long").alias("n_keys"))


@query("""SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01')), o_orderkey) AS place FROM orders) WHERE place <= 3""")
def nearest_in_time(spark, d):
    gap = F.datediff(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date"))
    return O.nearest(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], gap, [F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("""SELECT s_suppkey, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '^(the )+', ''), '( (corp|corporation|inc|incorporated|limited|llc|ltd|plc|sa))+$', '')) AS name, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier""")
def entity_names(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", T.company_name(F.col("s_name")).alias("name"), T.padded_number(F.col("s_suppkey")).alias("cik"))


@query("SELECT p.doc_id, c.vec_id AS topic_id, round(c.w, 6) AS weight FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canon FROM documents) p JOIN (SELECT vec_id, abs(embedding[1])::DOUBLE AS w FROM embeddings) c ON p.canon = c.vec_id")
def topic_propagation(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.min("doc_id").over(Window.partitionBy("text")).alias("canon"))
    weights = _t(spark, d, "embeddings").select("vec_id", F.abs(F.col("embedding")[0]).cast("double").alias("w"))
    return rows.join(weights, F.col("canon") == F.col("vec_id")).select("doc_id", F.col("vec_id").alias("topic_id"), F.round("w", 6).alias("weight"))


@query()
def deep_link(spark, d):
    from corpuslens.functions.links import text_fragment

    joined = _t(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("quote"))
    return joined.select("page_id", text_fragment("url", "quote").alias("l")).select("page_id", "l.*")


from corpuslens.plans import deal_queries, passage_queries, topic_queries  # noqa: E402, F401  (register their queries)
