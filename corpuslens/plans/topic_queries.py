"""Queries over topic weights (four components of the embeddings, as nonnegative numbers) and over topic models of the documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpuslens.operators import topic_models as M
from corpuslens.plans.registry import query, sql_list, table

K = 4
TERMS = ("plan", "agreement", "section", "bonus", "vesting", "party agreement", "pension plan", "section party", "retention")
GENERIC = ("agreement", "section", "party", "parties", "company")
_V = "[" + ", ".join(f"round(greatest(embedding[{t + 1}], 0)::DOUBLE, 6)" for t in range(K)) + "]"
#: vec_id, deal (label), family, duplicate group, weights.
ROWS_SQL = f"(SELECT vec_id, label AS deal, vec_id % 7 AS family, vec_id // 2 AS grp, {_V} AS v FROM embeddings)"
LONG_SQL = f"(SELECT vec_id, deal, family, grp, t AS topic, v[t + 1] AS weight, list_sum(v) > 0 AND list_position(v, list_max(v)) = t + 1 AS primary_topic FROM {ROWS_SQL}, (SELECT unnest(range({K})) AS t))"


def rows(spark, d):
    vector = F.array(*(F.round(F.greatest(F.col("embedding")[t], F.lit(0.0)).cast("double"), 6) for t in range(K)))
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("deal"), (F.col("vec_id") % 7).alias("family"), F.floor(F.col("vec_id") / 2).alias("grp"), vector.alias("v"))


def assigned(spark, d):
    meta = rows(spark, d).drop("v")
    return M.assignments(rows(spark, d), "vec_id", "v").join(meta, "vec_id")


@query(f"SELECT vec_id, CAST(topic AS INTEGER) AS topic, weight, primary_topic FROM {LONG_SQL}")
def topic_assignments(spark, d):
    return M.assignments(rows(spark, d), "vec_id", "v")


@query(f"SELECT deal, CAST(topic AS INTEGER) AS topic, round(sum(w), 6) AS weight_sum, round(sum(w) / sum(sum(w)) OVER (PARTITION BY deal), 6) AS normalized_weight, count(*) FILTER (WHERE p) AS primary_passage_count FROM (SELECT deal, grp, topic, max(weight) AS w, bool_or(primary_topic) AS p FROM {LONG_SQL} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def deal_topic_matrix(spark, d):
    out = M.deal_topics(assigned(spark, d), deal="deal", group="grp", topic="topic", weight="weight")
    return out.select("deal", "topic", F.round("weight_sum", 6).alias("weight_sum"), F.round("normalized_weight", 6).alias("normalized_weight"), "primary_passage_count")


@query(f"WITH l AS {LONG_SQL}, n AS (SELECT deal, topic, count(*) AS n, min(vec_id) AS f FROM l WHERE primary_topic GROUP BY 1, 2) SELECT w.*, CAST(m.topic AS INTEGER) AS dominant_topic FROM (SELECT deal, count(DISTINCT vec_id) AS passages, {', '.join(f'round(avg(weight) FILTER (WHERE topic = {t}), 4) AS topic_{t}' for t in range(K))} FROM l GROUP BY 1) w LEFT JOIN (SELECT deal, first(topic ORDER BY n DESC, f) AS topic FROM n GROUP BY 1) m USING (deal)")
def mean_topic_shares(spark, d):
    return M.mean_shares(assigned(spark, d), deal="deal", ident="vec_id", topics=range(K))


@query(f"SELECT CAST(topic AS INTEGER) AS topic, count(*) AS passages, count(DISTINCT family) AS families, count(DISTINCT deal) AS deals, count(DISTINCT family) >= 5 AND count(DISTINCT deal) >= 2 AS support_valid FROM {LONG_SQL} WHERE primary_topic GROUP BY 1")
def topic_support(spark, d):
    return M.support(assigned(spark, d), topic="topic", family="family", deal="deal")


@query(f"""WITH m AS (SELECT *, list_sort(v, 'DESC')[1] - list_sort(v, 'DESC')[2] AS margin, list_position(v, list_max(v)) - 1 AS t FROM {ROWS_SQL} WHERE list_sum(v) > 0), s AS (SELECT vec_id % {K} AS t, round(embedding[6]::DOUBLE, 6) AS c FROM embeddings)
    SELECT CAST(m.t AS INTEGER) AS topic, passages, families, deals, round(specificity, 6) AS specificity, round(mc, 6) AS median_cosine, round(rr, 6) AS recovery_rate FROM (SELECT t, count(*) AS passages, count(DISTINCT family) AS families, count(DISTINCT deal) AS deals, avg(margin) AS specificity FROM m GROUP BY 1) m JOIN (SELECT t, median(c) AS mc, avg((c >= 0)::INTEGER) AS rr FROM s GROUP BY 1) s ON s.t = m.t""")
def topic_summaries(spark, d):
    refits = table(spark, d, "embeddings").select((F.col("vec_id") % K).cast("int").alias("topic"), F.round(F.col("embedding")[5].cast("double"), 6).alias("cosine")).withColumn("recovered", F.col("cosine") >= 0)
    out = M.summaries(assigned(spark, d), refits, topic="topic", family="family", deal="deal", ident="vec_id")
    return out.select("topic", "passages", "families", "deals", *(F.round(c, 6).alias(c) for c in ("specificity", "median_cosine", "recovery_rate")))


_FITS_SQL = "(SELECT label + 3 AS k, round(abs(avg(embedding[1]::DOUBLE)), 6) + 0.5 AS error, round(avg(embedding[2]::DOUBLE), 6) + 0.05 AS coherence, count(*) % 3 > 0 AS support_valid FROM embeddings GROUP BY label)"


@query(f"WITH f AS (SELECT * FROM {_FITS_SQL} WHERE support_valid AND coherence >= 0) SELECT k, error, coherence, support_valid FROM f WHERE error <= (SELECT min(error) FROM f) * 1.25 AND coherence >= (SELECT max(coherence) FROM f) - 0.15 ORDER BY k LIMIT 1")
def selected_k(spark, d):
    fits = table(spark, d, "embeddings").groupBy((F.col("label") + 3).alias("k")).agg(F.round(F.abs(F.avg(F.col("embedding")[0].cast("double"))), 6).alias("e"), F.round(F.avg(F.col("embedding")[1].cast("double")), 6).alias("c"), (F.count(F.lit(1)) % 3 > 0).alias("support_valid"))
    return M.selected_k(fits.select("k", (F.col("e") + 0.5).alias("error"), (F.col("c") + 0.05).alias("coherence"), "support_valid"))


_PARTS_SQL = f"(SELECT label % {K} AS topic, d AS place, (SELECT {sql_list(TERMS)})[d % {len(TERMS)} + 1] || '_' || d AS term, round(avg(abs(embedding[d + 1]::DOUBLE)), 6) AS weight FROM embeddings, (SELECT unnest(range(20)) AS d) GROUP BY 1, 2)"


def _parts(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") % K).alias("topic"), F.posexplode(F.slice("embedding", 1, 20)).alias("place", "x"))
    name = F.concat(F.element_at(F.array(*map(F.lit, TERMS)), (F.col("place") % len(TERMS) + 1).cast("int")), F.lit("_"), F.col("place"))
    return e.groupBy("topic", "place").agg(F.round(F.avg(F.abs(F.col("x").cast("double"))), 6).alias("weight")).withColumn("term", name)


@query(f"""WITH t AS (SELECT topic, list(term ORDER BY weight DESC, place)[1:5] AS terms FROM {_PARTS_SQL} GROUP BY 1), n AS (SELECT topic, count(*) AS n FROM {LONG_SQL} WHERE primary_topic GROUP BY 1)
    SELECT CAST(topic AS INTEGER) AS topic, 'topic_' || row_number() OVER (ORDER BY coalesce(n, 0) DESC, terms) AS topic_id, coalesce(n, 0) AS n, array_to_string(terms, '|') AS terms FROM t LEFT JOIN n USING (topic)""")
def ordered_topics(spark, d):
    return M.ordered_topics(assigned(spark, d), _parts(spark, d)).withColumn("terms", F.concat_ws("|", "terms"))


@query(f"SELECT CAST(topic AS INTEGER) AS topic, 'topic_' || substr(sha256(array_to_string(list(term ORDER BY weight DESC, place)[1:10], ' ')), 1, 8) AS label FROM {_PARTS_SQL} GROUP BY 1")
def topic_labels(spark, d):
    return M.top_terms(_parts(spark, d)).select("topic", M.topic_label(F.col("terms")).alias("label"))


_GENERIC_ROWS = f"(SELECT label AS topic, list_transform(range(6), lambda i: {sql_list(TERMS)}[(label + i) % {len(TERMS)} + 1]) AS terms, round(avg(embedding[1]::DOUBLE), 6) AS coherence, round(avg((embedding[2] > 0)::INTEGER), 6) AS recovery_rate FROM embeddings GROUP BY label)"
_RATIO = f"len(list_filter(terms, lambda t: len(list_filter(string_split(t, ' '), lambda w: NOT list_contains({sql_list(GENERIC)}, w))) = 0)) / 6.0::DOUBLE"


@query(f"SELECT topic, round({_RATIO}, 6) AS generic_ratio, array_to_string(list_filter([CASE WHEN recovery_rate < 0.8 THEN 'recovery_rate' END, CASE WHEN coherence < 0 THEN 'npmi_coherence' END, CASE WHEN {_RATIO} > 0.5 THEN 'generic_top_term_ratio' END], lambda x: x IS NOT NULL), '|') AS warnings FROM {_GENERIC_ROWS}")
def topic_quality(spark, d):
    terms = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.element_at(F.array(*map(F.lit, TERMS)), ((F.col("label") + i) % len(TERMS) + 1).cast("int")))
    topics = table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("coherence"), F.round(F.avg((F.col("embedding")[1] > 0).cast("double")), 6).alias("recovery_rate"))
    out = M.quality(topics.withColumn("terms", terms), GENERIC)
    return out.select(F.col("label").alias("topic"), F.round("generic_ratio", 6).alias("generic_ratio"), F.concat_ws("|", "warnings").alias("warnings"))


@query(f"SELECT count(*) AS deals, count(*) FILTER (WHERE top > 0.5) AS dominated, list_sort(list(top))[len(list(top)) // 2 + 1] AS median_top FROM (SELECT vec_id, max(round(weight / s, 6)) AS top FROM (SELECT *, sum(weight) OVER (PARTITION BY vec_id) AS s FROM {LONG_SQL}) WHERE s > 0 GROUP BY 1)")
def deal_spread(spark, d):
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    shares = rows(spark, d).withColumn("s", total).where("s > 0").select("vec_id", "s", F.explode("v").alias("w")).select("vec_id", F.round(F.col("w") / F.col("s"), 6).alias("share"))
    return M.spread(shares, "vec_id", "share")


_READY_SQL = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, source) AS r FROM (SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 0 THEN 'passage:' || doc_id ELSE CAST(doc_id // 3 AS VARCHAR) END AS grp FROM documents WHERE doc_id % 4 > 0 AND trim(text) <> '')) WHERE r = 1)"


def _ready(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text", F.when(k % 4 > 0, " Included").otherwise("excluded").alias("status"), F.when(k % 5 == 0, " ").otherwise(F.floor(k / 3).cast("string")).alias("grp"))
    return M.prepared(docs, status="status", text="text", group="grp", ident="doc_id", order=["doc_id", "source"])


@query(f"SELECT doc_id, grp AS duplicate_key FROM {_READY_SQL}")
def prepared_passages(spark, d):
    return _ready(spark, d).select("doc_id", "duplicate_key")


def _balanced(group: str) -> str:
    return f"SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY h, doc_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS n FROM (SELECT *, sha256('1729:' || lang || ':' || doc_id) AS h FROM {_READY_SQL})) WHERE n = 1) ORDER BY place, {group}, doc_id LIMIT 30"


@query(_balanced("lang"))
def balanced_fit(spark, d):
    return M.balanced_fit(_ready(spark, d), deal="lang", family="source", ident="doc_id", limit=30, seed=1729, balance="lang").select("doc_id")


@query(_balanced("source"))
def balanced_fit_by_source(spark, d):
    return M.balanced_fit(_ready(spark, d), deal="lang", family="source", ident="doc_id", limit=30, seed=1729, balance="source").select("doc_id")


def _fit(spark, d, rows_each: int = 60) -> tuple[np.ndarray, list[str], np.ndarray]:
    """A fit universe of at most ``rows_each`` vectors a deal by a seeded hash: bounded, so one task can hold it."""
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(5), F.col("vec_id")), "vec_id")
    chosen = table(spark, d, "embeddings").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_each).orderBy("label", "vec_id").select("label", "embedding").collect()
    x = np.maximum(np.array([r.embedding for r in chosen], float), 0)
    return x, [str(r.label) for r in chosen], M.factorize(x, 3, 1729, 20)[1]


@query()
def leave_one_out(spark, d):
    return M.refit_summary(M.leave_one_out(spark, *_fit(spark, d)))


@query()
def bootstrap_stability(spark, d):
    return M.refit_summary(M.bootstrap(spark, *_fit(spark, d), replicates=40))
