"""Coded attributes of deals: register rules, archetype suggestions and the table that crosses them with topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import fixed as X
from corpuslens.functions.ids import stable_id
from corpuslens.functions.rules import all_matches, first_match


def register_violations(rows: DataFrame) -> DataFrame:
    """(deal_id, attribute, rule): every rule of the evidence register that a row breaks, and every attribute a deal lacks."""
    known = (F.col("machine_value") != "unknown") & (F.col("evidence_basis") != "unknown")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    same = F.count(F.lit(1)).over(Window.partitionBy("deal_id", "attribute"))
    rules = [
        ("missing_required", blank("deal_id") | blank("attribute") | blank("machine_value") | blank("evidence_basis") | blank("evidence_status")),
        ("unknown_attribute", ~F.col("attribute").isin(*X.ATTRIBUTES)),
        ("unknown_basis", ~F.col("evidence_basis").isin(*X.EVIDENCE_BASES)),
        ("unknown_status", ~F.col("evidence_status").isin(*X.EVIDENCE_STATUSES)),
        ("unknown_excerpt_kind", ~F.col("excerpt_kind").isin(*X.EXCERPT_KINDS)),
        ("duplicate_attribute", F.col("_same") > 1),
        ("claim_not_verbatim", known & (F.col("excerpt_kind") != "verbatim")),
        ("claim_without_document", known & blank("document_id")),
        ("claim_without_source", known & ~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False))),
        ("claim_without_excerpt", known & blank("evidence_excerpt")),
        ("unknown_value_with_status", (F.col("machine_value") == "unknown") & (F.col("evidence_status") != "unknown")),
        ("talent_not_yes_no_unknown", F.col("attribute").isin("talent_motive_explicit", "talent_salience_signal") & ~F.col("machine_value").isin("yes", "no", "unknown")),
    ]
    broken = rows.withColumn("_same", same).select("deal_id", "attribute", F.explode(all_matches(rules)).alias("rule"))
    have = rows.groupBy("deal_id").agg(F.collect_set("attribute").alias("_have"))
    lacking = have.select("deal_id", F.explode(F.array_except(F.array(*map(F.lit, X.ATTRIBUTES)), "_have")).alias("attribute"), F.lit("missing_attribute").alias("rule"))
    return broken.unionByName(lacking)


def suggested_archetypes(attributes: dict[str, Column]) -> Column:
    """struct(archetypes, ambiguity) from coded attributes; several values of one attribute are joined by ``|``."""
    parts = lambda c: F.filter(F.split(F.coalesce(attributes[c], F.lit("")), r"\|"), lambda p: p != "")
    scope, workforce = parts("scope_and_control"), parts("workforce_movement")
    talent, salience = attributes["talent_motive_explicit"], attributes["talent_salience_signal"]
    open_scope = (F.size(scope) == 0) | ((F.size(F.array_distinct(scope)) == 1) & F.array_contains(scope, "unknown"))
    control = F.arrays_overlap(scope, F.array(F.lit("control_transferred"), F.lit("control_of_purchased_assets_only")))
    base = F.when(F.array_contains(scope, "business_unit_assets"), "asset_acquisition").otherwise("full_acquisition")
    named = F.exists(workforce, lambda p: p.startswith("named_"))
    outcome = lambda ambiguity, *labels: F.struct(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in labels)).alias("archetypes"), F.lit(ambiguity).alias("ambiguity"))
    return (
        F.when(open_scope, outcome("high", "unknown"))
        .when(~control & (attributes["ip_treatment"] == "licensed") & (F.size(workforce) > 0), outcome("medium", "hire_and_license", "reverse_acquihire"))
        .when(~control, outcome("high", "mixed"))
        .when((talent == "yes") & (attributes["business_product_continuity"] == "discontinued"), outcome("low", "traditional_acquihire"))
        .when(talent == "yes", outcome("medium", base, "acquisition_with_talent_emphasis"))
        .when(salience == "yes", outcome("medium", base, "acquisition_with_talent_salience"))
        .when(named | (talent == "unknown"), outcome("medium", base))
        .otherwise(outcome("low", base))
    )


def deal_architecture(register: DataFrame) -> DataFrame:
    """One row a deal: its attributes side by side, their suggested archetypes, counts of evidence and the evidence's ids."""
    ident = F.concat(F.lit("arch_"), F.substring(F.sha2(F.concat_ws(":", "deal_id", "attribute"), 256), 1, 12))
    order = F.array_position(F.array(*map(F.lit, X.ATTRIBUTES)), F.col("attribute"))
    value = lambda a: F.max(F.when(F.col("attribute") == a, F.col("machine_value"))).alias(a)
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), ident.alias("i")))), lambda s: s["i"])
    wide = register.groupBy("deal_id").agg(
        *(value(a) for a in X.ATTRIBUTES), F.count_if(F.col("evidence_basis") == "direct_passage").alias("direct_evidence_count"),
        F.count_if(F.col("evidence_basis") == "inferred_from_legal_form").alias("inferred_evidence_count"), F.count_if(F.col("machine_value") == "unknown").alias("unknown_attribute_count"), F.concat_ws("; ", ids).alias("evidence_ids"),
    )
    found = suggested_archetypes({a: F.col(a) for a in X.ATTRIBUTES})
    return wide.withColumn("_s", found).select("*", F.concat_ws("; ", "_s.archetypes").alias("machine_suggested_archetypes"), F.col("_s.ambiguity").alias("archetype_ambiguity")).drop("_s")


def architecture_topics(architecture: DataFrame, topics: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each deal's architecture beside each of its topics, with the heaviest primary passage as example; deals without topics keep a row that says so.

    architecture: deal_id, other_id (the id in the topic layer, if it differs), ...; topics: deal_id, topic_id, normalized_weight;
    assignments: deal_id, topic_id, passage_id, topic_weight, primary_topic.
    """
    example = assignments.where("primary_topic").groupBy(F.col("deal_id").alias("_ed"), F.col("topic_id").alias("_et")).agg(F.min_by("passage_id", F.struct(-F.col("topic_weight"), "passage_id")).alias("example_passage_id"))
    cells = topics.select(F.col("deal_id").alias("_td"), "topic_id", "normalized_weight").join(example, (F.col("_td") == F.col("_ed")) & (F.col("topic_id") == F.col("_et")), "left").drop("_ed", "_et")
    keyed = architecture.withColumn("_key", F.coalesce(F.nullif("other_id", F.lit("")), "deal_id"))
    return keyed.join(cells, F.col("_key") == F.col("_td"), "left").withColumn("zero_state", F.when(F.col("_td").isNull(), "deal_absent_from_topic_matrix").otherwise("")).drop("_key", "_td")


def unmatched(architecture: DataFrame, topics: DataFrame) -> DataFrame:
    """(deal_id, side): deals of one layer that the other lacks."""
    key = F.coalesce(F.nullif("other_id", F.lit("")), "deal_id")
    a, t = architecture.select(key.alias("deal_id")).distinct(), topics.select("deal_id").distinct()
    return a.join(t, "deal_id", "left_anti").withColumn("side", F.lit("without_topics")).unionByName(t.join(a, "deal_id", "left_anti").withColumn("side", F.lit("without_architecture")))


def repaired_quotes(rows: DataFrame, bodies: DataFrame, pattern: Column) -> DataFrame:
    """Paraphrased excerpts replaced by what ``pattern`` finds in their document; without a match the claim is withdrawn to unknown."""
    held = bodies.select(F.col("document_id").alias("_d"), "body")
    joined = rows.join(held, F.col("document_id") == F.col("_d"), "left")
    quote = F.nullif(F.regexp_substr(F.coalesce("body", F.lit("")), pattern), F.lit(""))
    needs = F.col("excerpt_kind") == "paraphrase"
    status = first_match([("kept", ~needs), ("repaired", quote.isNotNull())], "withdrawn")
    out = joined.withColumns({"repair": status, "_quote": quote})
    gone = F.col("repair") == "withdrawn"
    return out.withColumns(
        {
            "evidence_excerpt": F.when(gone, "").when(F.col("repair") == "repaired", F.trim("_quote")).otherwise(F.col("evidence_excerpt")),
            "excerpt_kind": F.when(F.col("repair") == "repaired", "verbatim").otherwise(F.col("excerpt_kind")),
            "machine_value": F.when(gone, "unknown").otherwise(F.col("machine_value")),
            "evidence_status": F.when(gone, "unknown").otherwise(F.col("evidence_status")),
        }
    ).drop("_d", "_quote", "body")


def evidence_ids(register: DataFrame) -> DataFrame:
    return register.withColumn("evidence_id", stable_id("arch_", "deal_id", "attribute", length=12))
