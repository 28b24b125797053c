import collections
import io
import itertools
import re
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import fixed as X
from corpuslens.operators import architecture as A
from corpuslens.operators import corpus as C
from corpuslens.operators import documents as D
from corpuslens.operators import eligibility as E
from corpuslens.operators import relational as O
from corpuslens.operators import reporting as R
from corpuslens.operators import reviews as V
from corpuslens.operators import screening as S
from corpuslens.operators import topic_models as M
from corpuslens.operators import topics as P
from corpuslens.operators import wording as W
from corpuslens.sources import registers as G


def test_blocks_carry_headings_and_offsets(spark):
    long = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, "<h2>Pay</h2><p>One two</p><p>" + long + "</p>"), (2, "First para\n\nSecond para"), (3, "")], "id int, text string")
    rows = C.document_blocks(docs, "id", "text", most_words=20).orderBy("id", "block_index").collect()
    assert [(r.id, r.block_index, r.heading) for r in rows] == [(1, 0, "Pay"), (1, 1, "Pay"), (1, 2, "Pay"), (1, 3, "Pay"), (2, 0, None), (2, 1, None)]
    whole = "One two\n" + long
    assert all(whole[r.char_start : r.char_end] == r.text for r in rows if r.id == 1)
    with pytest.raises(ValueError):
        C.document_blocks(docs, "id", "text", most_words=5)


def test_passages_merge_inside_a_heading_and_equal_texts_keep_a_real_heading(spark):
    blocks = [(1, 0, "Table of Contents", "the severance plan", 0, 18), (1, 1, "Table of Contents", "weather", 19, 26), (1, 2, "Pay", "wages", 27, 32), (2, 0, "Employee Matters", "the severance  plan", 0, 19)]
    frame = spark.createDataFrame(blocks, "doc int, block_index int, heading string, text string, char_start long, char_end long")
    found = C.passages(frame, spark.createDataFrame([(1, "a"), (2, "b")], "doc int, deal string"), "doc", context=1)
    assert sorted((r.doc, r.block_start, r.block_end) for r in found.collect()) == [(1, 0, 1), (1, 2, 2), (2, 0, 0)]
    one = C.passages(frame, spark.createDataFrame([(1, "a"), (2, "b")], "doc int, deal string"), "doc")
    canonical, occurrences = C.deduplicated(one, ["deal", "doc", "block_start", "block_end"], deal="deal", document="doc")
    assert sorted((r.doc, r.heading, r.occurrence_count) for r in canonical.collect()) == [(1, "Pay", 1), (2, "Employee Matters", 2)]
    assert occurrences.count() == 3 and occurrences.select("occurrence_id").distinct().count() == 3
    with pytest.raises(Exception, match="unknown passage"):
        C.representative_sources(occurrences, canonical.where("doc = 1"), "deal", [F.col("doc")]).collect()


def test_equal_texts_are_no_window_and_candidates_are_made_once(spark):
    blocks = [(d, k, None if (d + k) % 3 else "Pay", "the severance plan" if k % 2 else f"wages {d} {k}" if d % 2 else "weather", 20 * k, 20 * k + 18) for d in range(20) for k in range(4)]
    frame = spark.createDataFrame(blocks, "doc int, block_index int, heading string, text string, char_start long, char_end long")
    docs = spark.createDataFrame([(d, d // 2) for d in range(20)], "doc int, deal int")
    matched = F.size(C.screen_terms(F.col("text"))) > 0
    found = C.passages(frame, docs, "doc")
    ranges = C._ranges(frame, "doc", matched, 0)
    assert sorted(map(tuple, found.select(ranges.columns).fillna("").collect())) == sorted(map(tuple, ranges.fillna("").collect()))
    canonical, occurrences = C.deduplicated(found, ["deal", "doc", "block_start", "block_end"], deal="deal", document="doc")
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (canonical, occurrences)]
    assert not any("Window" in p or "rlike" in p.lower() and "severance" in p for p in plans)
    rows = found.collect()
    best = {}
    for r in sorted(rows, key=lambda r: (r.heading is None, r.deal, r.doc, r.block_start)):
        best.setdefault(r.content_sha256, (r.deal, r.doc, r.block_start, sum(x.content_sha256 == r.content_sha256 for x in rows)))
    assert {r.content_sha256: (r.deal, r.doc, r.block_start, r.occurrence_count) for r in canonical.collect()} == best
    assert occurrences.count() == len(rows) and max(n for *_, n in best.values()) == 40


def test_hits_need_an_anchor_in_their_paragraph(spark):
    text = "Orion builds machine learning tools.\n\nElsewhere deep learning is common; robotics too."
    rows = spark.createDataFrame([(1, text, "Orion Labs Inc"), (2, text, "AI Data Labs"), (3, None, "Orion")], "id int, text string, name string")
    got = {r.id: r for r in S.document_screen(rows, "text", "name").collect()}
    assert (got[1].total_weight, got[1].qualifies, [h.matched for h in got[1].hits]) == (5, True, ["machine learning"])
    assert not got[2].qualifies and not got[3].hits
    free = S.document_screen(rows.where("id = 1"), "text").first()
    assert [h.matched for h in free.hits] == ["machine learning", "deep learning", "robotics"] and free.total_weight == 10
    assert all(text[h.start : h.end].lower() == h.matched for h in free.hits)


def test_no_hit_is_lost_where_patterns_are_left_out(monkeypatch):
    phrases = ["AI/ML", "ai / ml", "AI-powered", "Aİ models", "a\u0131 platform", "robotic\u017f", "Robotics", "LLMs", "\u212aing of machine learning", "deep  learning", "Self-Driving", "air", "ΣΑΣ"]
    for text in [". ".join(p) for n in (1, 2) for p in itertools.permutations(phrases, n)]:
        want = [(lo + m.start(), lo + m.end(), label) for lo, hi in S.sentence_spans(text) for label, _, pattern, _ in S._PATTERNS for m in pattern.finditer(text[lo:hi])]
        assert sorted((h["start"], h["end"], h["label"]) for h in S.text_hits(text)) == sorted(want)
        names = ["ai", "robotics", "king", "σας"]
        assert [(a["start"], a["end"]) for a in S.text_anchors(text, names)] == [m.span() for n in names for m in re.finditer(rf"(?<!\w){n}(?!\w)", text, re.IGNORECASE)]
    monkeypatch.setattr(S, "sentence_spans", None)  # a text without any pattern's letters is not cut into sentences
    assert S.text_hits("The weather was mild. " * 9) == []


def test_joining_excerpts_are_sentences(spark):
    rows = spark.createDataFrame([("It rained. Our engineers will join the group. Done.",), ("Nothing here.",)], "t string")
    got = [r.join_excerpts for r in S.talent_signals(rows, "t").collect()]
    assert got == [["Our engineers will join the group."], []]


def test_claims_are_found_unless_negated_or_quoted():
    text = "Pay drives turnover. It does not predict anything.\n> The deal caused a rise.\nThis proves that."
    assert [(c, p) for c, p, _ in R.claim_issues(text)] == [("causal", "drives"), ("unsupported_certainty", "proves")]
    lines = "d1 rose [x](https://www.filings.example/a)\nd1 fell\n> d2 said\nd2: zero"
    assert R.unlinked_claims(lines, {"d1", "d2"}, "filings.example", "zero") == [("d1", "d1 fell")]


def test_claim_lint_agrees_with_claim_issues(spark):
    texts = ["Pay drives turnover and leads to exits. It never caused any.", "> It proves all.", "A forecast is not a cause; it forecasts, forecasts and predicts.", ""]
    got = {(r.i, r.category): r.n for r in R.claim_lint(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect()}
    want = {}
    for i, t in enumerate(texts):
        for c, _, _ in R.claim_issues(t):
            want[i, c] = want.get((i, c), 0) + 1
    assert got == want


def test_claim_lint_reads_a_long_sentence_once(spark):
    plain = "word and word " * 4000
    texts = [plain, plain + "it proves a case", plain + "it never proves, it drives pay " + plain + "which it causes"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    began = time.time()
    got = {(r.i, r.category): r.n for r in R.claim_lint(rows, "i", "t").collect()}
    assert got == {(1, "unsupported_certainty"): 1, (2, "causal"): 1}
    assert got == collections.Counter((i, c) for i, t in enumerate(texts) for c, *_ in R.claim_issues(t))
    assert time.time() - began < 60  # a search from every character would take many minutes


def test_texts_without_a_terms_words_meet_no_pattern_and_no_match_is_lost(spark):
    terms = sorted({t for v in X.LEXICONS.values() for t in v} | {*X.TONE_HEDGES, *X.TONE_NEGATIVE, *X.TONE_PROTECTIONS})
    odd = {"s": "ſ", "i": "ı", "k": "K"}
    shapes = [lambda t: t, str.upper, lambda t: t.replace("i", "İ"), lambda t: "".join(odd.get(c, c) for c in t), lambda t: t.replace(" ", "-"), lambda t: f"x{t}"]
    rows = spark.createDataFrame([(t, f"({f(t)}), {f(t)}.") for t in terms for f in shapes] + [(terms[0], None)], "term string, t string")
    for flexible in (False, True):
        pairs = [(F.regexp_count("t", F.lit(W.whole(t, flexible=flexible))), W.T.may_hold(W.T.folded(F.col("t")), t)) for t in terms]
        for lo in range(0, len(terms), 40):
            lost = rows.agg(*(F.count_if((n > 0) & ~held) for n, held in pairs[lo : lo + 40])).first()
            assert not any(lost)
    counted = rows.select(W.occurrences(F.col("t"), ("risk", "stay bonus"), flexible=True).alias("n"), "term").where("n > 0")
    assert {r.term for r in counted.collect()} == {"risk", "stay bonus"}
    plan = rows.select(W.occurrences(F.col("t"), ("risk",)))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "Contains" in plan


def test_passage_lint_finds_what_rules_share_once(spark):
    rows = spark.createDataFrame([("Pay", "Key  employees receive a retention bonus upon closing."), (None, "Revenue  12 13 14 15 16 17 18 19"), ("Privacy", None)], "h string, t string")
    frame = rows.select(R.passage_lint(F.col("t"), F.col("h")).alias("r"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2 and plan.count("upon closing|will receive") == 1 and plan.count("employee|employees|worker|workers|executive|executives|founder") == 1
    got = [r.r for r in frame.collect()]
    assert got[0] == [] and "numeric_table_noise" in got[1] and got[2][:2] == ["too_short", "privacy_or_ip_noise"]


def test_seeds_of_one_fallback_key_are_dealt_to_many_tasks(spark):
    seeds = spark.range(400).select("id", F.concat(F.lit("t"), "id").alias("tick"), F.when(F.col("id") % 4 > 0, F.lit(7)).alias("nk")).coalesce(1)
    registry = spark.createDataFrame([("t9", 7, 1), ("x", 7, 2), ("y", 7, 3), ("t8", None, 4), ("z", 5, 5)], "tick_ string, nk_ int, v int").coalesce(1)
    want = sorted([(8, 4, "exact_tick"), (9, 1, "exact_tick")] + [(i, v, "exact_nk") for i in range(400) if i % 4 and i != 9 for v in (1, 2, 3)] + [(i, -1, "unresolved") for i in range(0, 400, 4) if i != 8])
    for most in (0, 100):
        found = O.resolve_entities(seeds, registry, seed_id="id", first=("tick", "tick_"), fallback=("nk", "nk_"), value="v", most_sent=most)
        assert sorted(map(tuple, found.fillna(-1).collect())) == want
        held = found.withColumn("p", F.spark_partition_id()).where("method = 'exact_nk'").groupBy("p").count().collect()
        assert len(held) >= 4 and max(r["count"] for r in held) < 600


def test_grams_are_counted_from_one_shuffle_of_pairs(spark):
    texts = ["a b a b a", "b", "", None, "a a a a", "b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = P.gram_counts(docs, F.filter(F.split("t", " "), lambda w: w != ""), 2)
    want = collections.Counter()
    for words in ((t or "").split() for t in texts):
        want.update([*words, *(" ".join(p) for p in itertools.pairwise(words))])
    assert sorted(map(tuple, found.collect())) == sorted((g, n) for g, n in want.items() if n >= 2)
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_sets_of_shingles_are_made_once(spark):
    base = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " end"), (4, "other words here today"), (5, ""), (6, None), (7, "one two")], "i int, t string")
    tokens = F.filter(F.split("t", " "), lambda w: w != "")
    found = D.near_duplicate_families(docs, "i", tokens)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 1), (6, 6, 1), (7, 7, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "array_sort" not in plan  # what is left reads ids and digests


def test_rows_of_the_topic_fit_are_made_once(spark):
    matrix = spark.createDataFrame([(d, t, 0.5 + 0.01 * d) for d in range(12) for t in (("pay", "bonus") if d % 2 else ("code", "model"))], "i int, term string, value double")
    assigned, topics = P.fit_topics(matrix, "i", k=2, terms=["pay", "bonus", "code", "model"])
    plan = assigned._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Aggregate" not in plan
    best = {r.i: r.topic for r in assigned.where("is_primary").collect()}
    assert len(best) == 12 and len({best[i] for i in range(0, 12, 2)}) == len({best[i] for i in range(1, 12, 2)}) == 1 and best[0] != best[1]


def test_pictures_and_tables(spark):
    svg = R.cloud_svg([("pay", 9), ("bonus", 4), ("<b>", 1)])
    assert svg == R.cloud_svg([("<b>", 1), ("bonus", 4), ("pay", 9)]) and "&lt;b&gt;" in svg and svg.count("<text") == 3
    assert R.heatmap_svg([("d1", "t1", 0.5), ("d2", "t1", 1.0)]).count("<rect") == 2
    assert R.markdown_table(spark.createDataFrame([("a|b\nc", 1.5)], "x string, y double")) == "| x | y |\n| --- | --- |\n| a\\|b c | 1.5 |\n"
    row = spark.range(1).select(R.plain_number(F.lit(1200.5)), R.plain_number(F.lit(3.0)), R.percent(F.lit(0.1234))).first()
    assert tuple(row) == ("1200.5", "3", "12.3%")


def test_a_corpus_never_borrows_a_verdict():
    audit = {"candidate_csv_sha256": "c", "sample_counts": {"included": 3, "excluded": 2}}
    score = {"candidate_csv_sha256": "c", "labels_present": True, "labels_are_human_attested": True, "audit_manifest_sha256": "h", "completed_item_count": 5, "sample_counts": {"included": 3, "excluded": 2}, "audit_status": "scored_human_labels", "gate_status": "pass"}
    state = lambda s=None, a=audit, **more: V.corpus_state(a, None if s is None else score | s, **({"expected": "c", "audit_hash": "h"} | more))["status"]
    assert state({}) == "accepted_human_corpus_validation" and state({"gate_status": "fail"}) == "failed_human_corpus_validation"
    for change in ({"labels_present": False}, {"audit_manifest_sha256": "x"}, {"completed_item_count": 4}, {"gate_status": "?"}, {"sample_counts": {"included": 1}}):
        assert state(change) == "pending_human_corpus_validation"
    assert state({}, expected="other") == state() == "pending_human_corpus_validation" and V.corpus_state(None, None)["status"] == "no_corpus_validation"
    assert V.linked_manifests({"audit_manifest_sha256": "h", "seed": 1}, {"seed": 2}, "h", {"seed": "seed"}) == ["seed"]


def test_refusals(spark):
    rows = spark.createDataFrame([("1", "confirmed", "confirmed", " ")], "id string, cik string, t string, tid string")
    with pytest.raises(Exception, match="confirmed target"):
        E.approved_deals(rows, {"cik": "confirmed"}, target_status="t", target_id="tid").collect()
    with pytest.raises(Exception, match="repeated key"):
        E.selected_roster(spark.createDataFrame([("a", "selected"), (" a", "Selected")], "k string, s string"), "k", "s").collect()
    with pytest.raises(Exception, match="not in the corpus"):
        C.subset(spark.createDataFrame([(1,)], "i int"), spark.createDataFrame([(2,)], "passage_id int"), "i").collect()
    with pytest.raises(Exception, match="not selected"):
        V.audit_rows(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2)], "k int, n int"), spark.createDataFrame([(3, "x")], "k int, review_status string"), "k").collect()


def test_report_gate(spark):
    d = spark.createDataFrame([("pass",), ("pass",), ("not_applicable",)], "status string")
    assert V.report_gate(d, "accepted_human_corpus_validation").first().gate_passed
    got = V.report_gate(d.unionByName(spark.createDataFrame([("warning",)], "status string")), "pending").first()
    assert not got.gate_passed and got.corpus_diagnostic == "warning"


def test_refits_recover_clear_topics(spark):
    rng = np.random.default_rng(0)
    parts = np.kron(np.eye(3), np.ones((1, 4)))
    x = np.vstack([parts[k % 3] + 0.05 * rng.random(12) for k in range(60)])
    deals = [f"d{k % 5}" for k in range(60)]
    h = M.factorize(x, 3, 1, 60)[1]
    for refits, n in ((M.leave_one_out(spark, x, deals, h, iterations=60), 5), (M.bootstrap(spark, x, deals, h, replicates=6, iterations=60), 6)):
        rows = M.refit_summary(refits).collect()
        assert len(rows) == 3 and all(r.refits == n and r.recovery_rate == 1 for r in rows)
    assert M.residual_terms(x, *M.factorize(x, 1, 1, 60), [f"t{k}" for k in range(12)], range(0, 60, 3))[0][0] in {"t0", "t1", "t2", "t3"}


def test_alignment_is_the_best_permutation():
    rng = np.random.default_rng(1)
    for k in (2, 3, 4):
        s = rng.random((k, k))
        best = max(itertools.permutations(range(k)), key=lambda p: sum(s[t, p[t]] for t in range(k)))
        assert M.alignment(s) == best
    assert M.alignment(np.ones((3, 3))) == (0, 1, 2)


def test_clusters():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.1, (12, 3)) for c in ((0, 0, 3), (3, 0, 0), (0, 3, 0))] + [rng.normal(9, 4, (3, 3))])
    labels = M.density_clusters(x, least=5)
    assert len(set(labels[:36]) - {-1}) == 3 and all(len(set(labels[k : k + 12]) - {-1}) == 1 for k in (0, 12, 24))
    assert (M.density_clusters(x[:6]) == -1).all()
    flat = M.agglomerate(np.vstack([x[:36], np.zeros((1, 3))]), 3)
    assert flat[-1] == -1 and [len(set(flat[k : k + 12])) for k in (0, 12, 24)] == [1, 1, 1] and len(set(flat[:36])) == 3
    assert M.latent(x, 2).shape == (39, 2) and M.half_stability([{1, 2}, {3}], [{3}, {1}]) == pytest.approx(0.75)
    w, h = M.nndsvda(np.abs(x), 2)
    assert (w > 0).all() and (h > 0).all()


def test_factors_stay_positive_and_zero_rows_have_no_topic():
    x = np.vstack([np.kron(np.eye(2), np.ones((3, 4))), np.zeros((1, 8))])
    w, h, _ = P.nmf(x, 2, 3)
    assert w.min() >= 1e-12 and h.min() >= 1e-12 and (P.project(x, h)[-1] == 0).all()


def test_several_confirmed_ids_are_an_error(spark):
    from corpuslens.operators.relational import best_match

    rows = spark.createDataFrame([("a", 1, 1, True), ("a", 2, 1, True), ("b", 3, 1, False), ("b", 4, 1, False)], "g string, i int, r int, c boolean")
    with pytest.raises(Exception, match="several confirmed"):
        best_match(rows, "g", "i", F.col("r"), confirmed=F.col("c")).collect()
    got = best_match(rows.where("g = 'b'"), "g", "i", F.col("r"), confirmed=F.col("c")).collect()
    assert [(r.g, r.i, r.status) for r in got] == [("b", None, "ambiguous")]


def test_register_of_a_deal(spark):
    full = [("d", a, "yes" if "talent" in a else "control_transferred", "direct_passage", "direct", "verbatim", "doc", "https://x.example/", "words") for a in X.ATTRIBUTES]
    frame = spark.createDataFrame(full, "deal_id string, attribute string, machine_value string, evidence_basis string, evidence_status string, excerpt_kind string, document_id string, source_url string, evidence_excerpt string")
    assert A.register_violations(frame).count() == 0
    assert A.deal_architecture(frame).first().machine_suggested_archetypes == "full_acquisition; acquisition_with_talent_emphasis"
    assert [(r.attribute, r.rule) for r in A.register_violations(frame.where(F.col("attribute") != "ip_treatment")).collect()] == [("ip_treatment", "missing_attribute")]


def test_index_pages(spark):
    page = "<table><tr><td>x</td></tr></table><table><tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th></tr><tr><td>1</td><td>Body</td><td><a href='/a/b.htm?x=1'>b.htm</a></td><td>8-K</td></tr><tr><td>2</td><td>Old</td><td><a href='/a/e.htm'>e</a></td><td>EX-1</td></tr><tr><td>3</td><td>New</td><td><a href='/a/e.htm'>e</a></td><td>EX-2.1</td></tr><tr><td>4</td></tr></table>"
    rows = spark.createDataFrame([(page, "b.htm"), (None, None)], "p string, f string").select(G.documents_of_index("p", "f").alias("d")).collect()
    assert [(x.document_name, x.description, x.document_type, x.is_primary) for x in rows[0].d] == [("b.htm", "Body", "8-K", True), ("e.htm", "New", "EX-2.1", False)] and rows[1].d == []


def workbook(rows) -> bytes:
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = lambda row, r: "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>' + "".join(f'<row r="{r}">{cells(row, r)}</row>' for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([("EMPLOYER_NAME", "x", "Case_Status", "NEW_EMPLOYMENT"), ("Delta, LLC", "", "Certified", "1,000"), ("delta llc", "", "Certified - Withdrawn", "2"), ("Delta LLC", "", "Denied", "9")]))
    rows = G.workbooks(spark, str(tmp_path), ["EMPLOYER_NAME", "CASE_STATUS", "NEW_EMPLOYMENT"])
    got = G.cell_totals(rows, employer="employer_name", status="case_status", amount="new_employment", aliases=["DELTA LLC"]).first()
    assert (got.employer, got.cases, float(got.total)) == ("DELTA LLC", 2, 1002.0)
    with pytest.raises(ValueError):
        list(G.sheet_rows(workbook([("A",)]), ["B"]))


def test_registers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("deal_id,url\n a ,x\nb,\n")
    assert [tuple(r) for r in G.checked_csv(spark, str(tmp_path / "r.csv"), ["deal_id"], unique=["deal_id"]).collect()] == [("a", "x"), ("b", "")]
    with pytest.raises(ValueError, match="lacks"):
        G.checked_csv(spark, str(tmp_path / "r.csv"), ["nope"])
    assert G.physical_lines(spark, str(tmp_path / "r.csv")) == 2
    assert G.settings("[gate]\nleast = 10", {"gate.least": int})["gate"]["least"] == 10
    with pytest.raises(TypeError):
        G.settings("[gate]\nleast = true", {"gate.least": int})
    row = spark.range(1).select(G.code_rationale(F.lit("7372"), {"7372": "software"}, "v1"), G.code_rationale(F.lit("1"), {"7372": "software"}, "v1")).first()
    assert tuple(row) == ("v1: 7372 software", None)


def test_leaf_blocks_against_the_pages(spark):
    """The pages' own layout: headings and paragraphs, and nothing twice."""
    page = "<html><body><nav><ul><li><a>Home</a></li></ul></nav><div class=ad>Buy</div><article><h1>T</h1><p><b>All bold</b></p><p>One<br>two</p></article></body></html>"
    assert [(b["tag"], b["text"], b["heading"]) for b in D.leaf_blocks(page)] == [("li", "Home", False), ("div", "Buy", False), ("h1", "T", True), ("p", "All bold", True), ("p", "One two", False)]


def test_runs_resume_and_snapshots_are_bounded(tmp_path, spark):
    from corpuslens.sources import sinks

    log, ran = sinks.RunLog(str(tmp_path / "run")), []
    assert log.stage("a", lambda: ran.append(1)) and not sinks.RunLog(str(tmp_path / "run")).stage("a", lambda: ran.append(2))
    with pytest.raises(ZeroDivisionError):
        log.stage("b", lambda: 1 / 0)
    assert ran == [1] and [x.split('"event": "')[1][:4] for x in (tmp_path / "run/events.jsonl").read_text().splitlines()] == ["done", "fail"]
    made = sinks.publish({"a/x.csv": b"1", "y.tmp": b"2"}, str(tmp_path / "out"), most_bytes=10, excluded=["*.tmp"])
    assert made["excluded"] == ["y.tmp"] and (tmp_path / "out/a/x.csv").read_bytes() == b"1"
    with pytest.raises(ValueError):
        sinks.publish({"a": b"123"}, str(tmp_path / "out2"), most_bytes=2)
    frame = spark.createDataFrame([(2, ["a", "b"], None), (1, [], "x")], "i int, l array<string>, s string")
    sinks.write_ordered_csv(frame, str(tmp_path / "csv"), ["s", "i", "l"], ["i"], compression="gzip")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).fillna("").collect()] == [("x", "1", ""), ("", "2", "a|b")]
    assert sinks.content_hash(frame) == sinks.content_hash(frame.repartition(3))
