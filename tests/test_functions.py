from datetime import date

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import rules as R
from corpuslens.functions import text as T
from corpuslens.functions.links import fragment_link
from corpuslens.operators import documents as D
from corpuslens.operators.components import connected_components
from corpuslens.operators.topics import agglomerative, align, nmf
from corpuslens.sources.tables import read_export, registry_rows, unique_headers


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    assert one(spark, T.token_count(F.lit("Employees will vest."))) == (3,)
    assert one(spark, T.employer_name(F.lit("  Acme,  R&D---LLC "))) == ("ACME R D LLC",)
    assert one(spark, T.company_name(F.lit("The Delta Holdings, Inc."))) == ("delta holdings",)
    assert one(spark, T.company_name(F.lit("THE Delta Corp. Ltd"))) == ("delta",)
    assert one(spark, T.distinctive_tokens(F.lit("New Delta Software Group of Ohio"))) == (["delta", "ohio"],)
    assert one(spark, T.padded_number(F.lit("CIK 123"))) == ("0000000123",)
    assert one(spark, T.phrase_count(F.lit("A retention-bonus and Retention bonuses, retention bonus."), "retention bonus")) == (2,)
    assert one(spark, T.model_text(F.lit("Straße at https://x.org/1 cost 1,000!"))) == ("strasse at urltoken cost numbertoken",)
    assert one(spark, T.shingles(F.array(*map(F.lit, "ab")))) == (["a", "b"],)


def test_windows_and_rules(spark):
    w = lambda a, e: one(spark, R.event_window(F.lit(a).cast("date"), F.lit(e).cast("date")))[0]
    assert tuple(w("2020-01-31", "2020-03-01")) == (date(2020, 1, 1), date(2020, 3, 31), "closing_observed")
    assert w("2020-01-31", None).status == "closing_missing" and w("2020-01-31", "2019-01-01").status == "invalid_effective_date"
    assert one(spark, R.parse_date(F.lit("12/31/2020")), R.parse_date(F.lit("20201231"))) == (date(2020, 12, 31),) * 2
    with pytest.raises(Exception, match="not a date"):
        one(spark, R.parse_date(F.lit("soon")))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    found = dict(connected_components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_evidence_prefers_the_longest_term(spark):
    docs = spark.createDataFrame([(1, "A retention bonus was offered."), (2, "investing determination"), (3, None)], "i int, t string")
    found = D.token_hits(docs, "i", "t", {"pay": ["retention", "retention bonus"], "end": ["vesting", "termination"]}).collect()
    assert [tuple(r) for r in found] == [(1, "pay", "retention bonus", 1, 3)]


def test_leaf_blocks():
    found = D.leaf_blocks("<div><h2>Head</h2><p>One<p>Two <b>x</b><ul><li>A<li>B</ul></div><script>no</script>")
    assert [(b["tag"], b["text"], b["heading"]) for b in found] == [("h2", "Head", True), ("p", "One", False), ("p", "Two x", False), ("li", "A", True), ("li", "B", True)]


def test_links():
    link = lambda u, q: tuple(fragment_link(u, q).values())
    assert link("https://x.org/a?b=1", "well-known words") == ("https://x.org/a?b=1#:~:text=well%2Dknown%20words", "ok", "exact")
    assert link("https://x.org/a#top:~:text=old", "some\u200b new\u00a0words")[0] == "https://x.org/a#top:~:text=some%20new%20words"
    for url, text, status in ((None, "enough words here", "missing_url"), (" ", "enough words here", "missing_url"), ("ftp://x/y", "enough words here", "non_absolute_url"), ("/a/b", "enough words here", "non_absolute_url"), ("https://x.org/a.PDF", "enough words here", "document_format"), ("https://x.org", " \u200b", "empty_quote"), ("https://x.org", "too short", "quote_too_short")):
        assert link(url, text) == ("", f"unsupported_{status}", "")
    long = " ".join(f"word{k}" for k in range(100))
    url, status, kind = link("https://x.org/", long)
    first, last = url.split("text=")[1].split(",")
    assert (status, kind) == ("ok", "range") and long.startswith(first.replace("%20", " ") + " ") and long.endswith(" " + last.replace("%20", " ")) and len(first.replace("%20", " ")) <= 150


def test_topic_model_recovers_blocks():
    import numpy as np

    X = np.kron(np.eye(2), np.ones((4, 3)))
    W, H, error = nmf(X, 2, 7, iterations=200)
    assert error < 0.05 and align(H, H[::-1]) == (1, 0)
    assert len(set(agglomerative(X, 2)[:4])) == 1 and len(set(agglomerative(X, 2))) == 2


def test_sources(spark, tmp_path):
    assert unique_headers(["Value\nof Transaction", "Value of Transaction"]) == ["Value of Transaction", "Value of Transaction__2"]
    path = tmp_path / "x.csv"
    path.write_text('made today,,\n"Deal\nNo",Buyer,Buyer\n1,A,B\n,,\n2,"C\nD",E\n')
    rows = read_export(spark, str(path), metadata_rows=1).orderBy("source_row").collect()
    assert [(r["source_row"], r["Deal No"], r["Buyer__2"]) for r in rows] == [(3, "1", "B"), (5, "2", "E")]
    frame = spark.createDataFrame([('{"fields": ["a", "b"], "data": [[1, "x"], [2]]}',)], "j string")
    assert [r.record for r in registry_rows(frame, "j").collect()] == [{"a": "1", "b": "x"}]
