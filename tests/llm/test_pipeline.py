"""Each stage of the pipeline against a plain version of it, with clashing columns, nulls, repeated rows and empty tables."""

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from corpuslens.llm import mixing, pipeline, token_counts, toxicity
from corpuslens.llm.sieve import free_name, id_filter

LOREM = [f"w{(i * 7919) % 1000}" for i in range(400)]
SCHEMA = "doc_id long, text string, source string, score double, id long, key string, gone int, hashes string"
ITEM = " ".join(LOREM[300:330])


def texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = np.random.default_rng(0)
    some = lambda n: " ".join(LOREM[k] for k in rng.integers(0, 290, n))
    rows = [(i, some(60), "abc"[i % 3]) for i in range(160)]
    rows += [(200 + i, some(30) + " nasty vile " + some(20), "a") for i in range(60)]  # toxic ones
    base = some(120)
    rows += [(300, base, "a"), (301, base, "b"), (302, base.replace(base.split()[60], "other", 1), "b")]
    rows += [(310, f"{some(5)} {ITEM} {some(5)}", "c"), (311, ITEM.upper(), "c")]
    return [*rows, (None, some(40), None), (400, None, "a"), (401, "", "b"), (402, "  \n ", "b"), (403, "some words", "c"), (403, "some words", "c"), (404, some(5000), "a")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    rows = texts()
    spark.createDataFrame([(*r, 0.5, 7, "k", 1, "h") for r in rows], SCHEMA).repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, int("nasty" in (t or "")), 1) for i, t, _ in rows if i is not None and i < 260], "doc_id long, toxic int, quality int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_toxic_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.drop_toxic(spark, docs, folder)
    network = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {(r.doc_id, r.text): None for r in docs.collect()}
    for (i, t) in scores:
        w = toxicity.Words([(t or "").encode()])
        index, _ = w.windows()
        scores[i, t] = 1 / (1 + np.exp(-(network.scale * network.logits(w, index).max() + network.shift)))
    want = sorted(((r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id, r.text] < 0.3), key=str)
    assert kept.columns == docs.columns and of(kept) == want
    assert {r.score for r in kept.collect()} == {0.5}  # the table's own column
    gone = {i for (i, t), s in scores.items() if s >= 0.3}
    caught, flagged = sum(200 <= (i or 0) < 260 for i in gone) / 60, sum((i or 0) < 200 for i in gone) / 160
    assert caught > 0.5 and caught > 2 * flagged  # little is learned from 60 toxic texts
    assert pipeline.drop_toxic(spark, docs.limit(0), folder).count() == 0


def test_one_of_each_group_of_near_copies_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.drop_near_duplicates(spark, docs, folder)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    rows = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=str)
    named = [(i, shingles(t)) for i, t in rows if i is not None]
    top = {i: i for i, _ in named}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for (i, a), (j, b) in itertools.combinations(named, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            top[y] = x
    want = sorted(((i, t) for i, t in rows if i is None or root(i) == i), key=str)
    assert kept.columns == docs.columns and of(kept) == want
    assert pipeline.drop_near_duplicates(spark, docs.limit(0), folder).count() == 0


def test_benchmark_passages_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.drop_benchmark_leaks(spark, docs, folder)
    assert kept.columns == docs.columns and of(kept) == sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (310, 311)), key=str)


def plain_targets(sizes: dict, weights=(1, 2, 3), repeats=3) -> dict:
    """Weights in turn over the sources in order, null last; what is over the cap is shared again until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, left, out = {s: weights[k % 3] for k, s in enumerate(names)}, dict(sizes), {}
    budget = float(sum(sizes.values()))
    while left:
        unit = budget / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * unit > repeats * sizes[s]]
        for s in over or left:
            out[s] = repeats * sizes[s] if over else weight[s] * unit
        if not over:
            break
        budget -= sum(out[s] for s in over)
        left = {s: n for s, n in left.items() if s not in over}
    return out


@pytest.mark.parametrize("rows", [texts(), [(1, "a b c", "x"), (2, "a " * 1000, "y"), (3, "b " * 10, None)], [(i, "w " * 5, "abcdefg"[i % 7]) for i in range(70)], [(1, None, "a"), (2, "", "b")]])
def test_the_mix_against_a_plain_queue(spark, rows):
    """Targets by sharing again, and every source served to its target in the order of its queue."""
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double").repartition(3)
    got = mixing.mixed_documents(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = plain_targets(sizes)
    assert len(got) == len(rows)
    for s, target in targets.items():
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 1 + 1e-6
        # whole turns first: no document is a turn ahead of another of its source but for the one in service
        turns = sorted(r.taken / r.size for r in mine if r.size)
        assert not turns or turns[-1] - turns[0] <= 1 + 1e-9


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in out.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing"]
    assert not ids & {301, 302, 310, 311} and len(ids & set(range(160))) > 2 * len(ids & set(range(200, 260)))


def test_token_counts_of_a_table(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t, _ in texts()] + [(500, "ü ▁x <s> ① \n\n" * 3000)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect())
    want = [(str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows]
    assert got == sorted((*w, w[2] > 4096) for w in want)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_toxicity_of_repeated_and_null_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IN (0, 200)"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    for i in (0, 200, 403):
        assert len({r.score for r in rows if r.doc_id == i}) == 1 and sum(r.doc_id == i for r in rows) >= 2
    assert len({r.score for r in rows if r.doc_id in (400, 401, 402)}) == 1
    assert toxicity.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_filters_let_everything_of_theirs_through(spark):
    ids = spark.range(0, 40_000, 7)
    has = id_filter(ids)
    x = np.arange(40_000)
    found = has(x)
    assert found[::7].all() and found.mean() < 0.2
    assert not id_filter(ids.limit(0))(x).any()
    assert free_name("key", ["a", "KEY", "key_"]) == "key__"
