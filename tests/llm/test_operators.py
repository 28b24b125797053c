"""Brute force, edge cases and skew on small fixtures, for every operator of the subpackage."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, forest, language_model, main_text, mixing, token_counts, topk, toxicity, url_rules, warc
from corpuslens.llm.hashing import shingles, words

DOCS = "doc_id long, text string, source string"
LOREM = [f"w{(i * 7919) % 1000}" for i in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(LOREM[:120])
    near = base.replace(LOREM[60], "other", 1)
    rows = [(1, base, "a"), (2, base, "a"), (3, near, "b"), (4, "", "b"), (5, None, None), (6, "  \n\t ", "c"), (7, "Two words", "c"), (8, "two WORDS", "c"), (8, "two WORDS", "c"), (9, " ".join(LOREM * 50), "a"), (None, "no id here at all", "a")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_words_are_those_of_ascii_white_space():
    texts = [b"A b\x0b\xc3\xa9C\n", b"", None, b"x" * 3_000_000 + b" y"]
    hashes, _, _, firsts, _ = words(texts)
    assert np.diff(firsts).tolist() == [3, 0, 0, 2]
    assert words([b"a"])[0][0] == hashes[0] and words([b"y z"])[0][0] == hashes[-1]


def test_mix_meets_targets(spark, docs):
    rows = mixing.mixed_documents(docs).collect()
    assert len(rows) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in rows) == sorted(size(r.text) for r in docs.collect())
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) < len(mine) + 1
        assert all(0 <= r.taken <= 3 * r.size for r in mine) and mine[0].target <= 3 * mine[0].source_size + 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed_documents(docs.repartition(5)).collect()))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_warc_ids_and_repeated_digests(spark):
    rows = [("null", "x" * 200), (None, "y" * 200), ("", "z" * 200), ("a b/é", "x" * 200), ("null", "x" * 200)]
    pages = spark.createDataFrame([(*r, "u", 7) for r in rows], "page_id string, html string, url string, payload int")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=str) == sorted([("a b/é", "response", None), ("null", "revisit", "a b/é"), ("null", "revisit", "a b/é"), ("", "response", None), (None, "response", None)], key=str)


def test_warc_round_trip(spark):
    long = "é" * 700_000
    rows = [(1, "http://a", "x" * 100), (2, None, "x" * 100), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5), (7, "u", long), (8, "u", long), (None, "u", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages, chunk=100_001).collect()}
    for i, _, text in rows:
        data = (text or "").encode()
        assert got[i].complete and got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {2: 1, 8: 7, None: 1}
    assert got[7].segments == 14 and warc.round_trip(pages.limit(0)).count() == 0


def test_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.standard_normal(8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0, None] * 4), (903, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_topk(frame, F.col("vec_id") % 50 == 0, k=10, block=64, group=3).collect()
    fine = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows[:340]}
    for q in range(0, 340, 50):
        want = sorted(((-int(fine[q] @ v), i) for i, v in fine.items() if i != q))[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_topk_of_repeated_ids_and_large_components(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(100, v)] * 14 + [(101, v), (8, [0.5] * 3), (8, [0.5] * 3), (100, [9.0, 9.0, 9.0]), (7, [1e9, 1e9, -1e9]), (5, [1e18] * 3)] + [(100, [float(k), 0.0, 1.0]) for k in range(12)]
    frame = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<double>, score string, rank int")
    fine = [(i, [max(-(2**63), min(2**63 - 1, int(np.floor(max(-9.2e18, min(9.2e18, 1024 * c)))))) for c in x]) for i, x in rows]
    for block in (4096, 4):
        got = topk.exact_topk(frame, F.col("vec_id") == 100, k=10, block=block, group=2).collect()
        wanted = []
        for i, x in fine:
            if i == 100:
                exact = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in fine if j != 100)[:10]
                wanted.append(tuple((max(-(2**63), min(2**63 - 1, -s)), j) for s, j in exact))
        assert len(got) == sum(map(len, wanted))
        for want in set(wanted):
            assert all(sum((r.score, r.vec_id, r["rank"]) == (s, j, n + 1) for r in got) >= wanted.count(want) for n, (s, j) in enumerate(want))
    with pytest.raises(TypeError):
        topk.exact_topk(frame.withColumn("vec_id", F.lit("x")), F.lit(True))


def test_topk_of_many_blocks_broadcasts_nothing(spark):
    """Queries are few before they meet the blocks: a join of them was planned as a broadcast of all their copies."""
    rng = np.random.default_rng(6)
    v = rng.integers(-40, 40, (3000, 6)) / 1024
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = topk.exact_topk(frame, F.col("vec_id") % 100 == 0, k=4, block=20, group=2)
    got = found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    score = np.rint(v * 1024).astype(int) @ np.rint(v * 1024).astype(int).T
    for q in range(0, 3000, 100):
        want = sorted((-int(score[q, i]), i) for i in range(3000) if i != q)[:4]
        assert sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q) == [(n + 1, *x) for n, x in enumerate(want)]


def test_near_duplicates_match_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in forest.near_duplicates(docs, width=4).collect()}
    assert got[1] == (117, 1, True) and got[2] == (117, 1, False) and got[3][1] == 1
    assert got[4] == (0, 4, True) and got[5] == (0, 5, True) and got[6] == (0, 6, True)
    assert got[7] == (1, 7, True) and got[8] == (1, 7, False)
    assert got[None][1:] == (None, True) and forest.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        forest.near_duplicates(docs.withColumn("doc_id", F.lit("a")))


def test_frames_lose_no_link(spark):
    """Texts share a frame at 0.77; each planted pair stands at 0.85 among them."""
    frame = [f"f{k}" for k in range(200)]
    texts = [" ".join(frame + [f"o{i}x{k}" for k in range(30)]) for i in range(300)]
    texts += [" ".join(frame + [f"p{i}x{k}" for k in range(10)] + [f"p{i}{side}{k}" for k in range(18)]) for i in range(150) for side in "lr"]
    rows = [(i, texts[k]) for i, k in enumerate(np.random.default_rng(4).permutation(len(texts)).tolist())]
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=1).collect()}
    sets = [set(t.split()) for _, t in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        linked = 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
        assert linked == (got[a] == got[b])


def test_rare_shingles_come_first_where_buckets_are_full(spark, monkeypatch):
    """Texts of a common frame at 0.63; all their shingles fall into 64 buckets, so that counts of all shingles can't tell which are rare."""
    candidates = [f"v{k}" for k in range(5_000_000)]
    hashes = shingles(words([" ".join(candidates).encode()])[0], 1)
    chosen = [candidates[i] for i in np.flatnonzero(forest._bucket(hashes) < 64)]
    frame, n = chosen[:200], 75
    assert len(chosen) > 200 + 60 * n
    rows = [(i, " ".join(frame + chosen[200 + 60 * i : 260 + 60 * i])) for i in range(n)]
    rows += [(n + i, " ".join(frame + chosen[200 + 60 * i : 250 + 60 * i])) for i in range(5)]  # 250 of 260 words of another
    kept, table = {}, forest._table

    def seen(df, name):
        out = table(df, name)
        kept[name] = out[0].count()
        return out

    monkeypatch.setattr(forest, "_table", seen)
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=1).collect()}
    assert got == {i: i if i < n else i - n for i, _ in rows}
    assert kept["crowded"] > n / 2 and kept["left-over"] <= 2 * n


def test_near_copies_in_a_large_group(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        w = list(LOREM[:200])
        for at in rng.integers(0, 200, rng.integers(0, 4)):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(197)} for _, t in rows]
    parent = list(range(400))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(400), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), width=4).collect()}
    assert got == {i: top(i) for i in range(400)}


def test_near_copies_among_many_texts_below_the_bound(spark):
    """Pairs at 0.806 stand among texts that share a passage with them at 0.745."""
    body = [f"b{k}" for k in range(300)]
    texts = [" ".join(body + [f"u{i}x{k}" for k in range(51)]) for i in range(600)]  # shingles of one word: 300 shared, 51 of its own
    texts += [" ".join(body + [f"p{i}x{k}" for k in range(16)] + [f"p{i}{side}{k}" for k in range(38)]) for i in range(30) for side in "lr"]
    n = len(texts)
    rows = [(i, texts[k]) for i, k in enumerate(np.random.default_rng(9).permutation(n))]
    sets = [set(t.split()) for _, t in rows]
    want = {i: i for i in range(n)}
    for a, b in itertools.combinations(range(n), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            want[b] = want[a]
    assert sum(want[i] != i for i in want) == 30
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), width=1).collect()}
    assert got == want


def expected_text(page):
    """What stands between the marks of a labelled page, by its blocks."""
    inside, blocks = False, {}
    for kind, what, _, block in main_text.Page(page).items:
        if kind == "mark":
            inside = what == "main"
        elif inside and (kind == "text" or what == "br"):
            blocks.setdefault(block, []).append(what if kind == "text" else " ")
    joined = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in joined if x)


def test_main_text_of_unseen_layouts():
    right = missed = wrong = 0
    for page in main_text.labelled_pages(120, seed=99):
        want, got = expected_text(page).split(), main_text.main_text(page).split()
        right, missed, wrong = right + min(len(want), len(got)), missed + max(0, len(want) - len(got)), wrong + max(0, len(got) - len(want))
    assert missed < 0.03 * right and wrong < 0.05 * right


MAIN = "<h1>The title</h1>" + "<p>" + "words of the article " * 12 + "</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><nav>Menu one two</nav><article><p>Caf&eacute; &amp; bar<br>now</p><div class=ad>Buy it</div><p>More 1 < 2 text</p></article></body>", "Café & bar now\nMore 1 < 2 text"),
        (f'<body class="no-sidebar"><nav><a href=#>Home</a></nav><article>{MAIN}</article><footer>All rights</footer></body>', "The title\n" + " ".join(["words of the article"] * 12)),
        (f'<body><div class="page-header-wrap"><nav><a href=#>Home</a></nav><article>{MAIN}</article></div></body>', "The title\n" + " ".join(["words of the article"] * 12)),
        (f"<body><article>{MAIN}{'<div><a href=#></a></div>' * 20}<p>{'second half ' * 20}</p></article></body>", "The title\n" + " ".join(["words of the article"] * 12) + "\n" + " ".join(["second half"] * 20)),
        ("<body><article><p>before it all is well here</p><svg><p>after it there is more text</p></article></body>", "before it all is well here\nafter it there is more text"),
        (f'<body><div class="cookie-consent">We use cookies on this site</div><article>{MAIN}<div class="sponsored">Buy this thing now</div></article><div class="feedback">Was this page of any help</div></body>', "The title\n" + " ".join(["words of the article"] * 12)),
        (f'<body><main><article>{MAIN}<div id="comments"><ol><li class="comment"><p>{"a long comment of a reader " * 9}</p></li></ol></div></article></main></body>', "The title\n" + " ".join(["words of the article"] * 12)),
        (None, ""),
        ("", ""),
        ("<nav>a</nav>", ""),
    ],
)
def test_main_text(page, want):
    assert main_text.main_text(page) == want


def test_the_scan_decides(spark):
    scores = [-1.0, 2.0, 2.0, -9.0, 3.0, -0.5, 1.0, -8.0, 0.5, -4.0]
    assert main_text.best_region(scores, gap=2.0) == [(1, 3), (4, 7)]  # the last half is not worth a gap
    assert main_text.best_region(scores, gap=100.0) == [(1, 3)] or sum(scores[1:3]) < sum(scores[4:7])

    def brute(values, gap):
        best = 0.0
        for pick in itertools.product((0, 1), repeat=len(values)):
            runs = sum(p and not q for p, q in zip(pick, (0, *pick), strict=False))
            best = max(best, sum(v for v, p in zip(values, pick, strict=True) if p) - gap * max(0, runs - 1))
        return best

    rng = np.random.default_rng(2)
    for _ in range(60):
        values = (rng.integers(-8, 9, 9) / 2).tolist()
        found = main_text.best_region(values, gap=1.5)
        got = sum(sum(values[a:b]) for a, b in found) - 1.5 * max(0, len(found) - 1)
        assert got == pytest.approx(brute(values, 1.5))
    # a lone positive word behind strongly negative ones is left to the scan, not to its own weight
    page = f"<body><article>{MAIN}</article><div class='related'><a href=#>{'more of it ' * 30}</a></div><p>End</p></body>"
    model = main_text.weights()
    dear = main_text.GAP
    try:
        main_text.best_region.__defaults__ = (1000.0,)
        assert "End" not in main_text.main_text(page, model)
    finally:
        main_text.best_region.__defaults__ = (dear,)


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000, "<a " * 20_000, '<a "' * 20_000 + ">", "<a x='" * 20_000, "<svg>" * 20_000, "<b>" * 20_000 + "<div></div>" * 20_000, "<" * 60_000, "<!--" * 20_000])
def test_hostile_pages_take_linear_time(page):
    import time

    model, began = main_text.weights(), time.time()
    main_text.main_text(page, model)
    assert time.time() - began < 5


def test_extract_edges(spark):
    rows = [(1, "u", f"<article>{MAIN}</article>", "x"), (1, "u", f"<article>{MAIN}</article>", "x"), (None, None, None, "y"), (2, "v", "<article><p>" + "long text here " * 200_000 + "</p></article>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 261), (1, 261), (2, 200_000 * 15 - 1)]
    assert main_text.extract(pages.limit(0)).count() == 0


def test_toxicity_learns_words():
    rng = np.random.default_rng(0)
    make = lambda bad: " ".join([*(LOREM[k] for k in rng.integers(0, 300, 60)), *(["nasty", "Vile"] if bad else [])]).encode()
    label = np.arange(600) % 4 == 0
    net = toxicity.train([make(b) for b in label], label, passes=6)
    w = toxicity.Words([make(True), make(False), b"", None])
    index, of = w.windows()
    logit = net.logits(w, index)
    worst = np.maximum.reduceat(logit, np.searchsorted(of, np.arange(4)))
    assert worst[0] > worst[1:].max()


def test_toxicity_reads_all_of_an_unspaced_text():
    rng = np.random.default_rng(0)
    make = lambda bad: " ".join([*(LOREM[k] for k in rng.integers(0, 300, 60)), *(["nasty", "Vile"] if bad else [])]).encode()
    label = np.arange(600) % 4 == 0
    net = toxicity.train([make(b) for b in label], label, passes=6)
    head, clean, bad = LOREM[:30], LOREM[30:36], LOREM[30:34] + ["nasty", "Vile"]
    for mark in ("_", "/", ""):
        texts = [mark.join(head + tail).encode() for tail in (clean, bad)]
        assert texts[0][:64] == texts[1][:64] and b" " not in texts[1]
        w = toxicity.Words(texts)
        index, of = w.windows()
        worst = np.maximum.reduceat(net.logits(w, index), np.searchsorted(of, np.arange(2)))
        assert worst[1] > worst[0], mark


def test_toxicity_edge_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_documents(docs, none).collect()
    assert len(rows) == docs.count() and {(r.score, r.predicted) for r in rows} == {(0.0, 0)}


def test_language_model(spark, docs):
    from collections import Counter
    from math import log10
    from zlib import crc32

    rows = language_model.score_texts(docs).collect()
    assert len(rows) == docs.count()
    out = lambda i: i is not None and crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [0]
    seen = Counter(x for r in docs.collect() if not out(r.doc_id) for x in tokens(r.text))
    n = sum(seen.values())
    want = sorted((str(r.doc_id), len(tokens(r.text)), sum(seen[x] > 0 for x in tokens(r.text)), round(sum(log10((seen[x] + 1) / (n + len(seen) + 1)) for x in tokens(r.text)), 6)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == n and r.score <= 0 for r in rows)
    assert language_model.score_texts(docs.limit(0)).count() == 0


def test_rare_previous_words_have_their_own_restaurants(spark):
    """Two words of one ending, each 6 of 40,000 tokens, are followed by different words; a shared restaurant could not tell which."""
    from zlib import crc32

    ids = [i for i in range(3000) if crc32(str(i).encode()) % 7 != 2]
    out = [i for i in range(3000) if crc32(str(i).encode()) % 7 == 2]
    rows = [(i, " ".join(f"f{(i * 37 + k * k) % 500}" for k in range(100))) for i in ids[:400]]
    rows += [(ids[400 + k], "first1ab yes" if k % 2 else "second1ab no") for k in range(12)]
    asked = ["first1ab yes", "first1ab no", "second1ab no", "second1ab yes"]
    rows += list(zip(out, asked, strict=False))
    got = {r.doc_id: r for r in language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    right, wrong = ([got[out[k]].score for k in ks] for ks in ((0, 2), (1, 3)))
    assert min(right) > max(wrong) + 1
    assert len(got) == len(rows) and all(got[out[k]].held_out for k in range(4))


@pytest.mark.parametrize("head", [1 << 21, 3])
def test_scores_by_words_are_the_models_probabilities(spark, monkeypatch, head):
    """After every previous word the known words and the unknown one add up to 1, and a text's score is the sum over its tokens."""
    from math import log10

    monkeypatch.setattr(language_model, "HEAD_PAIRS", head)
    texts = ["a b a c a b d", "a b b c", "c a d a b", "e f g h a b", "Unheard of a b", "b unheard", ""] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    held = language_model.held_out(F.col("id"), 7, 2)
    model = language_model.Restaurants(rows.where(~held), 3, 1)
    pairs = {r.key: r.score for r in model.pairs.collect()}
    contexts, known = {r.z: r.back for r in model.contexts.collect()}, {r.w: r.p for r in model.words.collect()}
    training = [r.text for r in rows.where(~held).collect()]
    word, before, _, _ = language_model.bigrams([t.encode() for t in training])
    assert set(contexts) == set(before.view(np.int64).tolist()) and set(known) == set(word.view(np.int64).tolist())

    def chance(z, w):
        key = int(language_model.pair_key(np.array([z]).view(np.uint64), np.array([w]).view(np.uint64)).view(np.int64)[0])
        return 10 ** pairs[key] if key in pairs else float(np.mean(np.array(contexts.get(z, [1.0] * 2)) * np.array(known.get(w, model.unseen))))

    for z in [*contexts, 5]:
        assert sum(chance(z, w) for w in known) + chance(z, 7) == pytest.approx(1, abs=1e-9)
    for r in language_model.score_texts(docs).collect():
        word, before, _, _ = (x.view(np.int64).tolist() for x in language_model.bigrams([texts[r.doc_id].encode()]))
        assert r.score == pytest.approx(sum(log10(chance(z, w)) for z, w in zip(before, word, strict=True)), abs=1e-9)


def test_pairs_of_words_take_few_bytes(spark, monkeypatch):
    """All that is written for 50,000 pairs, seatings and words included; a row for each pair took more than the disk of op7's check."""
    import os

    sizes, table = [], language_model.Restaurants._table

    def measured(*args):
        made = table(*args)
        sizes.append(sum(os.path.getsize(os.path.join(where, f)) for where, _, files in os.walk(made[1]) for f in files if f.endswith(".parquet")))
        return made

    monkeypatch.setattr(language_model.Restaurants, "_table", staticmethod(measured))
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in (5000 * rng.random(400) ** 3).astype(int)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    pairs = {x for t in texts for x in itertools.pairwise(["", *t.split(), "end"])}
    assert len(pairs) > 50_000
    language_model.Restaurants(docs, 3, 1)
    assert sum(sizes) < 20 * len(pairs)


def test_scores_do_not_depend_on_chunks_parts_and_known_words(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in (200 * rng.random(int(n)) ** 2).astype(int)) for n in rng.integers(0, 60, 60)]
    docs = spark.createDataFrame([*enumerate([*texts, None, " "]), (7, texts[7]), (None, texts[8])], "doc_id long, text string").repartition(3)
    scored = lambda: sorted(((-1 if r.doc_id is None else r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in language_model.score_texts(docs).collect())
    want = scored()
    assert len(want) == 64 and any(r[1] for r in want)
    for chunk, texts_, part, head in ((50, 1 << 15, 4, 1 << 21), (1 << 21, 4, 21, 100)):
        for name, value in (("CHUNK", chunk), ("TEXTS", texts_), ("PART", part), ("HEAD_PAIRS", head)):
            monkeypatch.setattr(language_model, name, value)
        assert scored() == want


def test_without_training_rows_every_text_has_the_uniform_base(spark):
    from zlib import crc32

    out = [i for i in range(100) if crc32(str(i).encode()) % 7 == 2]
    rows = language_model.score_texts(spark.createDataFrame([(i, "a b a") for i in out], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(True, 4, 0, 0, 0.0, 0.0)] * len(out)


def test_packed_pairs_come_back():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5000):
        pairs = np.unique(rng.integers(0, 50, n).astype(np.uint64) << np.uint64(32) | rng.integers(0, 1 << 31, n).astype(np.uint64))
        z, w, other = language_model.unpack(language_model.pack(*language_model._steps(pairs), np.arange(n) * 0.5))
        assert (language_model._from_steps(z, w) == pairs).all() and (other == np.arange(n) * 0.5).all()


def weights_of_tables(n: int, discount: float, new: float) -> np.ndarray:
    """[t]: total weight of all seatings of n customers at t tables, by listing them."""
    out, stack = np.zeros(n + 1), [((1,), new)]
    while stack:
        sizes, weight = stack.pop()
        if sum(sizes) == n:
            out[len(sizes)] += weight
            continue
        stack.append(((*sizes, 1), weight * new))
        stack += [((*sizes[:k], size + 1, *sizes[k + 1 :]), weight * (size - discount)) for k, size in enumerate(sizes)]
    return out


def test_a_customer_that_leaves_takes_the_table_away_as_often_as_in_all_seatings():
    for n in (2, 3, 4, 5, 6):
        now, before = (weights_of_tables(m, 0.4, 1.0) for m in (n, n - 1))
        for t in range(1, n + 1):
            assert language_model.closing(0.4)[n, t] == pytest.approx(before[t - 1] / now[t])


def test_sweeps_keep_to_the_posterior_of_the_tables():
    copies = 20_000
    word, salt = np.arange(copies, dtype=np.uint64), np.zeros(copies, np.int64)
    for n, d, a in ((2, 0.5, 0.8), (4, 0.5, 0.8), (6, 0.3, 2.0)):
        customers, new = np.full(copies, n), np.full(copies, a)
        tables = np.ones(copies)
        for sweep in range(1, 9):
            tables = language_model.reseat(word, salt, sweep, customers, tables, new, d)
        chance = weights_of_tables(n, d, a)
        assert np.abs(np.bincount(tables.astype(int), minlength=n + 1) / copies - chance / chance.sum()).max() < 0.015


def test_language_model_scores_are_its_probabilities(spark):
    """In every context the known words and the unknown one add up to 1, and a text's score is the sum over its tokens."""
    from math import log10
    from zlib import crc32

    out = lambda i: crc32(str(i).encode()) % 7 == 2
    texts = ["a b a c a b d", "a b b c", "c a d a b", "e f g h a b", "Unheard of a b", "b unheard", ""] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    training = docs.where(~language_model.held_out(F.col("doc_id"), 7, 2))
    own = language_model.own_contexts(training, 0.05)
    contexts = language_model.FIXED + int((own >= 0).sum())
    assert contexts > language_model.FIXED + 1
    pairs = language_model.count_pairs(training, own)
    sampler, model = language_model.sampled(pairs, contexts)
    model = model.collect()
    back = np.stack([sampler.back(s) for s in (2, 3)])
    unseen = np.array([sampler.base(s) for s in (2, 3)])

    def chance(word, z):
        row = next((r for r in model if r.word == word), None)
        if row is None:
            return float((unseen * back[:, z]).mean())
        mine = dict(zip(row.contexts, row.own, strict=True)).get(z, 0.0)
        return mine + float((np.array(row.parents) * back[:, z]).mean())

    used = {z for r in model for z in r.contexts}
    for z in used:
        assert sum(chance(r.word, z) for r in model) + chance(None, z) == pytest.approx(1, abs=1e-5)
    for r in language_model.score_texts(docs, least_share=0.05).collect():
        word, context, _ = language_model.text_tokens([texts[r.doc_id].encode()], own)
        want = sum(log10(chance(int(w), z)) for w, z in zip(word.view(np.int64), context, strict=True))
        assert r.score == pytest.approx(want, abs=1e-4) and r.held_out == out(r.doc_id)


def test_token_counts_are_the_librarys():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    counter = token_counts.TokenCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.splits and len(counter.proven) > 10_000
    for text in ("", " ", "  ", " a", "a ", "a  b", "The end.\nNext\tline  ", "▁x a▁b", "ﬁ ① 12345 é　x", "\n\n", "<s> </s>", "x" * 500, "a\r\n b", "   \n   "):
        assert counter.count(text) == len(counter.model.encode(text)), repr(text)
    assert counter.count(None) == 0


def test_masks_catch_two_substitutions():
    for gone in itertools.combinations(range(decontaminate.WINDOW), 2):
        ok = [k not in gone for k in range(decontaminate.WINDOW)]
        assert any(all(ok[i + k] or m[k] == "0" for k in range(len(m))) for m in decontaminate.MASKS for i in range(decontaminate.WINDOW - len(m) + 1))


def test_short_items_have_a_mask_for_every_permitted_substitution():
    for n in range(1, decontaminate.WINDOW):
        most = max(s for s in range(n) if s == 0 or n - s >= 0.8 * n)
        for gone in itertools.combinations(range(n), most):
            masks = (*decontaminate.MASKS, *decontaminate.item_masks(n, 0.8))
            assert any(decontaminate.survives(m, gone, n) for m in masks), (n, gone)


def overlaps(doc: str | None, item: str | None) -> bool:
    """Brute force: every alignment, every window."""
    x, y = (re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in (doc, item))
    width = min(13, len(y))
    if not width:
        return False
    for shift in range(-len(y), len(x) + 1):
        same = [0 <= i + shift < len(x) and x[i + shift] == y[i] for i in range(len(y))]
        inside = [0 <= i + shift < len(x) for i in range(len(y))]
        if any(all(inside[k : k + width]) and sum(same[k : k + width]) >= 0.8 * width for k in range(len(y) - width + 1)):
            return True
    return False


def test_decontamination_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    items = [" ".join(LOREM[a : a + n]) for a, n in ((0, 40), (50, 13), (70, 9), (90, 5), (100, 3), (110, 1), (120, 25))] + [None, "", "same " * 300, " ".join(LOREM[0:40])]
    texts = [None, "", "  ", "same " * 4000, " ".join(["x", "y"] * 500), " ".join(LOREM[5:20]).upper()]
    for item in items[:7]:
        for changed in (0, 1, 2, 3, 5):
            w = item.split()
            for at in rng.permutation(len(w))[:changed]:
                w[at] = "zz"
            texts.append(" ".join(["before", *(LOREM[k] for k in rng.integers(200, 300, 8)), *w, "after"]))
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t in enumerate(texts)] + [(0, texts[-1], "b", 2)], "doc_id long, text string, key string, hashes int").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted((r.doc_id, k) for r in docs.collect() for k, item in enumerate(items) if overlaps(r.text, item))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == want and len(want) > 20
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.text) for r in clean.collect()) == sorted(str(r.text) for r in docs.collect() if not any(overlaps(r.text, i) for i in items))
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_repeated_words_are_few_seeds():
    hashes = words([b"same " * 20_000])[0]
    seeds = decontaminate.Seeds(hashes, np.array([0, len(hashes)]), decontaminate.MASKS)
    assert len(seeds.at) < 100


def test_url_rules(spark):
    rows = [(1, "http://WWW.x.net/a?b#c"), (2, "https://example.net/en/1"), (3, "http://a.example.com/de/x"), (4, "http://my.org/fr/"), (5, "http://notnet/x"), (6, None), (7, "no scheme"), (8, "http://www.mega-poker.example.com/en/4"), (9, "http://library.example.com/en/4"), (10, "http://net"), (9, "http://library.example.com/en/4")]
    pages = spark.createDataFrame([(*r, "http://casino.com/") for r in rows], "page_id long, url string, id string")
    out = url_rules.judge_urls(pages).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(rows)
    assert got[1] == ("www.x.net", "/a", "net/", "block") and got[2][2:] == ("example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][2:] == got[9][2:] == (None, "allow") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == (None, "block") and got[10] == ("net", "", None, "allow")
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_of_equal_list_rules_the_first_wins():
    assert url_rules.list_rule("a.b", "/c", (("allow", "a.b", "/c"), ("block", "a.b", "/c"))) == ("a.b/c", "allow")


def test_mined_rules_hold_for_unseen_urls(spark):
    labelled = url_rules.labelled_urls(spark, 9000)
    seen = labelled.where(F.crc32("url") % 3 > 0)
    index = url_rules.RuleIndex(url_rules.mine_rules(seen))
    right = wrong = missed = 0
    for r in labelled.join(seen.select("url").distinct(), "url", "left_anti").collect():
        blocked = index.blocks(url_rules.url_tokens(*url_rules.split_url(r.url)))
        right, wrong, missed = right + (blocked == (r.label == "block")), wrong + (blocked and r.label == "allow"), missed + (not blocked and r.label == "block")
    assert wrong <= 0.01 * right and missed <= 0.05 * right
    # an ordinary word that also stands in blocked hosts is no rule of its own
    assert not index.blocks(["free"]) and not index.blocks(["adult", "education"]) and index.blocks(["free", "roulette"])


def test_mined_rules_are_those_of_a_plain_count(spark):
    rows = [("http://a-b.example.com/", "block")] * 5 + [("http://a-c.example.com/", "allow")] * 5 + [("http://b-c.example.com/", "block"), ("http://b-c.example.com/", "allow"), (None, "block"), ("http://x.example.com/", None)]
    got = url_rules.mine_rules(spark.createDataFrame(rows, "url string, label string"), support=0.1, confidence=0.8)
    baskets = [(frozenset(url_rules.url_tokens(*url_rules.split_url(u))), y) for u, y in rows if u and y]
    want = []
    for n in (1, 2, 3):
        for s in itertools.combinations("abcx", n):
            hit = [y for b, y in baskets if set(s) <= b]
            if hit.count("block") >= 0.1 * len(baskets) and hit.count("block") >= 0.8 * len(hit) and not any(set(w) < set(s) for w in want):
                want.append(s)
    assert got == want == [("b",)]
