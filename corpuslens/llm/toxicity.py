"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 6), in numpy.

Inputs: every word is a learned word vector (words of the training texts; others zero) next to the mean of
its character-trigram vectors (hashed into buckets). Both directions of a gated recurrent unit run over a
window of words (a run of more than ``OVERLONG`` bytes without white space enters as several, see ``apart``);
attention pools their states and a logistic unit scores the window. A text is scored over
all its windows, each overlapping the next by eight words, and has the score of its worst window.

Training runs in one task over a bounded sample of labelled rows: the ``sample`` first labelled texts by a
seeded hash, of at most ``longest`` bytes each. Windows of clean texts are clean; of a toxic text the window
that scores highest counts as toxic (after a first pass that takes them all), so the label of a long text
teaches its toxic part. The trained weights are a few MB whatever the corpus.

Scoring is one pass over the texts, without a shuffle; distinct words of a batch are embedded once.

Defined results: a null, empty or white-space text is one window without words and has the score of its
bias; with no labelled row, or with one class only, the score is the sample's share of toxic rows (0
without any); repeated rows score alike; ids may be null (such a row is not held out); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.hashing import bound_batches, lean, small_batches, words

WINDOW, STRIDE, STATE, WORD_DIMS, CHAR_DIMS, BUCKETS = 32, 24, 8, 8, 8, 1 << 14
CHUNK = 1024
#: Bytes from which a run without white space is taken apart; size and step of the pieces of what stays too long.
OVERLONG, SIZE, STEP = 64, 16, 8
_LONG = re.compile(rb"[^\x20\x09-\x0D]{%d,}" % (OVERLONG + 1))
_MARKS = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Word vectors: the words of most training texts.
VOCABULARY = 8192


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` modulo ``folds``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def apart(text: bytes) -> bytes:
    """The text with each overlong run as words: its parts between ASCII marks, and overlapping pieces of a part still too long."""

    def pieces(run: re.Match) -> bytes:
        parts = [x for x in _MARKS.split(run[0]) if x] or [run[0]]
        cut = [[x] if len(x) <= OVERLONG else [x[k : k + SIZE] for k in range(0, len(x) - SIZE + STEP, STEP)] for x in parts]
        return b" ".join(x for part in cut for x in part)

    return _LONG.sub(pieces, text)


class Words:
    """The distinct words of some texts: hashes (sorted), character-trigram buckets, and the index of every token."""

    def __init__(self, texts: list[bytes | None]) -> None:
        hashes, starts, ends, self.firsts, raw = words(texts)
        if len(starts) and (ends - starts).max() > OVERLONG:
            hashes, starts, ends, self.firsts, raw = words([apart(t) if t else t for t in texts])
        self.hashes, where, self.tokens = np.unique(hashes, return_index=True, return_inverse=True)
        data = np.frombuffer(raw, np.uint8)
        lengths = (ends - starts)[where]
        self.begins = np.cumsum(lengths) - lengths
        self.owner = np.repeat(np.arange(len(where)), lengths)
        data = np.frombuffer(raw.lower() + b"  ", np.uint8)
        at = np.repeat(starts[where] - self.begins, lengths) + np.arange(len(self.owner))
        # a word's neighbours in the text are white space, so its first and last trigrams mark its ends
        code = data[at - 1].astype(np.uint32) | data[at].astype(np.uint32) << np.uint32(8) | data[at + 1].astype(np.uint32) << np.uint32(16)
        code[self.begins] |= np.uint32(255)
        last = self.begins + lengths - 1
        code[last] |= np.uint32(255 << 16)
        self.buckets = (code * np.uint32(2654435761) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
        self.counts = lengths.astype(np.float32)

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WINDOW token indexes with -1 for none, text of each window)."""
        rows, of = [], []
        for k, (lo, hi) in enumerate(zip(self.firsts[:-1], self.firsts[1:], strict=True)):
            starts = np.arange(lo, max(lo + 1, hi - WINDOW + stride), stride)
            rows.append(starts)
            of.append(np.full(len(starts), k))
        starts, of = np.concatenate(rows), np.concatenate(of)
        at = starts[:, None] + np.arange(WINDOW)
        inside = at < self.firsts[1:][of][:, None]
        if not len(self.tokens):
            return np.full(at.shape, -1), of
        return np.where(inside, self.tokens[np.minimum(at, len(self.tokens) - 1)], -1), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gate(x: np.ndarray) -> np.ndarray:
    """The hard sigmoid, in place."""
    x *= np.float32(0.2)
    x += np.float32(0.5)
    return np.clip(x, 0, 1, out=x)


class Network:
    """Weights by name; ``forward`` keeps what ``backward`` needs."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d = WORD_DIMS + CHAR_DIMS
        w = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary = vocabulary  # sorted hashes
        self.p = {"word": 0.3 * rng.standard_normal((len(vocabulary) + 1, WORD_DIMS)).astype(np.float32), "char": 0.5 * rng.standard_normal((BUCKETS, CHAR_DIMS)).astype(np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": w(d, 3 * STATE), f"U{k}": w(STATE, 3 * STATE), f"c{k}": np.zeros(3 * STATE, np.float32)}
        self.p |= {"A": w(2 * STATE, STATE // 2), "a": w(STATE // 2), "v": w(2 * STATE), "o": np.full(1, -2, np.float32)}
        self.p["word"][-1] = 0
        self.constant: float | None = None
        self.scale, self.shift = 1.0, 0.0

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))

    def inputs(self, w: Words) -> np.ndarray:
        """One row for each distinct word."""
        if not len(w.hashes):
            return np.zeros((0, WORD_DIMS + CHAR_DIMS), np.float32)
        chars = np.add.reduceat(self.p["char"][w.buckets], w.begins, axis=0)
        return np.concatenate([self.p["word"][self.rows_of(w.hashes)], chars * (2 / w.counts[:, None])], axis=1)

    def gates(self, x: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """What each distinct word adds to the gates and to the candidate, for both directions; a last row of zeros for padding."""
        full = {k: np.concatenate([x @ self.p[f"W{k}"] + self.p[f"c{k}"], np.zeros((1, 3 * STATE), np.float32)]) for k in "fb"}
        return {k: (np.ascontiguousarray(g[:, : 2 * STATE]), np.ascontiguousarray(g[:, 2 * STATE :])) for k, g in full.items()}

    def forward(self, gates: dict, index: np.ndarray, keep: bool = False):
        """Logits of windows; ``index`` points into the rows of ``gates``, -1 is padding."""
        n, steps = index.shape
        mask = index >= 0
        at = np.ascontiguousarray(np.where(mask, index, len(gates["f"][0]) - 1).T)
        short = None if mask.all() else np.ascontiguousarray(mask.T[:, :, None]).astype(np.float32)
        states, saved = [], []
        for k in "fb":
            first, second = gates[k]
            U, h, out, save = self.p[f"U{k}"], np.zeros((n, STATE), np.float32), np.empty((steps, n, STATE), np.float32), [None] * steps
            Uz, Ur, Uc = (np.ascontiguousarray(U[:, q * STATE : (q + 1) * STATE]) for q in range(3))
            for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
                g = first.take(at[t], axis=0)
                z, r = _gate(g[:, :STATE] + h @ Uz), _gate(g[:, STATE:] + h @ Ur)
                if short is not None:
                    z *= short[t]
                c = second.take(at[t], axis=0)
                c += (r * h) @ Uc
                np.tanh(c, out=c)
                if keep:
                    save[t] = (h, z, r, c)
                h = h + z * (c - h)
                out[t] = h
            states.append(out)
            saved.append(save)
        both = np.concatenate(states, axis=2)  # steps x n x 2 STATE
        u = np.tanh(both @ self.p["A"])
        e = np.where(mask.T, u @ self.p["a"], np.float32(-30))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * both).sum(axis=0)
        logit = pooled @ self.p["v"] + self.p["o"]
        return (logit, (mask, saved, both, u, alpha, pooled)) if keep else logit

    def backward(self, x: np.ndarray, index: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients by name, and of ``x``."""
        mask, saved, both, u, alpha, pooled = kept
        g: dict[str, np.ndarray] = {"v": pooled.T @ dlogit, "o": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * self.p["v"]
        dboth = alpha[:, :, None] * dpool
        dalpha = (both * dpool).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0)) * mask.T
        g["a"] = np.einsum("tn,tns->s", de, u)
        du = de[:, :, None] * self.p["a"] * (1 - u * u)
        g["A"] = both.reshape(-1, 2 * STATE).T @ du.reshape(-1, STATE // 2)
        dboth = dboth + du @ self.p["A"].T
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        steps = index.shape[1]
        for j, k in enumerate("fb"):
            U = self.p[f"U{k}"]
            dgates, dU, dh = np.zeros((steps, len(index), 3 * STATE), np.float32), np.zeros_like(U), np.zeros((len(index), STATE), np.float32)
            for t in range(steps - 1, -1, -1) if k == "f" else range(steps):
                h, z, r, c = saved[j][t]
                dh = dh + dboth[t, :, j * STATE : (j + 1) * STATE]
                dz, dc = dh * (c - h), dh * z * (1 - c * c)
                drh = dc @ U[:, 2 * STATE :].T
                dzr = np.concatenate([dz * (0.2 * ((z > 0) & (z < 1))), drh * h * (0.2 * ((r > 0) & (r < 1)))], axis=1).astype(np.float32)
                dU[:, 2 * STATE :] += (r * h).T @ dc
                dU[:, : 2 * STATE] += h.T @ dzr
                dgates[t] = np.concatenate([dzr, dc], axis=1)
                dh = dh * (1 - z) + drh * r + dzr @ U[:, : 2 * STATE].T
            flat, where = dgates.reshape(-1, 3 * STATE), index.T.reshape(-1)
            used = where >= 0
            per = np.stack([np.bincount(where[used], weights=flat[used, q], minlength=len(x)) for q in range(3 * STATE)], axis=1).astype(np.float32)
            g[f"U{k}"], g[f"W{k}"], g[f"c{k}"] = dU, x.T @ per, per.sum(axis=0)
            dx[: len(x)] += per @ self.p[f"W{k}"].T
        return g, dx[: len(x)]

    def logits(self, w: Words, index: np.ndarray) -> np.ndarray:
        gates = self.gates(self.inputs(w))
        return np.concatenate([self.forward(gates, index[k : k + CHUNK]) for k in range(0, len(index), CHUNK)])


def train(texts: list[bytes], toxic: np.ndarray, *, passes: int | None = None, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Network:
    """A network for the labelled texts; deterministic. Small samples are gone through more often: ``passes``, or 4 to 8 by their size."""
    passes = passes or min(8, max(4, 6000 // max(1, len(texts))))
    w = Words(texts)
    words_in = np.unique(np.stack([np.repeat(np.arange(len(texts)), np.diff(w.firsts)), w.tokens], axis=1), axis=0) if len(w.tokens) else np.zeros((0, 2), int)
    often = np.bincount(words_in[:, 1], minlength=len(w.hashes))
    net = Network(np.sort(w.hashes[np.argsort(-often, kind="stable")[:VOCABULARY]]), seed)
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        net.constant = share
        return net
    index, of = w.windows(WINDOW)  # windows side by side are enough to learn from
    rng, label = np.random.default_rng(seed), toxic[of].astype(np.float32)
    m, s, step = {}, {}, 0
    rows = net.rows_of(w.hashes)
    for turn in range(passes):
        clean = np.flatnonzero(label == 0)
        use = label == 1
        if turn:
            # of each toxic text the window that scores highest; of the clean ones the worst windows
            score = net.logits(w, index)
            order = np.lexsort((-score, of))
            top = order[np.searchsorted(of[order], np.unique(of))]
            use = np.zeros(len(of), bool)
            use[top] = label[top] == 1
            use |= (label == 1) & (score > 0)
            use[clean[np.argsort(-score[clean], kind="stable")[: int(use.sum())]]] = True
        use[rng.permutation(clean)[: 2 * int((use & (label == 1)).sum())]] = True
        chosen = rng.permutation(np.flatnonzero(use))
        for lo in range(0, len(chosen), batch):
            pick = chosen[lo : lo + batch]
            here, local = np.unique(index[pick], return_inverse=True)
            local = local.reshape(len(pick), -1) - (here[0] < 0)
            here = here[here >= 0]
            sub = _Part(w, here)
            x = net.inputs(sub)
            logit, kept = net.forward(net.gates(x), local, keep=True)
            grads, dx = net.backward(x, local, kept, (_sigmoid(logit) - label[pick]) / len(pick))
            grads["word"] = np.zeros_like(net.p["word"])
            grads["word"][rows[here]] = dx[:, :WORD_DIMS]
            grads["word"][-1] = 0
            each = dx[sub.owner, WORD_DIMS:] * (2 / sub.counts[sub.owner, None])
            grads["char"] = np.stack([np.bincount(sub.buckets, weights=each[:, q], minlength=BUCKETS) for q in range(CHAR_DIMS)], axis=1).astype(np.float32)
            step += 1
            for name, grad in grads.items():
                m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
                s[name] = 0.99 * s.get(name, 0) + 0.01 * grad * grad
                net.p[name] = (net.p[name] - rate * (0.75 ** (4 * turn / passes)) * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # the worst window's logit to the chance that the text is toxic: logistic regression on the whole sample
    logit = net.logits(w, index)
    worst = np.maximum.reduceat(logit, np.searchsorted(of, np.arange(len(texts)))).astype(float)
    net.scale, net.shift = _logistic(worst, toxic.astype(float))
    return net


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression by Newton's steps."""
    mean, spread = x.mean(), x.std() + 1e-9
    X, beta = np.stack([(x - mean) / spread, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(25):
        p = _sigmoid(X @ beta)
        beta += np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2), X.T @ (y - p) - 1e-3 * beta)
    return float(beta[0] / spread), float(beta[1] - beta[0] * mean / spread)


class _Part:
    """Some of the words of a ``Words``."""

    def __init__(self, w: Words, here: np.ndarray) -> None:
        self.hashes, self.counts = w.hashes[here], w.counts[here]
        lo, hi = np.searchsorted(w.owner, here, "left"), np.searchsorted(w.owner, here, "right")
        size = hi - lo
        self.owner, self.begins = np.repeat(np.arange(len(here)), size), np.cumsum(size) - size
        self.buckets = w.buckets[np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 3000, longest: int = 16000, folds: int = 4, fold: int = 2) -> Network:
    """Train on a bounded sample of labelled texts whose id is not in the held-out fold."""
    asked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).alias("y"))
    asked = asked.where(~held_out(F.col("i"), folds, fold))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").where(F.octet_length("t") <= longest)
    order = F.xxhash64(F.lit(11), F.col("i"))
    # the ids first, so that only the sample's texts travel; of the rows of a repeated id the least text is taken
    chosen = texts.select("i").join(asked, "i").select("i", "y").distinct().orderBy(order, "i").limit(sample)
    rows = texts.join(chosen, "i").groupBy("i", "y").agg(F.min("t").alias("t")).select(F.lit(0).alias("all"), "i", "t", "y")

    def trained(group: pa.Table) -> pa.Table:
        lean()
        taken = sorted(zip(*(group.column(c).to_pylist() for c in ("i", "t", "y")), strict=True))
        network = train([t.encode() for _, t, _ in taken], np.array([y for _, _, y in taken]) == 1)
        return pa.table({"network": pa.array([pickle.dumps(network)], pa.binary())})

    # one task, as the sample is bounded: a lost executor costs a retry, and the driver holds the weights alone
    found = rows.groupBy("all").applyInArrow(trained, "network binary").first()
    return train([], np.zeros(0, bool)) if found is None else pickle.loads(found.network)


def score(docs: DataFrame, network: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of ``docs``: the highest score of its windows (0 to 1). Texts go into Python, but do not come back."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(network)  # a few MB: bounded by the training sample

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        net = sent.value
        for batch in (part for whole in rows for part in small_batches(whole, limit=1 << 20)):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            if net.constant is not None:
                best = np.full(len(texts), net.constant)
            else:
                w = Words(texts)
                index, of = w.windows()
                worst = np.maximum.reduceat(net.logits(w, index), np.searchsorted(of, np.arange(len(texts)))).astype(float)
                best = _sigmoid(net.scale * worst + net.shift)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"id {kind}, score double").withColumnRenamed("id", id_col)


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 4, fold: int = 2, **training) -> DataFrame:
    """One row a document: id, held_out, score, predicted (1 where the score is at least ``threshold``)."""
    network = fit(docs, labels, id_col=id_col, text_col=text_col, folds=folds, fold=fold, **training)
    scored = score(docs, network, id_col=id_col, text_col=text_col)
    return scored.select(id_col, held_out(F.col(id_col), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
