"""A hierarchical Pitman-Yor language model over a whole corpus (operator 7).

The root restaurant is the corpus's unigram model over a uniform base of V + 1 types. Below it stands a restaurant for
every previous word and one for the text's begin, all with the root as parent (``Restaurants``). Customers are the training
tokens. Words are known by 64-bit hashes. The pairs of words lie in parts by their keys, as compressed arrays together with the
texts that hold them; a pair seen once, which has one table in every seating, is never seated again. What a sweep needs of
the words of most tokens goes to the tasks as bounded arrays, that of the other words is joined with the parts that hold them.

A caller may give a ``least_share``: then only previous words of that share of the training tokens have their own
restaurant, the others share classes by their last two bytes, hashed into ``CLASSES``; a previous word is known
by a bucket of its hash out of 2 ** ``BITS``, and the rest of this text says how that is sampled and scored.

Seating is sampled by Gibbs sweeps over the seating of the sweep before: of every dish (word) in every restaurant as many
customers as it has leave their table and sit down again, one after another, given the other dishes' tables and the
parent's probabilities of the sweep before. What is kept of a seating is each dish's number of tables; that a leaving
customer takes a table away has the probability S(n - 1, t - 1) / S(n, t) (generalised Stirling numbers), and for more
than ``EXACT`` customers its limit; of more than ``SINGLE`` customers an eighth moves at a time. A restaurant so falls apart by dish, so that sweeps run in parallel over
words and a hot restaurant or word is no task of its own; what sweeps exchange are the restaurants' totals,
one number a context. Random numbers are hashes of word, context, sweep and seat: a task that runs again draws
the same seating. Each sweep's seating is written to the shared folder, where the next one reads it.
Predictive
probabilities are averaged over the sweeps after the first ``burn``.

Discounts come from counts of counts, n1 / (n1 + 2 n2), of the restaurants of each level.

Scoring: the words of most training tokens with up to ``HEAD`` pairs of word and context (a bounded table) go to the tasks,
which score those words where the texts are read; the other words of each text are joined with the model by word, and
one partially aggregated sum brings each text together. Texts are never shuffled.

With a restaurant for every previous word every part scores its pairs, those of held-out texts too (a pair that training rows do not
have takes what its context and its word have), and sums them by text; the sums come back to the chunk of texts they belong to.

Defined results: a null, empty or white-space text is one token, the end; a null id is never held out;
repeated rows count and score each; without training rows the model is the uniform base (V = 0: the score
and base score are 0); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.hashing import bound_batches, lean, mix, small_batches, words
from corpuslens.llm.toxicity import held_out
from corpuslens.plans.lineage import drop_table, table_path, written

CLASSES, BITS = 32, 20
#: Contexts that every model has: the classes and the begin of a text.
FIXED = CLASSES + 1
#: Pairs of word and context in the table that goes to the tasks (12 bytes each), and words in it.
HEAD, HEAD_WORDS = 3 << 20, 1 << 16
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Numbers of known words (one as context and one as word) that go to the tasks (24 bytes a word in a sweep, 56 in scoring).
HEAD_PAIRS = 1 << 21
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Concentrations of the restaurants and of the root.
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
#: Pairs of word and context that a counting task holds before it hands them on.
HELD = 1 << 20
#: Customers of a dish up to which a leaving one's table is drawn exactly.
EXACT = 64
#: Customers of a dish up to which they move one by one.
SINGLE = 16
#: Low bits of a packed count that hold its context.
SHIFT = 24


def text_tokens(texts: list[bytes | None], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, text) of every token; each text ends in END. ``own``: the context of each bucket of previous words, or -1."""
    hashes, starts, ends, firsts, raw = words(texts)
    data = np.frombuffer(raw.lower() + b" ", np.uint8)
    n, k = len(hashes), len(texts)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0)  # of a word of one byte nothing stands before it
    two = data[ends - 1].astype(np.uint64) * np.uint64(256) + before.astype(np.uint64)
    kind = (mix(two) % np.uint64(CLASSES)).astype(np.int64)
    named = own[_bucket(hashes)]
    kind = np.where(named >= 0, named, kind)
    of = np.repeat(np.arange(k), np.diff(firsts))
    # word i of text t goes to place i + t, the end of text t to firsts[t + 1] + t
    word, context, owner = np.empty(n + k, np.uint64), np.full(n + k, CLASSES), np.empty(n + k, np.int64)
    place = np.arange(n) + of
    word[place], owner[place] = hashes, of
    last = firsts[1:] + np.arange(k)
    word[last], owner[last] = END, np.arange(k)
    context[place + 1] = kind  # the token after each word, the end included
    return word, context, owner


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def own_contexts(texts: DataFrame, least: float) -> np.ndarray:
    """The context of each bucket of previous words that holds a share of ``least`` or more of all, numbered in order, and -1 for the others."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total = np.zeros(1 << BITS, np.int64)
        for batch in (b for whole in rows for b in small_batches(whole)):
            total += np.bincount(_bucket(words(batch.column("text").cast(pa.binary()).to_pylist())[0]), minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = texts.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    own, n = np.full(1 << BITS, -1, np.int32), found.column("n").to_numpy()
    at = np.sort(found.column("at").to_numpy()[n >= max(1, least * n.sum())])
    own[at] = FIXED + np.arange(len(at))
    return own


def _collapse(word: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (word, context) summed."""
    order = np.lexsort((context, word))
    word, context, n = word[order], context[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])])) if len(word) else np.zeros(0, int)
    return word[first], context[first], np.add.reduceat(n, first) if len(first) else n


def count_pairs(texts: DataFrame, own: np.ndarray) -> DataFrame:
    """(word, contexts, counts): one row a word with its counts by context, from the rows' ``text``."""

    sent = texts.sparkSession.sparkContext.broadcast(own)  # 4 MB

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[tuple] = []

        def out(parts: list[tuple]) -> pa.RecordBatch:
            word, context, n = _collapse(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array((n << SHIFT | context).astype(np.int64))], names=["word", "packed"])

        for whole in rows:
            for batch in small_batches(whole):
                word, context, _ = text_tokens(batch.column("text").cast(pa.binary()).to_pylist(), sent.value)
                held.append(_collapse(word, context, np.ones(len(word), np.int64)))
                if sum(len(p[0]) for p in held) > HELD:
                    held = [_collapse(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD // 2:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    pairs = texts.select("text").mapInArrow(batches, "word long, packed long")
    pairs = pairs.groupBy("word", (F.col("packed").bitwiseAND((1 << SHIFT) - 1)).alias("context")).agg(F.sum(F.shiftright("packed", SHIFT)).alias("n"))
    # at most one entry a context
    pairs = pairs.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(F.col("context").cast("int").alias("context"), "n"))).alias("at"))
    return pairs.select("word", F.col("at.context").alias("contexts"), F.col("at.n").alias("counts"))


def _uniform(word: np.ndarray, *salt: int | np.ndarray) -> np.ndarray:
    h = word.astype(np.uint64)
    for s in salt:
        h = mix(h + np.asarray(s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


def seat(word: np.ndarray, salt: np.ndarray, sweep: int, customers: np.ndarray, new: np.ndarray, discount: float, seated: np.ndarray | None = None, tables: np.ndarray | None = None) -> np.ndarray:
    """Tables of each dish after its customers were seated one after another, from those ``seated`` at ``tables`` on; ``new``: the weight of opening a table."""
    seated = np.minimum(customers, 1) if seated is None else seated.copy()
    tables = seated.astype(float) if tables is None else tables.copy()
    active = np.flatnonzero(customers > seated)
    while len(active):
        i, t, a = seated[active], tables[active], new[active]
        leap = np.minimum(np.maximum(1, i // 8), customers[active] - i)
        opens = leap * (a / (i - discount * t + a))
        opened = np.floor(opens + _uniform(word[active], salt[active], sweep, i))
        tables[active] = t + np.minimum(opened, leap)
        seated[active] = i + leap
        active = active[seated[active] < customers[active]]
    return tables


@functools.lru_cache(maxsize=8)
def closing(discount: float) -> np.ndarray:
    """[n, t]: chance that one of n customers at t tables sat down at the table that it opened last, S(n - 1, t - 1) / S(n, t)."""
    n = EXACT + 1
    s = np.full((n, n + 1), -np.inf)
    s[1, 1] = 0
    for i in range(2, n):
        t = np.arange(1, i + 1)
        with np.errstate(divide="ignore"):
            s[i, 1 : i + 1] = np.logaddexp(s[i - 1, :i], np.log(np.maximum(i - 1 - discount * t, 0)) + s[i - 1, 1 : i + 1])
    out = np.zeros((n, n + 1))
    with np.errstate(invalid="ignore"):
        out[2:, 1:] = np.nan_to_num(np.exp(s[1:-1, :-1] - s[2:, 1:]))
    return out


def unseat(word: np.ndarray, salt: np.ndarray, sweep: int, customers: np.ndarray, tables: np.ndarray, leave: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(customers, tables) of each dish after ``leave`` of its customers left, the last seated first; one customer at one table stays at least."""
    left, tables = customers.copy(), tables.copy()
    least = customers - leave
    active = np.flatnonzero(left > least)
    exact = closing(discount)
    while len(active):
        i, t = left[active], tables[active]
        leap = np.where(i <= EXACT, 1, np.minimum(np.maximum(1, i // 8), i - least[active]))
        p = np.where(i <= EXACT, exact[np.minimum(i, EXACT), np.minimum(t, EXACT).astype(int)], discount * t / i)
        gone = np.minimum(np.floor(leap * p + _uniform(word[active], salt[active], -1 - sweep, i)), leap)
        left[active] = i - leap
        tables[active] = np.clip(t - gone, 1, left[active])
        active = active[left[active] > least[active]]
    return left, tables


def reseat(word: np.ndarray, salt: np.ndarray, sweep: int, customers: np.ndarray, tables: np.ndarray, new: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each dish after each of its customers in turn left its table and sat down again; ``new``: the weight of opening a table.

    A dish with n customers at t tables so keeps to chances in proportion to S(n, t) * new ** t.
    """
    tables, exact = tables.copy(), closing(discount)
    active, step = np.flatnonzero(customers > 1), 0
    while len(active):
        n, t, a = customers[active], tables[active], new[active]
        one = n <= SINGLE
        moved = np.where(one, 1, n // 8)
        leaves = np.where(n <= EXACT, exact[np.minimum(n, EXACT), np.minimum(t, EXACT).astype(int)], discount * t / n)
        gone = np.floor(moved * leaves + _uniform(word[active], salt[active], sweep, 2 * step))
        rest = np.clip(t - gone, 1, n - moved)
        opens = a / (n - moved - discount * rest + a)
        tables[active] = rest + np.minimum(np.floor(moved * opens + _uniform(word[active], salt[active], sweep, 2 * step + 1)), moved)
        step += 1
        active = active[np.where(one, n, 8) > step]
    return tables


class Totals:
    """What the sweeps exchange: customers of each context, and by sweep the tables of each context and those of the root."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, types: int, discount: float, root_discount: float) -> None:
        self.customers, self.types = customers, types
        self.discount, self.root_discount = discount, root_discount
        #: The root's customers are the sum of the tables below.
        self.tables, self.root_tables = [tables], [float(types)]

    def back(self, s: int) -> np.ndarray:
        """Weight of the parent in each context after sweep ``s``."""
        return (STRENGTH + self.discount * self.tables[s]) / (STRENGTH + self.customers)

    def base(self, s: int) -> float:
        """Probability of a type that the root has not seen."""
        return (ROOT_STRENGTH + self.root_discount * self.root_tables[s]) / (ROOT_STRENGTH + self.tables[s].sum()) / (self.types + 1)

    def root(self, s: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's probability of words with so many customers and tables after sweep ``s``."""
        return (customers - self.root_discount * tables) / (ROOT_STRENGTH + self.tables[s].sum()) + self.base(s)

    def own(self, context: np.ndarray, n: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The part of a context's probability of a word that does not come from its parent."""
        return (n - self.discount * tables) / (STRENGTH + self.customers[context])

    def sweep(self, s: int, word: np.ndarray, size: np.ndarray, context: np.ndarray, n: np.ndarray, tables: np.ndarray, root: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each pair and of each word's root after sweep ``s``, from those before and the root's probabilities ``p`` before."""
        weight = (STRENGTH + self.discount * self.tables[s - 1][context]) * np.repeat(p, size)
        start = np.cumsum(size) - size
        held = np.add.reduceat(tables, start).astype(np.int64)
        tables = reseat(np.repeat(word, size), context, s, n, tables, weight, self.discount)
        # the root's customers are the tables below, so their number changes with each sweep
        came = np.add.reduceat(tables, start).astype(np.int64)
        none = np.zeros(len(word), np.int64)
        weight = np.full(len(word), (ROOT_STRENGTH + self.root_discount * self.root_tables[s - 1]) / (self.types + 1))
        stayed, root = unseat(word, none - 1, s, held, root, np.maximum(held - came, 0), self.root_discount)
        root = seat(word, none - 2, s, came, weight, self.root_discount, stayed, root)
        return tables, reseat(word, none - 3, s, came, root, weight, self.root_discount)


_STATE = "word long, contexts array<int>, counts array<long>, tables array<int>, root int, own array<float>, parents array<float>"


def _lists(values: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(values, kind))


def _after(state: DataFrame, totals: Totals, s: int, burn: int, last: bool) -> DataFrame:
    """The state after sweep ``s``, whose probabilities before it are taken in if ``s - 1`` is over ``burn``; the ``last`` one only takes in."""
    begun = "tables" in state.columns

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in rows:
            if not batch.num_rows:
                continue
            flat = lambda c, batch=batch: batch.column(c).flatten().to_numpy()
            size = batch.column("contexts").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            word, context, n = batch.column("word").to_numpy().view(np.uint64), flat("contexts").astype(np.int64), flat("counts")
            tables = flat("tables").astype(float) if begun else np.ones(len(n))
            root = batch.column("root").to_numpy().astype(float) if begun else np.ones(len(word))
            own = flat("own").astype(float) if begun else np.zeros(len(n))
            parents = flat("parents").reshape(len(word), -1) if begun else np.zeros((len(word), 0), np.float32)
            p = totals.root(s - 1, np.add.reduceat(tables, np.cumsum(size) - size), root)
            if s - 1 > burn:
                own += totals.own(context, n, tables)
                parents = np.concatenate([parents, p[:, None].astype(np.float32)], axis=1)
            if not last:
                tables, root = totals.sweep(s, word, size, context, n, tables, root, p)
            columns = [batch.column("word"), batch.column("contexts"), batch.column("counts"), _lists(tables.astype(np.int32), size, pa.int32()), pa.array(root.astype(np.int32))]
            columns += [_lists(own.astype(np.float32), size, pa.float32()), _lists(parents.reshape(-1).astype(np.float32), np.full(len(word), parents.shape[1]), pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "contexts", "counts", "tables", "root", "own", "parents"])

    return state.mapInArrow(batches, _STATE)


def _sums(state: DataFrame, contexts: int) -> tuple[np.ndarray, float]:
    """(tables of each context, tables of the root) of a seating."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        sums = np.zeros(contexts + 1)
        for batch in rows:
            sums[:contexts] += np.bincount(batch.column("contexts").flatten().to_numpy(), weights=batch.column("tables").flatten().to_numpy(), minlength=contexts)
            sums[-1] += batch.column("root").to_numpy().sum()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["z", "t"])

    got = state.select("contexts", "tables", "root").mapInArrow(batches, "z long, t double").groupBy("z").agg(F.sum("t").alias("t")).toArrow()
    out = np.zeros(contexts + 1)
    out[got.column("z").to_numpy()] = got.column("t").to_numpy()
    return out[:-1], float(out[-1])


def sampled(pairs: DataFrame, contexts: int, *, sweeps: int = 3, burn: int = 1) -> tuple[Totals, DataFrame]:
    """The totals of all sweeps, and (word, n, contexts, own, parents): each word's own part in each context, averaged over
    the sweeps after ``burn``, and its root probability after each of them."""
    entries = pairs.select("word", F.explode(F.arrays_zip("contexts", "counts")).alias("e"))
    seen = entries.groupBy(F.col("e.contexts").alias("z")).agg(F.sum("e.counts").alias("n"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("e.counts") == 1).alias("once"), F.count_if(F.col("e.counts") == 2).alias("twice")).collect()  # a row a context
    customers, tables = np.zeros(contexts), np.zeros(contexts)
    for r in seen:
        customers[r.z], tables[r.z] = r.n, r.types
    share = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
    types, one, two = pairs.agg(F.count(F.lit(1)), F.count_if(F.size("contexts") == 1), F.count_if(F.size("contexts") == 2)).first()
    totals = Totals(customers, tables, types, share(sum(r.once for r in seen), sum(r.twice for r in seen)), share(one, two))
    state, spark = pairs, pairs.sparkSession
    before = None
    for s in range(1, sweeps + 1):
        path = table_path(spark, "seating")
        _after(state, totals, s, burn, last=False).write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        in_contexts, in_root = _sums(state, contexts)
        totals.tables.append(in_contexts)
        totals.root_tables.append(in_root)
        if before:
            drop_table(spark, before)
        before = path
    final = _after(state, totals, sweeps + 1, burn, last=True)
    own = F.transform("own", lambda x: x / F.lit(float(sweeps - burn)).cast("float"))
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return totals, final.select("word", n.alias("n"), "contexts", own.cast("array<float>").alias("own"), "parents")


class Head:
    """The words of most training tokens: counts, own parts by word and context, and root probabilities."""

    def __init__(self, table: pa.Table, contexts: int, tokens: int, types: int) -> None:
        """``table``: rows in the order of ``predictive`` by falling count and word."""
        table = table.combine_chunks()
        lists = table.column("contexts").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
        keep = int(np.searchsorted(np.cumsum(size), HEAD, side="right"))
        if 0 < keep < len(size):
            # words of one count stay together, so that the rest is told by the count alone
            counts = table.column("n").to_numpy()
            keep = int(np.searchsorted(-counts, -counts[keep], side="left"))
        table, size = table.slice(0, keep), size[:keep]
        word, counts = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
        #: Words of fewer tokens are not in the table; the last one's place among words of its count.
        self.last = (int(counts[-1]), int(word.view(np.int64)[-1])) if keep else None
        order = np.argsort(word)
        self.words = word[order]
        place = np.empty(keep, np.int64)
        place[order] = np.arange(keep)
        flat = table.column("contexts").combine_chunks().flatten().to_numpy() if keep else np.zeros(0, np.int32)
        own = table.column("own").combine_chunks().flatten().to_numpy() if keep else np.zeros(0, np.float32)
        key = np.repeat(place, size) * contexts + flat
        sort = np.argsort(key)
        self.keys, self.own, self.contexts = key[sort], own[sort], contexts
        self.parents = table.column("parents").combine_chunks().flatten().to_numpy().reshape(keep, -1)[order] if keep else np.zeros((0, 1), np.float32)
        self.base = np.log10((counts[order] + 1.0) / (tokens + types + 1))

    def find(self, word: np.ndarray) -> np.ndarray:
        """Row of each word, or -1."""
        if not len(self.words):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at, -1)

    def logs(self, at: np.ndarray, context: np.ndarray, back: np.ndarray) -> np.ndarray:
        """log10 probability of the rows ``at`` in their contexts; ``back``: weight of the parent by sweep and context."""
        key = at * self.contexts + context
        # equal pairs are looked up once
        pairs, where = np.unique(key, return_inverse=True)
        found = np.minimum(np.searchsorted(self.keys, pairs), max(len(self.keys) - 1, 0))
        own = np.where(self.keys[found] == pairs, self.own[found], np.float32(0)) if len(self.keys) else np.zeros(len(pairs))
        row, z = pairs // self.contexts, pairs % self.contexts
        return np.log10(own + np.einsum("ij,ij->i", self.parents[row], back[:, z].T) / len(back))[where.reshape(-1)]


def ended(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word, text) of every token; each text ends in END."""
    hashes, _, _, firsts, _ = words(texts)
    n, k = len(hashes), len(texts)
    word = np.full(n + k, END)
    word[np.arange(n) + np.repeat(np.arange(k), np.diff(firsts))] = hashes
    return word, np.repeat(np.arange(k, dtype=np.int32), np.diff(firsts) + 1)


def after(word: np.ndarray, text: np.ndarray, begin: np.generic) -> np.ndarray:
    """What stands before every token; each text begins after ``begin``."""
    before = np.append(begin, word[:-1])
    before[np.flatnonzero(np.diff(text, prepend=-1))] = begin
    return before


def bigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, text, key of both) of every token; each text begins after BEGIN and ends in END."""
    word, text = ended(texts)
    before = after(word, text, BEGIN)
    return word, before, text.astype(np.int64), pair_key(before, word)


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before) + word * np.uint64(0x9E3779B97F4A7C15))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each compressed by the places of its bytes."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = pa.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(a) else b""
        out.append(struct.pack("<cqq", a.dtype.char.encode(), len(a), len(body)) + body)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n, size = struct.unpack_from("<cqq", blob, at)
        at, kind = at + struct.calcsize("<cqq"), np.dtype(kind.decode())
        raw = pa.decompress(blob[at : at + size], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().reshape(-1).view(kind))
        at += size
    return out


@functools.lru_cache(maxsize=1)
def _ranks(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """Sorted known words, their ranks, tokens by rank, and the first place of each value of the leading bits, all but so many."""
    keys, rank, totals = unpack(blob)
    shift = np.uint64(63 - len(keys).bit_length())
    starts = np.searchsorted(keys, np.arange(2 << len(keys).bit_length(), dtype=np.uint64) << shift)
    return keys, rank.astype(np.int64), totals, starts, shift


def _ranked(blob: bytes, word: np.ndarray) -> np.ndarray:
    """Rank of each word, or -1."""
    keys, rank, _, starts, shift = _ranks(blob)
    at = starts[(word >> shift).astype(np.int64)]
    below = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] < word))
    while len(below):
        at[below] += 1
        below = below[at[below] < len(keys)]
        below = below[keys[at[below]] < word[below]]
    at = np.minimum(at, len(keys) - 1)
    return np.where(keys[at] == word, rank[at], -1)


@functools.lru_cache(maxsize=1)
def _opened(blob: bytes, discounts: tuple[float, float], roots: tuple[tuple[int, float], ...]) -> list[np.ndarray]:
    """Known words, tokens and customers, the weights of opening a table and the root's probabilities by sweep; ``roots``: its customers and base."""
    word, total, customers, *seats = unpack(blob)
    d, d0 = discounts
    opens = [STRENGTH + d * t for t in seats[::3]]
    p = [(m - d0 * r) / (ROOT_STRENGTH + tables) + base for m, r, (tables, base) in zip(seats[1::3], seats[2::3], roots, strict=True)]
    return [word, total, customers, np.stack(opens), np.stack(p)]


def _steps(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs (context << 32 | word) as small numbers: steps of the context, and of the word within a context."""
    z, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    step = np.diff(z, prepend=0)
    return step.astype(np.uint32), np.where(np.diff(z, prepend=-1) == 0, np.diff(w, prepend=0), w).astype(np.uint32)


def _from_steps(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    total, z = np.cumsum(w.astype(np.int64)), np.cumsum(z.astype(np.int64))
    first = np.flatnonzero(np.diff(z, prepend=-1))
    before = np.repeat(total[first] - w[first], np.diff(np.append(first, len(z))))
    return (z << 32 | (total - before)).astype(np.uint64)


def _sparse(*counts: np.ndarray) -> list[np.ndarray]:
    out = []
    for a in counts:
        at = np.flatnonzero(a)
        out += [np.diff(at, prepend=0).astype(np.uint32), a[at].astype(np.int64)]
    return out


def _tallies(texts: DataFrame) -> DataFrame:
    """(w, total): how often each word, and the end, is in the rows' texts."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[tuple] = []

        def collapsed() -> tuple[np.ndarray, np.ndarray]:
            word, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(word)
            word, n = word[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            return word[first], np.add.reduceat(n, first)

        def out(part: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], names=["w", "total"])

        for batch in (b for whole in rows for b in small_batches(whole)):
            held.append(np.unique(np.append(words(batch.column("text").cast(pa.binary()).to_pylist())[0], np.full(batch.num_rows, END)), return_counts=True))
            if sum(len(x[0]) for x in held) > HELD:
                held = [collapsed()]
                if len(held[0][0]) > HELD // 2:
                    yield out(held[0])
                    held = []
        if held:
            yield out(collapsed())

    return texts.select("text").mapInArrow(batches, "w long, total long").groupBy("w").agg(F.sum("total").alias("total"))


#: What a row of the tables below holds: ids of a chunk of texts, the pairs of a part, where they stand, the seating of those
#: seen more than once, counts of the known words, counts of one other word.
IDS, PAIRS, PLACES, SEATING, COUNTS, WORD = range(6)
_FLOW = "b int, chunk long, kind int, blob binary, w long, x long, y long, many boolean"
#: Tokens and texts of a chunk (a text's number takes 15 bits), and tokens of a part in powers of two.
CHUNK, TEXTS, PART = 1 << 21, 1 << 15, 21


def _flow(b: int, blobs: list[tuple[int, int, bytes]], w: np.ndarray, x: np.ndarray, y: np.ndarray, many: np.ndarray) -> pa.Table:
    """Rows of ``_FLOW``: (chunk, kind, blob) and the counts of single words."""
    k, n = len(blobs), len(w)
    none = [None] * k
    return pa.table({
        "b": pa.array(np.full(k + n, b), pa.int32()), "chunk": pa.array([c for c, _, _ in blobs] + [-1] * n, pa.int64()), "kind": pa.array([c for _, c, _ in blobs] + [WORD] * n, pa.int32()),
        "blob": pa.array([c for _, _, c in blobs] + [None] * n, pa.binary()),
        **{name: pa.concat_arrays([pa.array(none, kind), pa.array(values, kind)]) for name, values, kind in (("w", w.view(np.int64), pa.int64()), ("x", x, pa.int64()), ("y", y, pa.int64()), ("many", many, pa.bool_()))},
    })


def _dealt(rows: DataFrame, sent, begin: int, bottom: float, buckets: int) -> DataFrame:
    """The pairs of every chunk of texts, dealt into parts by their keys, with the texts that hold them; and the chunk's ids."""

    def chunk(number: int, parts: list[tuple], ids: list[pa.Array], held: np.ndarray) -> Iterator[tuple]:
        totals = _ranks(sent.value)[2]
        known, (word, of) = len(totals), (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()  # not held twice
        code, k = _ranked(sent.value, word), len(held)
        inside = code >= 0
        base = np.bincount(of[inside], weights=np.log10((totals[code[inside]] + 1.0) / bottom), minlength=k)
        whole = pa.RecordBatch.from_arrays([pa.chunked_array(ids).combine_chunks(), pa.array(held), pa.array(np.bincount(of, minlength=k)), pa.array(np.bincount(of[inside], minlength=k)), pa.array(base, pa.float64())], names=["id", "held_out", "n_tokens", "n_known", "base_score"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(whole)
        yield int(mix(np.array([number], np.uint64))[0] % np.uint64(buckets)), number, IDS, sink.getvalue().to_pybytes()
        before = after(word, of, BEGIN)
        part = (pair_key(before, word) % np.uint64(buckets)).astype(np.uint32 if buckets >> 16 else np.uint16)
        z = after(code, of, np.int64(begin))
        others = np.unique(np.append(word[~inside], before[z < 0]))
        z[z < 0] = known + np.searchsorted(others, before[z < 0])
        code[~inside] = known + np.searchsorted(others, word[~inside])
        pairs = (z << 32 | code).astype(np.uint64)
        del word, before, code, z, inside
        # tokens come by text, so that equal pairs stay sorted by text
        order = np.argsort(pairs, kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        pairs, part, of = pairs[order], part[order], of[order]
        del order
        new = np.append(True, pairs[1:] != pairs[:-1])
        entry = np.flatnonzero(new | np.append(True, of[1:] != of[:-1]))
        n, tag = np.diff(np.append(entry, len(of))), (of[entry] | np.where(held[of[entry]], TEXTS, 0)).astype(np.uint16)
        first = np.flatnonzero(new[entry])
        per = np.diff(np.append(first, len(entry)))
        pairs, part = pairs[entry[first]], part[entry[first]]
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for lo, hi in zip(edge, np.append(edge[1:], len(part)), strict=True):
            at = slice(first[lo], first[hi] if hi < len(first) else len(entry))
            mine, own = _own(pairs[lo:hi], others, known)
            yield int(part[lo]), number, PLACES, pack(*_steps(mine), per[lo:hi].astype(np.uint32), tag[at], n[at].astype(np.uint32), own)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        number, parts, ids, held, tokens = TaskContext.get().partitionId() << 20, [], [], np.zeros(0, bool), 0

        def out() -> pa.RecordBatch:
            made = zip(*chunk(number, parts, ids, held), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["b", "chunk", "kind", "blob"])

        for batch in (b.slice(lo, TEXTS) for whole in rows for b in small_batches(whole) for lo in range(0, b.num_rows, TEXTS)):
            if parts and (tokens >= CHUNK or len(held) + batch.num_rows > TEXTS):
                yield out()
                number, parts, ids, held, tokens = number + 1, [], [], held[:0], 0
            word, of = ended(batch.column("text").cast(pa.binary()).to_pylist())
            parts.append((word, of + np.int32(len(held))))
            ids.append(batch.column("id"))
            held, tokens = np.append(held, batch.column("held").to_numpy(zero_copy_only=False)), tokens + len(word)
        if parts:
            yield out()

    return rows.mapInArrow(batches, "b int, chunk long, kind int, blob binary")


def _own(pairs: np.ndarray, others: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs and those of the ``others``, the words that are not known, that are in them; these numbered anew after the known ones."""
    z, w = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    used = np.unique(np.append(z[z >= known], w[w >= known]))
    again = lambda c: np.where(c >= known, np.searchsorted(used, c).astype(np.uint64) + np.uint64(known), c)
    return again(z) << np.uint64(32) | again(w), others[(used - np.uint64(known)).astype(np.int64)]


def _codes(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _merged(known: int):
    """One part's pairs of all chunks together."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lean()
        blobs = [(r["chunk"], r["kind"], r["blob"]) for r in table.to_pylist()]
        ids, read = [x for x in blobs if x[1] == IDS], [(c, unpack(x)) for c, kind, x in blobs if kind == PLACES]
        none = np.zeros(0, np.uint64)
        if not read:
            return _flow(key[0].as_py(), ids, none, none, none, none.astype(bool))
        others = np.unique(np.concatenate([x[5] for _, x in read]))
        local, n = [], []
        for _, (z, w, per, tag, count, own) in read:
            z, w = _codes(_from_steps(z, w))
            new = np.append(np.arange(known), known + np.searchsorted(others, own))
            local.append((new[z] << 32 | new[w]).astype(np.uint64))
            n.append(np.add.reduceat(np.where(tag >= TEXTS, 0, count.astype(np.int64)), np.cumsum(per.astype(np.int64)) - per))
        every = np.concatenate(local)
        order = np.argsort(every, kind="stable")  # quick, as each chunk's are sorted already
        new = np.append(True, every[order[1:]] != every[order[:-1]])
        pairs, where = every[order[new]], np.empty(len(every), np.int64)
        where[order] = np.cumsum(new) - 1
        n = np.bincount(where, weights=np.concatenate(n)).astype(np.int64)
        at, places = 0, []
        for (c, (_, _, per, tag, count, _)), x in zip(read, local, strict=True):
            mine = where[at : at + len(x)]
            at += len(x)
            places.append((c, PLACES, pack(np.diff(mine, prepend=0).astype(np.int32), per, tag, count)))
        z, w = _codes(pairs[n > 0])
        size = known + len(others)
        contexts, types = np.bincount(z, minlength=size), np.bincount(w, minlength=size)
        moving, own = _own(pairs[n > 1], others, known)
        counts = n[n > 1]
        seating = pack(*_steps(moving), counts, np.ones(len(counts), np.int64), np.zeros(len(counts), np.int64), own)
        made = [*ids, *places, (-1, PAIRS, pack(*_steps(pairs), n, others)), (-1, SEATING, seating)]
        made.append((-1, COUNTS, pack(*_sparse(contexts[:known], types[:known]), np.array([(n > 0).sum(), (n == 1).sum(), (n == 2).sum()]))))
        return _flow(key[0].as_py(), made, others, contexts[known:], types[known:], np.isin(others, own))

    return merge


def _numbers(right: pa.Table, others: np.ndarray, *columns: str) -> list[np.ndarray]:
    """The columns of a part's other words in their order."""
    order = np.argsort(right.column("w").to_numpy().view(np.uint64))
    assert len(order) == len(others)
    return [right.column(c).to_numpy()[order] for c in columns]


def _seated(sent, s: int, discounts: tuple[float, float], root: tuple[int, float], keep: bool):
    """One part's sweep."""

    def sweep(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        discount, (word, _, _, (opens,), (p_known,)) = discounts[0], _opened(sent.value, discounts, (root,))
        known = len(word)
        steps_z, steps_w, n, t, kept, others = unpack(left.column("blob")[0].as_py())
        word, (t_other, p_other) = np.append(word, others), _numbers(right, others, "t", "p")
        z, w = _codes(_from_steps(steps_z, steps_w))
        new = np.append(opens, STRENGTH + discount * t_other)[z] * np.append(p_known, p_other)[w]
        t = reseat(word[w], word[z], s, n, t.astype(float), new, discount).astype(np.int64)
        size, at = known + len(others), np.flatnonzero(t > 1)
        grown = [np.bincount(c[at], weights=t[at] - 1, minlength=size).astype(np.int64) for c in (z, w)]
        made = [(-1, SEATING, pack(steps_z, steps_w, n, t, kept + t if keep else kept, others)), (-1, COUNTS, pack(*_sparse(*(g[:known] for g in grown)), np.zeros(3, np.int64)))]
        x, y = (g[known:] for g in grown)
        more = (x > 0) | (y > 0)
        return _flow(left.column("b")[0].as_py(), made, others[more], x[more], y[more], np.ones(more.sum(), bool))

    return sweep


def _added(counts: DataFrame, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the known words as contexts and as words, and the three numbers with them, of all parts."""

    def add(blobs) -> list[np.ndarray]:
        out = [np.zeros(known, np.int64), np.zeros(known, np.int64), np.zeros(3, np.int64)]
        for at_z, z, at_w, w, rest in map(unpack, blobs):
            out[0][np.cumsum(at_z.astype(np.int64))] += z
            out[1][np.cumsum(at_w.astype(np.int64))] += w
            out[2] += rest
        return out

    def some(table: pa.Table) -> pa.Table:
        x, y, rest = add(table.column("blob").to_pylist())
        return pa.table({"blob": pa.array([pack(*_sparse(x, y), rest)], pa.binary())})

    # 16 rows at most
    return tuple(add(counts.select((F.col("b") % 16).alias("g"), "blob").groupBy("g").applyInArrow(some, "blob binary").toArrow().column("blob").to_pylist()))


class Restaurants:
    """A restaurant for every previous word and for the begin of a text, over one root.

    Words of most tokens (``HEAD_PAIRS`` // 2 of them, known words) are known by their rank, and what a sweep needs of them goes to
    the tasks as bounded arrays; the other words are rows, joined with the parts that hold them. Pairs lie in parts by their keys, as
    compressed arrays, and every part is one row. A pair seen once has one table in every seating, so only the others are seated again.
    Rows that are ``held`` count nothing.
    """

    def __init__(self, rows: DataFrame, sweeps: int, burn: int, held: Column | None = None) -> None:
        spark, self.kept = rows.sparkSession, sweeps - burn
        rows = rows.select("id", (F.lit(False) if held is None else held).alias("held"), "text")
        share = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
        totals, totals_path = self._table(_tallies(rows.where(~F.col("held"))), "totals")
        self.tokens, self.types, texts = (int(x or 0) for x in totals.agg(F.sum("total"), F.count(F.lit(1)), F.sum(F.when(F.col("w") == int(END.view(np.int64)), F.col("total")))).first())
        often = sorted(((r.n, r.words) for r in totals.groupBy(F.least("total", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)  # 65,536 rows at most
        total, least = 0, 1 << 62
        for n, count in often:
            total += count
            if total > HEAD_PAIRS // 2:
                break
            least = n
        found = totals.where(F.col("total") >= least).toArrow()
        word, total = (found.column(c).to_numpy() for c in ("w", "total"))
        order = np.lexsort((word, -total))
        # the begin is known and last
        self.word, self.total = np.append(word.view(np.uint64)[order], BEGIN), np.append(total[order], 0)
        self.customers, known = np.append(np.where(self.word == END, 0, self.total)[:-1], texts), len(self.word)
        order = np.argsort(self.word)
        self.bottom = float(self.tokens + self.types + 1)
        sent = spark.sparkContext.broadcast(pack(self.word[order], order, self.total))
        buckets = max(24, self.tokens >> PART)
        flow = _dealt(rows, sent, known - 1, self.bottom, buckets).groupBy("b").applyInArrow(_merged(known), _FLOW)
        self.flow, _ = self._table(flow, "pairs", "kind")
        sent.destroy()
        of = lambda table, kind: table.where(F.col("kind") == kind)
        contexts, types, (count, once, twice) = _added(of(self.flow, COUNTS), known)
        self.discount = d = share(int(once), int(twice))
        # t: tables of the context; m: tables of the word in all contexts, the root's customers; r: the root's tables of the word
        least_t, least_m = contexts, types
        t, m, r = contexts, types, np.minimum(types, 1)
        fewest = of(self.flow, WORD).groupBy(F.col("w").alias("of")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        other = totals.where(F.col("total") < least).join(fewest, F.col("w") == F.col("of"), "left").selectExpr("w", "total", "x AS least_t", "y AS least_m", "x AS t", "y AS m", "1L AS r", "CAST(array() AS array<double>) AS back", "CAST(array() AS array<double>) AS p")
        other, path = self._table(other, "words")
        drop_table(spark, totals_path)
        one, two = other.agg(F.count_if(F.col("least_m") == 1), F.count_if(F.col("least_m") == 2)).first()
        self.root_discount = d0 = share(int(one + (types == 1).sum()), int(two + (types == 2).sum()))
        tables, root_tables, self.roots, self.seats = int(count), self.types, [], []
        # a word seen once has one table everywhere, in every sweep
        single, single_path = other.where("total = 1"), path
        other, singles = other.where("total > 1"), other.where("total = 1").count()
        moving, asked, seating_path = of(self.flow, SEATING), of(self.flow, WORD).where("many").select(F.col("b").alias("part"), F.col("w").alias("of")), None
        for s in range(1, sweeps + 1):
            base = (ROOT_STRENGTH + d0 * root_tables) / (ROOT_STRENGTH + tables) / (self.types + 1)
            chance = (F.col("m") - d0 * F.col("r")) / (ROOT_STRENGTH + tables) + base
            sent = spark.sparkContext.broadcast(pack(self.word, self.total, self.customers, t, m, r))
            needs = asked.join(other.select("w", "t", chance.alias("p")), F.col("of") == F.col("w")).select("part", "w", "t", "p")
            seats, new_path = self._table(moving.select("b", "blob").groupBy("b").cogroup(needs.groupBy("part")).applyInArrow(_seated(sent, s, (d, d0), (tables, base), s > burn), _FLOW), "seating", "kind")
            sent.destroy()
            moving = of(seats, SEATING)
            more_t, more_m, _ = _added(of(seats, COUNTS), known)
            grown = of(seats, WORD).groupBy(F.col("w").alias("of")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
            # the root's customers are the tables below, so their number changes with each sweep
            weight, t, came = (ROOT_STRENGTH + d0 * root_tables) / (self.types + 1), least_t + more_t, least_m + more_m
            r, m = _rooted(self.word, m, came, r, s, d0, weight), came
            joined = other.join(grown, F.col("w") == F.col("of"), "left").select("w", "total", "least_t", "least_m", (F.col("least_t") + F.coalesce("x", F.lit(0))).alias("t"), "m", (F.col("least_m") + F.coalesce("y", F.lit(0))).alias("came"), "r", "back", "p")
            rooted, rooted_path = self._table(joined.mapInArrow(_rooting(s, d0, weight), other.schema), "words")
            in_other = rooted.agg(F.sum("m"), F.sum("r")).first()
            tables, root_tables = (int(a.sum()) + int(x or 0) + singles for a, x in zip((m, r), in_other, strict=True))
            if s > burn:
                base = (ROOT_STRENGTH + d0 * root_tables) / (ROOT_STRENGTH + tables) / (self.types + 1)
                self.roots.append((tables, base))
                self.seats += [t, m, r]
                customers = F.when(F.col("w") == int(END.view(np.int64)), 0).otherwise(F.col("total"))
                grow = {"back": F.concat("back", F.array((STRENGTH + d * F.col("t")) / (STRENGTH + customers))), "p": F.concat("p", F.array((F.col("m") - d0 * F.col("r")) / (ROOT_STRENGTH + tables) + base))}
                rooted, single = rooted.withColumns(grow), single.withColumns(grow)
            for gone in (*([path] if path != single_path else []), *([seating_path] if seating_path else [])):
                drop_table(spark, gone)
            other, path, seating_path = rooted, rooted_path, new_path
            if s > burn:
                other, path = self._table(other, "words")
                drop_table(spark, rooted_path)
        self.unseen = [base for _, base in self.roots]
        self.other, self.seating, self.kind = other.unionByName(single), moving, rows.schema["id"].dataType.simpleString()
        self.least_t, self.least_m = least_t, least_m

    def _each(self, emit, schema: str, kinds: tuple[int, ...]) -> DataFrame:
        """What ``emit`` makes of each part: its number, blobs by kind, pairs, words, counts, and each word's tokens and each pair's log10 probability."""
        sent = self.other.sparkSession.sparkContext.broadcast(self._packed())
        unseen, kept, d, discounts, roots = np.array(self.unseen), self.kept, self.discount, (self.discount, self.root_discount), tuple(self.roots)

        def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            lean()
            word, total, customers, opens, p = _opened(sent.value, discounts, roots)
            back = opens / (STRENGTH + customers)
            blobs = [(r["chunk"], r["kind"], r["blob"]) for r in left.to_pylist()]
            one = {kind: unpack(blob) for _, kind, blob in blobs if kind in (PAIRS, SEATING)}
            steps_z, steps_w, n, others = one[PAIRS]
            (mine,) = _numbers(right, others, "total")
            order, heard = np.argsort(right.column("w").to_numpy().view(np.uint64)), ~np.isnan(mine)
            mine = np.where(heard, mine, 0).astype(np.int64)
            word, total, customers = np.append(word, others), np.append(total, mine), np.append(customers, np.where(others == END, 0, mine))
            # a word that is not in the training rows has the parent's whole weight, and the root's for an unseen type
            lists = [np.tile(fill[:, None], (1, len(others))) for fill in (np.ones(kept), unseen)]
            for full, name in zip(lists, ("back", "p"), strict=True):
                flat = right.column(name).combine_chunks().take(pa.array(order[heard])).flatten()
                full[:, heard] = flat.to_numpy().reshape(-1, kept).T
            back, p = (np.concatenate([a, b], axis=1) for a, b in zip((back, p), lists, strict=True))
            z, w = _codes(_from_steps(steps_z, steps_w))
            mean = np.ones(len(n))
            mean[n > 1] = one[SEATING][4] / kept
            own = np.where(n > 0, (n - d * mean) / (STRENGTH + customers[z]), 0.0)
            shared = sum((back[i][z] * p[i][w] for i in range(1, kept)), back[0][z] * p[0][w]) / kept
            return emit(left.column("b")[0].as_py(), blobs, word, z, w, n, total, np.log10(own + shared))

        needs = self.flow.where(F.col("kind") == WORD).select(F.col("b").alias("part"), F.col("w").alias("of")).join(self.other.select("w", F.col("total").cast("double").alias("total"), "back", "p"), F.col("of") == F.col("w"), "left").select("part", F.col("of").alias("w"), "total", "back", "p")
        # a part without pairs holds ids only
        left = self.flow.where(F.col("kind").isin(PAIRS, *kinds)).unionByName(self.seating).select("b", "chunk", "kind", "blob")
        return left.groupBy("b").cogroup(needs.groupBy("part")).applyInArrow(score, schema)

    def _packed(self) -> bytes:
        return pack(self.word, self.total, self.customers, *self.seats)

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        """The root's weights and probabilities of the known words in the sweeps kept."""
        _, _, customers, opens, p = _opened(self._packed(), (self.discount, self.root_discount), tuple(self.roots))
        return opens / (STRENGTH + customers), p

    @property
    def pairs(self) -> DataFrame:
        """(key, n, total, score): every pair of the training rows with its count, its word's tokens and its log10 probability."""

        def emit(_, blobs, word, z, w, n, total, score) -> pa.Table:
            at = n > 0
            return pa.table({"key": pair_key(word[z[at]], word[w[at]]).view(np.int64), "n": n[at], "total": total[w[at]], "score": score[at]})

        return self._each(emit, "key long, n long, total long, score double", ())

    @property
    def contexts(self) -> DataFrame:
        """(z, c, back): customers and the root's weights in the sweeps kept."""
        at = np.flatnonzero(self.least_t)
        rows = pa.table({"z": self.word[at].view(np.int64), "c": self.customers[at], "back": pa.array(self._known()[0][:, at].T.tolist(), pa.list_(pa.float64()))})
        return self.other.where("least_t > 0").selectExpr("w AS z", "total AS c", "back").unionByName(self.other.sparkSession.createDataFrame(rows))

    @property
    def words(self) -> DataFrame:
        """(w, total, p): tokens and the root's probabilities in the sweeps kept."""
        at = np.flatnonzero(self.least_m)
        rows = pa.table({"w": self.word[at].view(np.int64), "total": self.total[at], "p": pa.array(self._known()[1][:, at].T.tolist(), pa.list_(pa.float64()))})
        return self.other.select("w", "total", "p").unionByName(self.other.sparkSession.createDataFrame(rows))

    def scores(self) -> DataFrame:
        """(id, held_out, n_tokens, n_known, base_score, score) of every row."""
        bottom, known = self.bottom, len(self.word)

        def emit(b, blobs, word, z, w, n, total, score) -> pa.Table:
            out = []
            # the known words are in the ids' sums already
            rest = w >= known
            base, heard = np.where(rest, np.log10((total[w] + 1.0) / bottom), 0.0), rest & (total[w] > 0)
            for number, kind, blob in blobs:
                if kind != PLACES:
                    continue
                step, per, tag, count = unpack(blob)
                at, text = np.repeat(np.cumsum(step.astype(np.int64)), per), (tag & np.uint16(TEXTS - 1)).astype(np.int64)
                there, more = np.flatnonzero(np.bincount(text)), rest[at]
                sums = np.bincount(text, weights=count * score[at])[there].astype(float)
                few = np.flatnonzero(np.bincount(text[more]))
                some = [np.bincount(text[more], weights=count[more] * x[at[more]])[few] for x in (heard, base)]
                out.append((number, pack(there.astype(np.uint16), sums, few.astype(np.uint16), some[0].astype(np.uint32), some[1].astype(float))))
            return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "kind": pa.array([PLACES] * len(out), pa.int32()), "blob": pa.array([c for _, c in out], pa.binary())})

        def whole(table: pa.Table) -> pa.Table:
            lean()
            rows = table.to_pylist()
            ids = pa.ipc.open_stream(next(r["blob"] for r in rows if r["kind"] == IDS)).read_all()
            score, n_known, base = np.zeros(len(ids)), ids.column("n_known").to_numpy().copy(), ids.column("base_score").to_numpy().copy()
            # in one order of the parts, whichever comes first
            for blob in sorted(r["blob"] for r in rows if r["kind"] == PLACES):
                there, sums, few, heard, lower = unpack(blob)
                score[there] += sums
                n_known[few] += heard
                base[few] += lower
            return pa.table({"id": ids.column("id"), "held_out": ids.column("held_out"), "n_tokens": ids.column("n_tokens"), "n_known": n_known, "base_score": base, "score": score})

        sums = self._each(emit, "chunk long, kind int, blob binary", (PLACES,))
        ids = self.flow.where(F.col("kind") == IDS).select("chunk", "kind", "blob")
        return ids.unionByName(sums).groupBy("chunk").applyInArrow(whole, f"id {self.kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")

    @staticmethod
    def _table(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
        """A written table and its path; what was shuffled for it goes at once."""
        spark, path = df.sparkSession, table_path(df.sparkSession, name)
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        return spark.read.schema(df.schema).parquet(path), path


def _rooted(word: np.ndarray, held: np.ndarray, came: np.ndarray, root: np.ndarray, s: int, discount: float, weight: float) -> np.ndarray:
    """The root's tables of each word after sweep ``s``, of ``held`` customers before it and ``came`` after it."""
    none, new = np.zeros(len(held), np.int64), np.full(len(held), weight)
    stayed, root = unseat(word, none - 1, s, held, root.astype(float), np.maximum(held - came, 0), discount)
    return reseat(word, none - 3, s, came, seat(word, none - 2, s, came, new, discount, stayed, root), new, discount).astype(np.int64)


def _rooting(s: int, discount: float, weight: float):
    names = ["w", "total", "least_t", "least_m", "t", "m", "r", "back", "p"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            word, held, came, root = (batch.column(c).to_numpy() for c in ("w", "m", "came", "r"))
            now = {"m": batch.column("came"), "r": pa.array(_rooted(word.view(np.uint64), held, came, root, s, discount, weight))}
            yield pa.RecordBatch.from_arrays([now[c] if c in now else batch.column(c) for c in names], names=names)

    return batches


def _shared_out(per: DataFrame, tokens: int, id_col: str, folds: int, fold: int) -> DataFrame:
    """A row for each of the equal rows whose sums were added up."""
    each = per.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    whole = lambda c: (F.col(c) / F.col("rows")).cast("long").alias(c)
    return each.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), whole("n_tokens"), whole("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_score") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"))


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, sweeps: int = 3, burn: int = 1, least_share: float = 0.0) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Every previous word has its restaurant; with a ``least_share`` only those of that share of the tokens, and the others share classes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not least_share:
        model = Restaurants(rows, sweeps, burn, held_out(F.col("id"), folds, fold))
        return model.scores().select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
    training = rows.where(~held_out(F.col("id"), folds, fold))
    own = own_contexts(training, least_share)
    contexts = FIXED + int((own >= 0).sum())
    pairs = written(count_pairs(training, own), "pairs")
    totals, model = sampled(pairs, contexts, sweeps=sweeps, burn=burn)
    model = written(model, "model")
    tokens, types = int(totals.customers.sum()), totals.types
    kept = range(burn + 1, sweeps + 1)
    back = np.stack([totals.back(s) for s in kept]).astype(np.float32)  # sweeps x contexts
    bases = [totals.base(s) for s in kept]
    first = model.orderBy(F.desc("n"), "word").limit(HEAD_WORDS)
    head = Head(first.toArrow(), contexts, tokens, types)
    last, sent = head.last, spark.sparkContext.broadcast((head, own, back))
    del head
    names = ["id", "same", "word", "context", "n"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        head, own, back = sent.value
        for batch in (b for whole in parts for b in small_batches(whole)):
            word, context, of = text_tokens(batch.column("text").cast(pa.binary()).to_pylist(), own)
            at, k = head.find(word), batch.num_rows
            in_head = at >= 0
            inside = of[in_head]
            sums = np.stack([np.bincount(of, minlength=k), np.bincount(inside, minlength=k), np.bincount(inside, weights=head.base[at[in_head]], minlength=k), np.bincount(inside, weights=head.logs(at[in_head], context[in_head], back), minlength=k)])
            # a row for each of a text's sums, known by its negative context; its word is spread, so that no key of the join below is hot
            row = np.repeat(np.arange(k), len(sums))
            spread = mix(batch.column("same").to_numpy().view(np.uint64)[row] + np.arange(len(row), dtype=np.uint64))
            rows_ = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows_), batch.column("same").take(rows_), pa.array(spread.view(np.int64)), pa.array(np.tile(-1 - np.arange(len(sums), dtype=np.int32), k)), pa.array(sums.T.reshape(-1).astype(float))], names=names)
            # other words: one row for each text, word and context
            rare = np.flatnonzero(~in_head)
            order = rare[np.lexsort((context[rare], word[rare], of[rare]))]
            w, t, z = word[order], of[order], context[order]
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (t[1:] != t[:-1]) | (z[1:] != z[:-1])])) if len(w) else np.zeros(0, int)
            n, rows_ = np.diff(np.append(first, len(w))), pa.array(t[first])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows_), batch.column("same").take(rows_), pa.array(w[first].view(np.int64)), pa.array(z[first].astype(np.int32)), pa.array(n.astype(float))], names=names)

    # equal rows have equal sums: they are added up and shared out again
    parts = rows.withColumn("same", F.xxhash64("text")).select("id", "same", "text").mapInArrow(batches, f"id {kind}, same long, word long, context int, n double")
    rest = F.lit(True) if last is None else (F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1]))
    tail = model.where(rest).withColumnsRenamed({"word": "w", "n": "c", "parents": "root"})
    backs = spark.createDataFrame([(z, [float(b[z]) for b in back]) for z in range(contexts)], "z int, back array<double>")  # a row a context
    joined = parts.join(tail, (F.col("context") >= 0) & (F.col("word") == F.col("w")), "left").join(F.broadcast(backs), F.col("context") == F.col("z"), "left")
    mean = lambda terms: sum(terms[1:], terms[0]) / len(terms)
    shared = mean([F.element_at("root", i + 1) * F.element_at("back", i + 1) for i in range(len(back))])
    unseen = mean([F.lit(float(v)) * F.element_at("back", i + 1) for i, v in enumerate(bases)])
    place = F.array_position("contexts", F.col("context")).cast("int")
    seen = F.when(place > 0, F.try_element_at("own", place)).otherwise(F.lit(0.0))
    tail_score = F.log10(F.when(F.col("c").isNull(), unseen).otherwise(seen + shared))
    tail_base = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(tokens + types + 1)))
    is_tail = F.col("context") >= 0
    given = lambda k: F.when(F.col("context") == -1 - k, F.col("n"))
    per = joined.groupBy("id", "same").agg(
        F.count_if(F.col("context") == -1).alias("rows"),
        F.sum(given(0)).alias("n_tokens"),
        F.sum(F.when(is_tail & F.col("c").isNotNull(), F.col("n")).otherwise(F.coalesce(given(1), F.lit(0.0)))).alias("n_known"),
        F.sum(F.when(is_tail, F.col("n") * tail_base).otherwise(F.coalesce(given(2), F.lit(0.0)))).alias("base_score"),
        F.sum(F.when(is_tail, F.col("n") * tail_score).otherwise(F.coalesce(given(3), F.lit(0.0)))).alias("score"),
    )
    return _shared_out(per, tokens, id_col, folds, fold)
