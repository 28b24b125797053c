"""Near-duplicate components by an LSH forest over MinHash signatures (operator 4).

1. Every whole text becomes its set of hashed word shingles. Equal sets are one class from here on, so
   thousands of exact copies cost one row each and no pair.
2. Each class gets ``trees`` signatures of ``depth`` min-hashes. A tree is a sorted order of all
   signatures, dealt over tasks by range, so a hot region is split wherever it is long.
3. A region is a run of rows that share a prefix. The depth adapts to it: a region of two hashes is compared
   wholly while it has at most ``SMALL`` rows; where more rows crowd it, it goes on to three hashes: each row
   meets its ``BEHIND`` neighbours there of longest common prefix, and one row that stands for the region, the
   first of its longest run of equal signatures. Rows of crowded regions, and of the regions that the bounds of
   a task cut, are remembered as crowded. Candidates are linear in the rows of each tree.
4. Of each class's candidates, that with most prefix in common, that which stands for its regions in most trees
   and the smallest one are confirmed on full sets, which joins most copies into components. Links inside a
   component change nothing, so what remains are candidates between components.
5. Candidates of wholly compared regions are all confirmed. A link in which no tree has a wholly compared
   region in common is between two crowded rows (but for 0.36 ** trees, when no prefix is shared at all). For
   crowded rows the search is exact: two sets can only be a link if they share one of their first shingles in
   any common order (a prefix filter: the first n - ceil(s n) + 1 of the larger set, the first
   n - ceil(2 s n / (1 + s)) + 1 of the smaller one). The order is shingles of one component only first, which lead
   to no pair and are left out, then the others from rare to common, by counts of these in a bounded number of
   buckets, so a passage that many texts share comes last; it decides the work, not the result. Places bound what
   two sets can share, and what remains is confirmed on full sets. Components are the connected ones over all confirmed links.

Defined results: a null or empty text, or one of white space, has an empty set and is alone; a text of
fewer words than a shingle is one shingle; repeated ids are grouped as one document each time they
appear (a component's id is the smallest id in it); a row with a null id stays alone, with a null component,
and is kept; ids that are no whole numbers are refused (TypeError); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpuslens.llm.hashing import bound_batches, lean, mix, shingles, small_batches, words
from corpuslens.llm.sieve import SENT_KEYS, id_filter
from corpuslens.operators.components import connected_components
from corpuslens.plans.lineage import cut, drop_table, table_path

#: A region of at most so many rows is compared wholly.
SMALL = 8
#: Neighbours behind a row in a crowded region.
BEHIND = 2
#: Counts of shared shingles by hash that order them from rare to common.
BUCKETS = 1 << 16


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def signature(sets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minimum over the set of each seeded hash, 32 bits."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max)
    for at in range(0, len(sets), 512):
        out = np.minimum(out, (sets[at : at + 512, None] * seeds[None, :]).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def shingle_sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the batch."""
    hashes, _, _, firsts, _ = words(batch.column("text").cast(pa.binary()).to_pylist())
    for lo, hi in zip(firsts[:-1], firsts[1:], strict=True):
        yield np.unique(shingles(hashes[lo:hi], width))


def _class(s: np.ndarray) -> bytes | None:
    """A hash of the whole set, none for an empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _bucket(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A written table and its path, for one that is dropped before the end."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _signed(docs: DataFrame, width: int, trees: int, depth: int) -> DataFrame:
    """(id, n_shingles, class, signature) of each row."""
    seeds = _seeds(trees * depth)
    names = ["id", "n_shingles", "class", "signature"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in (part for whole in rows for part in small_batches(whole)):
            sizes, classes, signs = [], [], []
            for s in shingle_sets(batch, width):
                sizes.append(len(s))
                classes.append(_class(s))
                signs.append(signature(s, seeds).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signs, pa.binary())], names=names)

    return docs.select("id", "text").mapInArrow(batches, "id long, n_shingles long, class binary, signature binary")


class _Regions:
    """One task's pass over the sorted signatures: hands on pairs (a, b, votes, must, a stands for a region of b, b for one of a) and crowded ids."""

    def __init__(self, depth: int) -> None:
        self.key, self.ids = np.zeros((0, depth + 1), np.uint32), np.zeros(0, np.int64)
        #: Rows at the front of what is held that are handed on already; more than none only in a crowded region.
        self.done = 0
        self.edge = True  # the first region may go on in the task before
        #: The row that stands for the crowded region in work: length of its run, id.
        self.top = (0, 0)

    def take(self, key: np.ndarray, ids: np.ndarray, last: bool) -> tuple[np.ndarray, ...] | None:
        key, ids = np.concatenate([self.key, key]), np.concatenate([self.ids, ids])
        n = len(ids)
        if not n:
            return None
        start = np.flatnonzero(np.concatenate([[True], (key[1:, :3] != key[:-1, :3]).any(axis=1)]))
        size = np.diff(np.append(start, n))
        crowded = size > SMALL
        crowded[0] |= self.edge or self.done > 0
        crowded[-1] |= last
        stop = n if last or crowded[-1] else start[-1]
        at = np.arange(self.done, stop)
        region = np.repeat(np.arange(len(start)), size)
        busy = crowded[region]
        place = np.arange(n) - start[region]
        found = []
        for back in range(1, SMALL):
            i = at[(place[at] >= back) & (~busy[at] | (back <= BEHIND))]
            found.append(self._compare(key, ids, i, key[i - back], ids[i - back], busy[i]))
        # the first row of the longest run of equal signatures stands for a crowded region
        runs = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        length = np.diff(np.append(runs, n))
        order = np.lexsort((-length, region[runs]))
        best = order[np.searchsorted(region[runs][order], np.arange(len(start)))]
        top_length, top = length[best], ids[runs[best]]
        if self.done and self.top[0] > top_length[0]:
            top_length[0], top[0] = self.top
        own = at[busy[at]]
        found.append(self._compare(key, ids, own, key[start[region[own]]], top[region[own]], busy[own], top=True))
        out = (*(np.concatenate(x) for x in zip(*found, strict=True)), np.unique(ids[at[busy[at]]]))
        if stop < n:  # a small region that may go on: all of it is kept for later
            keep, self.done = n - stop, 0
            self.edge = self.edge and len(start) == 1
        else:
            keep = self.done = min(n, BEHIND)
            self.edge = False
            self.top = int(top_length[-1]), int(top[-1])
        self.key, self.ids = key[n - keep :].copy(), ids[n - keep :].copy()
        return out

    @staticmethod
    def _compare(key, ids, i, other, other_ids, busy, top=False) -> tuple[np.ndarray, ...]:
        if top:
            shared = np.full(len(i), 2)
        else:
            same = key[i] == other
            shared = np.where(same[:, 0], np.cumprod(same[:, 1:], axis=1).sum(axis=1), 0)
        ok = (shared >= np.where(busy & (not top), 3, 2)) & (ids[i] != other_ids)
        x, y = ids[i][ok], other_ids[ok]
        return np.minimum(x, y), np.maximum(x, y), shared[ok].astype(np.int64), ~busy[ok], ((y < x) & top).astype(np.int64), ((y > x) & top).astype(np.int64)


def _forest(classes: DataFrame, trees: int, depth: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Candidate pairs of class ids (a, b, votes, must, for_b, for_a), a < b, the crowded ids (id), and the paths of both tables.

    ``votes``: shared hashes summed over the trees; ``must``: some tree compared the pair's region wholly;
    ``for_b``, ``for_a``: trees in which a stands for the region of b, and b for that of a.
    """
    spark = classes.sparkSession
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    part = F.substring("signature", F.col("tree") * F.lit(4 * depth) + 1, F.lit(4 * depth))
    # the tree's number first: one range partitioning orders all trees
    rows = rows.select(F.concat(F.unhex(F.lpad(F.hex("tree"), 4, "0")), part).alias("key"), "id")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    names = ["a", "b", "votes", "must", "for_b", "for_a"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        regions = _Regions(depth)

        def handed(found: tuple[np.ndarray, ...] | None) -> Iterator[pa.RecordBatch]:
            if found is not None:
                *columns, crowded = found
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
                k = pa.nulls(len(crowded), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(crowded, pa.int64()), k, k, pa.nulls(len(crowded), pa.bool_()), k, k], names=names)

        for batch in batches:
            raw = batch.column("key").to_pylist()
            if raw:
                key = np.frombuffer(b"".join(b"\0\0" + k for k in raw), ">u4").reshape(len(raw), depth + 1).astype(np.uint32)
                yield from handed(regions.take(key, batch.column("id").to_numpy(), last=False))
        yield from handed(regions.take(np.zeros((0, depth + 1), np.uint32), np.zeros(0, np.int64), last=True))

    scanned, path = _table(rows.mapInArrow(scan, "a long, b long, votes long, must boolean, for_b long, for_a long"), "scanned")
    pairs, pairs_path = _table(scanned.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("votes").alias("votes"), F.bool_or("must").alias("must"), F.sum("for_b").alias("for_b"), F.sum("for_a").alias("for_a")), "pairs")
    crowded, crowded_path = _table(scanned.where("b IS NULL").select(F.col("a").alias("id")).distinct(), "crowded")
    drop_table(spark, path)
    return pairs, crowded, [pairs_path, crowded_path]


def _sets(texts: DataFrame, ids: DataFrame, width: int, repeated: bool, crowded: DataFrame | None = None) -> tuple[DataFrame, str]:
    """(id, class, size, hashes, asked, busy) and the table's path: full sets of ``ids`` (``asked``) and of ``crowded`` ids (``busy``).
    Made again from the texts, which are not shuffled: filters of bounded size tell which ids may be among them."""
    wanted = id_filter(ids)
    packed = None if crowded is None else id_filter(crowded)

    def sets_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for whole in rows:
            x = whole.column("id").to_numpy()
            for batch in small_batches(whole.filter(pa.array(wanted(x) if packed is None else wanted(x) | packed(x))), limit=1 << 20):
                x = batch.column("id").to_numpy()
                sets = list(shingle_sets(batch, width))
                columns = [pa.array([_class(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                columns += [pa.array(wanted(x)), pa.array(np.zeros(len(x), bool) if packed is None else packed(x))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "class", "size", "hashes", "asked", "busy"])

    sets = texts.where("id IS NOT NULL").mapInArrow(sets_of, "id long, class binary, size long, hashes binary, asked boolean, busy boolean")
    if repeated:
        sets = sets.dropDuplicates(["id", "class"])
    return _table(sets, "sets")


def _left_over(sets: DataFrame, classes: DataFrame, crowded: DataFrame, found: DataFrame, least: float) -> tuple[DataFrame, str]:
    """(a, b) and the table's path: every pair of ``crowded`` class ids of different components of ``found`` (n, component) that the prefix filter lets pass."""
    spark = sets.sparkSession
    # copies are one row: only their class's own id stays, and a row that repeats it too counts once
    component = classes.join(crowded.toDF("n"), F.col("id") == F.col("n"), "left_semi").join(found, F.col("id") == F.col("n"), "left")
    component, component_path = _table(component.select(F.col("id").alias("of_id"), F.col("class").alias("of_class"), F.coalesce("component", "id").alias("component")), "crowded-components")
    few = component.count() <= SENT_KEYS
    firsts = sets.where("busy AND size > 0").join(F.broadcast(component) if few else component, (F.col("id") == F.col("of_id")) & (F.col("class") == F.col("of_class")))
    firsts = firsts.select("id", "component", "size", "hashes")

    def tokens_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in rows:
            token = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64)
            owner = np.repeat(batch.column("component").to_numpy(), batch.column("size").to_numpy())
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            first = np.ones(len(token), bool)
            first[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(token[first])], names=["component", "id"])

    # shingles of one component only lead to no pair
    shared = firsts.select("component", "size", "hashes").mapInArrow(tokens_of, "component long, id long").groupBy("id").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared, shared_path = _table(shared.where("lo < hi").select("id", "n"), "shared")
    live = id_filter(shared)
    often = shared.groupBy(F.shiftrightunsigned("id", 20).bitwiseAND(BUCKETS - 1).alias("at")).agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    counts = np.zeros(BUCKETS, np.int64)
    counts[often.column("at").to_numpy()] = often.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(counts)

    def spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in rows:
            token, size = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64), batch.column("size").to_numpy()
            row, on = np.repeat(np.arange(len(size)), size), live(token.view(np.int64))
            # the common order: shingles of one component first, then from rare to common
            order = np.lexsort((token, np.where(on, sent.value[_bucket(token)] + 1, 0), row))
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)  # rows keep their places
            n = size[row]
            keep = on[order] & (place < n - np.ceil(least * n / 100 - 1e-9) + 1)
            token, row, place, n = token[order][keep].view(np.int64), row[keep], place[keep], n[keep]
            index = place < n - np.ceil(2 * least * n / (100 + least) - 1e-9) + 1
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(batch.column("id").to_numpy()[row]), pa.array(batch.column("component").to_numpy()[row]), pa.array((n - place).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(index)], names=["token", "id", "component", "after", "size", "index"])

    rows, rows_path = _table(firsts.mapInArrow(spread, "token long, id long, component long, after int, size int, index boolean").distinct(), "postings")
    large = rows.select("token", *(F.col(c).alias(f"{c}_x") for c in ("id", "component", "after", "size")))
    small = rows.where("index").select(F.col("token").alias("token_y"), *(F.col(c).alias(f"{c}_y") for c in ("id", "component", "after", "size")))
    # of two sets of one size the smaller id is the smaller set
    met = large.join(small, (F.col("token") == F.col("token_y")) & (F.col("component_x") != F.col("component_y")) & ((F.col("size_y") < F.col("size_x")) | ((F.col("size_y") == F.col("size_x")) & (F.col("id_y") < F.col("id_x")))))
    met = met.where((100 * F.col("size_y") >= least * F.col("size_x")) & ((100 + least) * F.least("after_x", "after_y") >= least * (F.col("size_x") + F.col("size_y"))))
    pairs = _table(met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct(), "left-over")
    for path in (component_path, shared_path, rows_path):
        drop_table(spark, path)
    return pairs


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= least * union."""
    full = sets.where("asked")
    left = full.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = full.select(F.col("id").alias("b"), F.col("hashes").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # sizes alone rule out most pairs that can't be links, before their sets travel
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    sized = 100 * F.least(F.octet_length("x"), F.octet_length("y")) >= F.lit(least) * F.greatest(F.octet_length("x"), F.octet_length("y"))
    return joined.where(sized).select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 80, trees: int = 16, depth: int = 4) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept (the id is its component's).

    Links are pairs with 100 * intersection >= ``least`` * union of their distinct ``width``-word shingles.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, _ = _table(_signed(texts, width, trees, depth), "signed")
    classes = rows.where("class IS NOT NULL AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("id"), F.first("signature").alias("signature"))
    classes, classes_path = _table(classes, "classes")
    pairs, crowded, paths = _forest(classes.select("id", "signature"), trees, depth)
    repeated = rows.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] not in (None, 1)

    # each class with its best candidate, with that which stands for its regions, and with the smallest, which a wholly compared region has in common
    side = lambda x, y, top: pairs.select("a", "b", "votes", F.col(x).alias("x"), F.col(y).alias("y"), F.col(top).alias("top"))
    ends = F.struct("a", "b")
    chosen = side("a", "b", "for_a").unionByName(side("b", "a", "for_b")).groupBy("x").agg(
        F.max_by(ends, F.struct("votes", -F.col("y"))).alias("best"), F.max_by(ends, F.struct("top", "votes", -F.col("y"))).alias("most"), F.min_by(ends, "y").alias("least")
    )
    chosen = cut(chosen.select(F.explode(F.array("best", "most", "least")).alias("p")).select("p.a", "p.b").distinct())
    sets, sets_path = _sets(texts, _ends(chosen), width, repeated, crowded)
    links = cut(_confirmed(chosen, sets, least))
    found = cut(connected_components(links))

    label = lambda side: found.select(F.col("node").alias(f"n{side}"), F.col("component").alias(f"c{side}"))
    open_ = pairs.where("must").join(label("a"), F.col("a") == F.col("na"), "left").join(label("b"), F.col("b") == F.col("nb"), "left")
    open_ = open_.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").join(chosen.toDF("pa", "pb"), (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")), "left_anti")
    rest, rest_path = _left_over(sets, classes, crowded, found.toDF("n", "component"), least)
    drop_table(spark, sets_path)
    both = cut(open_.unionByName(rest).distinct())
    if not both.isEmpty():
        sets, sets_path = _sets(texts, _ends(both), width, repeated)
        more = _confirmed(both, sets, least).unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = cut(connected_components(more))
        drop_table(spark, sets_path)
    for path in (rest_path, *paths):
        drop_table(spark, path)
    found = found.toDF("n", "component")

    of_class = classes.join(found, F.col("id") == F.col("n"), "left").select(F.col("class").alias("of"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "n_shingles", "class").join(of_class, F.col("class") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
