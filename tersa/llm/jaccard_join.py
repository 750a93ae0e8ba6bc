"""N-gram Jaccard join with prefix trees.

Documents with equal sets are one class from the start. Every set has its shingles in one global
order: the most frequent ones last, otherwise by hash. Two sets that are similar enough share a shingle among
the first few of each (prefix filter), so classes meet under those shingles only.

Classes that share a shingle meet at its least class, the hub: a class goes to each of its hubs once, however many shingles it
shares with them. There they stand in a prefix tree, a trie of the ordered sets, that all probes walk together: what sets share
from the start is counted once for all of them, and a probe leaves a subtree as soon as what remains of it, or of the
subtree's longest set, cannot reach the bound. This is done twice: first with the shared shingles of the prefixes, which
tells the classes that may have a partner, then with the whole sets of these. The walk is the join: no pair of classes is ever a row
unless it is a link that joins two components of its tree.

A tree has a bounded number of shingles, PAGE. Where a hub has more, its classes are compared with the hub first. Those of its
component stand in trees of their own, by size class and hash, and are not compared with each other again; the others go as probes
to each tree of a size that they can be similar to. So nothing that could add a link is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.blocks import Words, distinct, each_block, in_blocks, list_of, member, rolling, slices
from tersa.llm.common import partitions, pick, written
from tersa.llm.graph import components
from tersa.llm.tokens import batches

#: Shingles in the prefixes of more classes than this may go last in the order, at most so many of them: the bound on what is broadcast.
FREQUENT, MOST_FREQUENT = 64, 1_000_000
#: Shingles in a tree; each set counts as so many more, which bounds the number of sets.
PAGE, SURCHARGE = 1_000_000, 500
#: Bytes of the table of which probe has which shingle, and of probes that wait for a walk.
TABLE_BYTES, WAITING_BYTES = 16 << 20, 8 << 20
#: Places of classes in blocks, up to this many, are broadcast as 8 bytes each.
BROADCAST_PLACES = 1_000_000
#: Bytes of text that are made into shingles together.
SLICE_BYTES = 512 << 10


def set_sizes(n: int, percent: int) -> int:
    """How many of the first shingles of a set of ``n`` two similar sets must have one in common of."""
    return n - -(-percent * n // 100) + 1


def need(n: int, m: int, percent: int) -> int:
    """The least overlap with which sets of ``n`` and ``m`` reach ``percent`` in 100 of their union."""
    return -(-percent * (n + m) // (100 + percent))


def least(n: np.ndarray, low: int, high: int, percent: int, fronts: bool) -> np.ndarray:
    """The least overlap with which sets of ``n`` can be similar to one of ``low`` to ``high``.

    With ``fronts`` the overlap is of prefixes. All shingles that the prefix ending first shares with the other set are
    in both prefixes, so the whole overlap is at most that of the prefixes and what follows the one of the greater set.
    """
    low, high = np.maximum(low, -(-percent * n // 100)), np.minimum(high, 100 * n // percent)
    least_of = lambda m: need(n, m, percent) - (-(-percent * np.maximum(n, m) // 100) - 1)
    # Of prefixes, the bound rises up to n and falls from there on: it is least at an end.
    found = np.minimum(least_of(low), least_of(high)) if fronts else need(n, low, percent)
    return np.where(low > high, np.iinfo(np.int64).max, found)


def shingle_sets(docs: pa.Table, size: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each document of a block, made a slice of the block at a time."""
    texts, out = docs.column("text").combine_chunks(), []
    for low, high in slices(texts, SLICE_BYTES):
        words = Words(texts.slice(low, high - low), lower=True)
        full = rolling(words.hash, size, 0x3C6E)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            n = b - a
            if n >= size:
                out.append(distinct(full[a : b - size + 1]))
            elif n:
                out.append(np.array([xxhash.xxh3_64_intdigest(words.hash[a:b].tobytes(), seed=n)], dtype=np.uint64))
            else:
                out.append(np.array([], dtype=np.uint64))
    return out


def ordered(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set in the global order."""
    late = member(shingles, frequent)
    return np.concatenate([shingles[~late], shingles[late]])


class PrefixTree:
    """A trie of sets in the global order, as their sorted list: a node is a run of sets with a common beginning.

    ``sets`` are of distinct hashes in any order; ``sizes``, where they are only parts of sets, are the sizes of these."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int] | None = None, frequent: np.ndarray | None = None):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets] if sizes is None else sizes, dtype=np.int64)
        self.frequent = np.array([], dtype=np.uint64) if frequent is None else frequent

    def _ranked(self, sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, int]:
        """The sets as ascending places in the global order, and for each place its column, 0 if only one set has it."""
        values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), dtype=np.int64)
        rank[np.argsort(member(values, self.frequent), kind="stable")] = np.arange(len(values))
        column = np.zeros(len(values), dtype=np.int64)
        shared = np.sort(rank[count > 1])
        column[shared] = np.arange(1, len(shared) + 1)
        ends = np.cumsum([len(s) for s in sets])[:-1]
        return [np.sort(x) for x in np.split(rank[place], ends)], column, len(shared) + 1

    def similar(self, probe: np.ndarray, percent: int) -> list[int]:
        """Numbers of the sets that reach ``percent`` with the probe."""
        return [i for i, _ in self.matches(percent, [probe], [len(probe)])] if self.sets else []

    def matches(
        self, percent: int, probes: list[np.ndarray] | None = None, sizes: list[int] | None = None, fronts: bool = False
    ) -> Iterator[tuple[int, np.ndarray]]:
        """The number of a set, and those of the probes (the tree's own sets, if there are none) that can be similar to it.
        A shingle that only one set has counts for none, so a set alone does not match itself."""
        stored = len(self.sets)
        lists, column, width = self._ranked(self.sets if probes is None else [*self.sets, *probes])
        own, n_own = (lists, self.sizes) if probes is None else (lists[stored:], np.array(sizes, dtype=np.int64))
        lists = lists[:stored]
        order = sorted(range(stored), key=[x.astype(">u4").tobytes() for x in lists].__getitem__)
        lists, m = [lists[i] for i in order], self.sizes[order]
        lengths = np.array([len(x) for x in lists])
        step = max(1, TABLE_BYTES // width)
        for at in range(0, len(own), step):
            for i, hits in self._walk(lists, lengths, m, own[at : at + step], n_own[at : at + step], column, width, percent, fronts):
                yield order[i], hits + at

    @staticmethod
    def _walk(lists, lengths, m, probes, n, column, width, percent, fronts) -> Iterator[tuple[int, np.ndarray]]:
        each = np.array([len(x) for x in probes])
        flat, row = np.concatenate(probes), np.repeat(np.arange(len(probes)), each)
        has = np.zeros((len(probes), width), dtype=bool)
        has[row, column[flat]] = True
        has[:, 0] = False
        top = len(column)
        flat, start = flat + row * top, np.cumsum(each) - each
        none = np.zeros(len(probes), dtype=np.int64)
        todo = [(0, len(lists), 0, np.arange(len(probes)), none, none)]
        while todo:
            lo, hi, depth, who, overlap, passed = todo.pop()
            # The path that all sets of the run share is walked once for all of them.
            first, last = lists[lo], lists[hi - 1]
            shortest = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:shortest] != last[depth:shortest])
            end = depth + int(differ[0]) if len(differ) else shortest
            if end > depth:
                path = first[depth:end]
                overlap = overlap + has[np.ix_(who, column[path])].sum(axis=1)
                passed = np.searchsorted(flat, who * top + path[-1], side="right") - start[who]
            reach = overlap + np.minimum(each[who] - passed, int(lengths[lo:hi].max()) - end)
            stay = reach >= least(n[who], int(m[lo:hi].min()), int(m[lo:hi].max()), percent, fronts)
            if not stay.any():
                continue
            who, overlap, passed = who[stay], overlap[stay], passed[stay]
            while lo < hi and lengths[lo] == end:
                hit = overlap >= least(n[who], int(m[lo]), int(m[lo]), percent, fronts)
                if hit.any():
                    yield lo, who[hit]
                lo += 1
            while lo < hi:
                value, stop, stride = lists[lo][end], lo + 1, 1
                while stop < hi and lists[min(stop + stride, hi) - 1][end] == value:
                    stop, stride = min(stop + stride, hi), stride * 2
                while stop < hi and lists[stop][end] == value:
                    stop += 1
                todo.append((lo, stop, end, who, overlap, passed))
                lo = stop


class Page:
    """The classes of one tree at ``hub``: ``names``, their tree, and ``label``, the component of each under the links found so far.

    With ``fronts`` the tree is of prefixes, and ``hubs`` are all hubs of each class: of the hubs that two classes
    have in common only the least answers for them."""

    def __init__(self, hub: int, names: list[int], sets: list[np.ndarray], sizes: list[int], hubs: list[list[int]], percent: int, fronts: bool, frequent: np.ndarray, apart: bool):
        self.hub, self.names, self.percent, self.fronts = hub, np.array(names, dtype=np.int64), percent, fronts
        self.tree = PrefixTree(sets, sizes, frequent)
        self.label = np.arange(len(names)) if apart else np.zeros(len(names), dtype=np.int64)
        self.apart, self.hubs = apart, hubs

    def _lesser(self, hubs: list[list[int]], column: dict[int, int]) -> np.ndarray:
        """Which class has which hub less than this one."""
        out = np.zeros((len(hubs), len(column)), dtype=bool)
        for i, own in enumerate(hubs):
            out[i, [column[h] for h in own if h in column]] = True
        return out

    def able(self, probes: tuple[list[int], list[np.ndarray], list[int], list[list[int]]] | None) -> np.ndarray:
        """Pairs (hub, class) of the classes that may have a partner for which this hub answers."""
        names, sets, sizes, hubs = probes or (self.names, None, None, self.hubs)
        column = {h: k for k, h in enumerate(sorted({h for own in self.hubs for h in own if h < self.hub}))}
        mine = self._lesser(self.hubs, column)
        theirs = mine if probes is None else self._lesser(hubs, column)
        own, other = np.zeros(len(self.names), dtype=bool), np.zeros(len(names), dtype=bool)
        for i, hits in self.tree.matches(self.percent, sets, sizes, True):
            hits = hits[~(theirs[hits] & mine[i]).any(axis=1)]
            hits = hits[hits != i] if probes is None else hits
            other[hits] = True
            own[i] |= len(hits) > 0
        found = np.union1d(self.names[own], np.asarray(names, dtype=np.int64)[other])
        return np.stack([np.full(len(found), self.hub), found], axis=1)

    def links(self, probes: tuple[list[int], list[np.ndarray], list[int], list[list[int]]] | None) -> np.ndarray:
        """Links (a, b): of the tree's own classes those that join two components of it, of probes one to each component."""
        out: list[tuple[int, int]] = []
        if probes is None:
            for i, hits in self.tree.matches(self.percent) if self.apart else ():
                other, one = np.unique(self.label[hits], return_index=True)
                for label, j in zip(other.tolist(), hits[one].tolist(), strict=True):
                    if label != self.label[i]:
                        out.append((self.names[i], self.names[j]))
                        self.label[self.label == label] = self.label[i]
        else:
            names, sets, sizes, _ = probes
            seen = set()
            for i, hits in self.tree.matches(self.percent, sets, sizes):
                for j in hits.tolist():
                    if (j, self.label[i]) not in seen:
                        seen.add((j, self.label[i]))
                        out.append((self.names[i], names[j]))
        return np.array(out, dtype=np.int64).reshape(-1, 2)


def profiles(blocks: DataFrame, size: int) -> DataFrame:
    """block, place, doc_id, n, node: the class of each document's set; node null for an empty one."""

    def rows(block: int, docs: pa.Table) -> pa.RecordBatch:
        sets = shingle_sets(docs, size)
        nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
        n = len(sets)
        cols = [
            pa.array([block] * n, pa.int64()),
            pa.array(range(n), pa.int64()),
            docs.column("doc_id").combine_chunks(),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(nodes, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["block", "place", "doc_id", "n", "node"])

    return each_block(blocks, rows, "block long, place long, doc_id long, n long, node long")


def owned(nodes: DataFrame) -> DataFrame:
    """block, places: of each class one document, in the block that holds it."""
    return nodes.groupBy("block").agg(F.collect_list("place").alias("places"))


def _each_once(docs: pa.Table, size: int) -> list[tuple[int, np.ndarray]]:
    """node and set of the documents of a block that have shingles, each set once."""
    found: dict[int, np.ndarray] = {}
    for s in shingle_sets(docs, size):
        if len(s):
            found.setdefault(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), s)
    return list(found.items())


def prefix_counts(blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """shingle, n: by block, shingles near the front of its distinct sets, by hash alone."""

    def rows(block: int, docs: pa.Table) -> pa.RecordBatch | None:
        front = [s[: set_sizes(len(s), percent) * 3 // 2 + 1] for _, s in _each_once(docs, size)]
        if not front:
            return None
        value, n = np.unique(np.concatenate(front), return_counts=True)
        # A shingle that is in one set of a block counts too, but few of these make it frequent.
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return each_block(blocks, rows, "shingle long, n long")


def frequent_shingles(blocks: DataFrame, size: int, percent: int) -> np.ndarray:
    """Ascending hashes of the most frequent shingles; a bounded number, for the order only."""
    counts = prefix_counts(blocks, size, percent).groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") > FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT)
    return np.sort(np.array([r.shingle for r in top.select("shingle").toLocalIterator()], dtype=np.int64).view(np.uint64))


def prefixes(blocks: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """shingle, node, n: the prefix of each distinct set of a block in the global order."""

    def rows(block: int, docs: pa.Table) -> pa.RecordBatch | None:
        value, node, n = [], [], []
        for name, s in _each_once(docs, size):
            head = ordered(s, frequent)[: set_sizes(len(s), percent)]
            value.append(head)
            node.append(np.full(len(head), name, dtype=np.int64))
            n.append(np.full(len(head), len(s), dtype=np.int32))
        if not value:
            return None
        cols = [np.concatenate(value).view(np.int64), *map(np.concatenate, (node, n))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shingle", "node", "n"])

    return each_block(blocks, rows, "shingle long, node long, n int")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
    flat = np.concatenate([*sets, np.array([], dtype=np.uint64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def set_rows(blocks: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, members (the set's hashes) of ``nodes`` (node, block, place), as a written table."""

    def rows(block: int, docs: pa.Table, places: pa.Scalar) -> pa.RecordBatch | None:
        sets = shingle_sets(docs, size)
        use = [sets[int(i)] for i in list_of(places)]
        nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in use]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(use)], ["node", "members"])

    # Up to so many places the blocks stay where they are; beyond that they join by shuffle.
    places = F.broadcast(owned(nodes)) if nodes.count() <= BROADCAST_PLACES else owned(nodes)
    asked = blocks.select("block", "payload").join(places, "block")
    return written(each_block(asked, rows, "node long, members array<long>"), "sets")


def _members(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


KEY = ("hub", "out", "class", "page")


def walked(rows: DataFrame, percent: int, fronts: bool, frequent: np.ndarray) -> DataFrame:
    """a, b from the rows of trees (KEY, kind, node, n, hubs, members): kind 0 stands in the tree, kind 1 is a probe."""

    def walk(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, page, held, waiting = None, None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal page, held, waiting
            if not held:
                return
            names, sets, sizes, hubs = (list(x) for x in zip(*held, strict=True))
            held, waiting, probes = [], 0, None
            if page is None:
                page = Page(key[0], names, sets, sizes, hubs, percent, fronts, frequent, bool(key[1]))
            else:
                probes = names, sets, sizes, hubs
            found = page.able(probes) if fronts else page.links(probes)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches(rows, 500):
            *names, kinds, nodes, sizes, hubs = (c.to_pylist() for c in batch.columns[:-1])
            sets = _members(batch.column(batch.num_columns - 1))
            for *at, kind, node, n, own, s in zip(*names, kinds, nodes, sizes, hubs, sets, strict=True):
                if at != key or (kind and (page is None or waiting > WAITING_BYTES)):
                    yield from flush()
                    key, page = at, page if at == key else None
                held.append((node, s.copy(), n, own))
                waiting += kind * s.nbytes
        yield from flush()

    given = F.col("hubs") if fronts else F.array().cast("array<long>").alias("hubs")
    dealt = rows.select(*KEY, "kind", "node", "n", given, "members")
    dealt = dealt.repartition(partitions(rows.sparkSession), *KEY).sortWithinPartitions(*KEY, "kind", "node")
    return dealt.mapInArrow(walk, "a long, b long")


def dealt(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of trees for classes at their hubs (KEY, big, node, n): each class in its tree, and, where a hub has several, each class
    outside the hub's component as a probe at every other tree that holds sets of its size or near it."""
    stored = rows.select(*KEY, F.lit(0).alias("kind"), "node", "n")
    pages = rows.where("big").select(*KEY).distinct()
    x = rows.where("big AND out").select("hub", F.col("class").alias("c"), F.col("page").alias("p"), "node", "n")
    near = (F.abs(F.col("class") - F.col("c")) <= 1) & (~F.col("out") | (F.col("class") > F.col("c")) | ((F.col("class") == F.col("c")) & (F.col("page") > F.col("p"))))
    probes = x.join(pages, "hub").where(near).select(*KEY, F.lit(1).alias("kind"), "node", "n")
    return stored.unionByName(probes).join(sets, "node")


def with_hub(rows: DataFrame, nodes: DataFrame, blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between a hub and its classes, for hubs with more than a tree holds. A hub's rows are split over tasks."""
    asked = rows.where("big").select("hub", "node", "n")
    part = F.pmod(F.xxhash64("node"), F.lit(partitions(rows.sparkSession)))
    probes = asked.where("hub <> node").select("hub", F.lit(False).alias("out"), F.lit(0).cast("long").alias("class"), part.alias("page"), F.lit(1).alias("kind"), "node", "n")
    tree = probes.select(*KEY).distinct().withColumn("kind", F.lit(0)).withColumn("node", F.col("hub"))
    tree = tree.join(nodes.select("node", "n"), "node")
    sets = set_rows(blocks, nodes.join(asked.select("node").distinct(), "node"), size)
    ready = tree.select(*probes.columns).unionByName(probes).join(sets, "node")
    return written(walked(ready, percent, False, np.array([], dtype=np.uint64)), "links", sets)


def linked(blocks: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """node, root for the classes that are linked with another."""
    nodes = rows.where("n > 0").groupBy("node").agg(F.min_by(F.struct("block", "place"), F.struct("block", "place")).alias("o"), F.first("n").alias("n"))
    nodes = written(nodes.select("node", "o.block", "o.place", "n"), "classes")
    frequent = frequent_shingles(blocks, size, percent)
    # Dealt by shingle once, for the hubs and for the join with them, of which the hubs are the smaller side. Both have to read the
    # same columns for that; no set in it has a size of 0.
    fronts = prefixes(blocks, size, percent, frequent).repartition("shingle")
    hubs = fronts.groupBy("shingle").agg(F.min("node").alias("hub"), F.max("node").alias("_last"), F.max("n").alias("_n"))
    hubs = hubs.where("hub <> _last AND _n > 0")
    # Copies in several blocks bring a set's prefix more than once.
    shared = fronts.join(hubs.select("shingle", "hub").hint("shuffle_hash"), "shingle").groupBy("node")
    shared = shared.agg(F.first("n").cast("long").alias("n"), F.collect_set("shingle").alias("members"), F.collect_set("hub").alias("hubs"))
    shared = written(shared, "fronts")

    at = shared.select(F.explode("hubs").alias("hub"), "node", "n")
    heavy = at.groupBy("hub").agg(F.sum(F.col("n") + SURCHARGE).alias("w")).withColumn("big", F.col("w") > PAGE)
    at = written(at.join(heavy.select("hub", "big"), "hub"), "at-hubs")
    first = None
    placed = at.withColumn("out", F.lit(True))
    if not at.where("big").isEmpty():
        first = with_hub(at, nodes, blocks, size, percent)
        of_hub = first.select("a", "b").withColumn("linked", F.lit(True)).distinct()
        # A class is of the hub's component if it is like the hub itself.
        placed = at.join(of_hub.select(F.col("a").alias("hub"), F.col("b").alias("node"), "linked"), ["hub", "node"], "left")
        placed = placed.withColumn("out", ~F.col("big") | (F.col("linked").isNull() & (F.col("hub") != F.col("node")))).drop("linked")
    # Sets that can be similar are in one size class or in neighbouring ones.
    width = math.log(100 / percent) * 1.0001
    placed = placed.withColumn("class", F.when(F.col("big"), F.floor(F.log("n") / width)).otherwise(0).cast("long"))
    group = ["hub", "out", "class"]
    weights = placed.groupBy(*group).agg(F.ceil(F.sum(F.col("n") + SURCHARGE) / PAGE).alias("pages"))
    placed = placed.join(weights, group).withColumn("page", F.pmod(F.xxhash64("node"), F.col("pages")))
    placed = written(placed.select(*KEY, "big", "node", "n"), "placed", at)

    able = walked(dealt(placed, shared.select("node", "members", "hubs")), percent, True, frequent)
    able = written(able.select(F.col("a").alias("hub"), F.col("b").alias("node")).distinct(), "able", shared)
    sets = set_rows(blocks, nodes.join(able.select("node").distinct(), "node"), size)
    last = walked(dealt(placed.join(able, ["hub", "node"], "left_semi"), sets), percent, False, frequent)
    last = last if first is None else last.unionByName(first.select("a", "b"))
    return components(written(last, "links", placed, able, sets, nodes))


def classes(blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """block, place, doc_id, n, component: the least doc_id that links reach; a document without shingles has its own."""
    rows = written(profiles(blocks, size), "profiles")
    roots = linked(blocks, rows, size, percent)
    full = rows.where("n > 0").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    full = written(full.select("block", "place", "doc_id", "n", "root"), "rooted")
    least = full.groupBy("root").agg(F.min("doc_id").alias("component"))
    none = rows.where("n = 0").select("block", "place", "doc_id", "n", F.col("doc_id").alias("component"))
    return full.join(least, "root").select("block", "place", "doc_id", "n", "component").unionByName(none)


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Words are what white space (ASCII) separates, A-Z in lower case; a set has the distinct shingles of ``size``
    words, or the whole sequence of a shorter text. Sets link when their overlap is ``percent`` in 100 of
    their union or more; classes follow links. Null and empty texts link with nothing and have
    n_shingles 0. Rows with equal texts are in one class; a null id is never the least unless all are
    null. An empty table gives no rows. Only doc_id and text are read. Hashes have 64 bits.
    """
    found = classes(in_blocks(pick(docs, "doc_id", "text")), size, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class, the first by doc_id; rows without shingles all stay."""
    names = docs.columns
    blocks = in_blocks(docs)
    found = classes(blocks, size, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "block", "place")
    first = found.where("n > 0").groupBy("component").agg(F.min(order).alias("o")).select("o.block", "o.place")
    stay = first.unionByName(found.where("n = 0").select("block", "place"))

    def keep(block: int, docs: pa.Table, places: pa.Scalar) -> pa.RecordBatch:
        use = docs.take(pa.array(list_of(places).view(np.int64))).select(names).combine_chunks()
        return use.to_batches()[0]

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.withColumn("doc_id", F.col("doc_id").cast("long")).dtypes)
    return each_block(blocks.join(owned(stay), "block"), keep, kinds)
