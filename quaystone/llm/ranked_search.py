"""Ranked lexical search: each item's best documents by a dual-tree search.

An item is a vector of weights (how often it has a term, times the term's weight), a
document one of impacts (how much an occurrence of the term counts there); a score is
their inner product, in whole numbers. Items are the leaves of one hierarchy, documents of
another, and every node holds the maxima of its members' coordinates. The product of two
nodes' maxima bounds the scores of all their pairs, so a pair of nodes whose bound lies
below the weakest k-th score among its items is left out with everything under it. What
is left is scored exactly. No score that could be among an item's ``k`` best is missed:
bounds equal to a k-th score are followed.

1. `vocabulary`: the items' terms, in blocks of at most `BLOCK_TERMS` (item, term) pairs,
   which are sent to all tasks. Any number of items is any number of blocks.
2. `vectors`: one pass over the texts. A row per document with its length and the
   frequencies of the block's terms, written to the shared folder, and sums per partition
   (documents, their lengths, documents per term), which Spark adds up. Texts are not shuffled.
3. `search`, first over one document in `SEED`, for scores that each item's k-th best
   reaches at least, then over all documents, starting from those. Each task builds trees
   over `TREE` documents at a time, those of alike vocabulary side by side, and goes down
   both hierarchies. Its k best per item, few beyond the final ones, are ranked by Spark.

Scores are computed in doubles where they stay below 2**53, which doubles hold exactly,
else (items of some hundred thousand words) in 64-bit integers. Bounds get `SLACK` for
the rounding of their sums.

Defined results
    null text of document or item: no terms. Documents without terms count for nothing and
    are never found; items without terms find nothing. Equal scores: by ascending doc_id,
    null last. Repeated rows are documents, or items, of their own. Texts of any length are
    read whole, in portions. Empty table: empty result. Other columns, of any name, are
    ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.llm.shared import materialise

K = 20
#: (item, term) pairs in a block of items; some ten thousand items of usual length.
BLOCK_TERMS = 400_000
#: One document in so many gives the first k-th scores.
SEED = 32
#: Documents of a tree and of its leaves, items of a leaf, children of a node.
TREE, LEAF, ITEMS, FANOUT = 4096, 16, 8, 8
#: Bytes of a text that are split into terms at once.
PORTION = 1 << 20
#: Bounds are sums of doubles, each off by less than this share.
SLACK = 1 + 1e-9

_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
VECTORS = "row bigint, doc_id bigint, n bigint, ids array<int>, tfs array<bigint>"
FOUND = "item int, doc_id bigint, score bigint"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in portions: runs of ASCII letters and digits (A-Z lower-cased) and of all that is not ASCII."""
    data = (text or "").encode()
    at = 0
    while at < len(data):
        end = min(len(data), at + PORTION)
        while end < len(data) and _LETTERS[data[end]] != 0x20:
            end += 1
        yield data[at:end].translate(_LETTERS).split()
        at = end


@dataclass
class Block:
    """Items with their terms' numbers and frequencies, and the terms themselves."""

    rows: list[int] = field(default_factory=list)
    counts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def add(self, row: int, words: list[str], times: list[int]) -> None:
        ids = np.array([self.vocabulary.setdefault(w.encode(), len(self.vocabulary)) for w in words], np.int64)
        self.rows.append(row)
        self.counts.append((ids, np.array(times, np.int64)))


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, words, times`` for each row of ``items(item_id, text)`` that has terms; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                counts: Counter = Counter()
                for portion in terms(text):
                    counts.update(portion)
                found.append(counts)
            words = pa.array([[w.decode() for w in c] for c in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words, pa.array([[*c.values()] for c in found], pa.list_(pa.int64()))], names=["item_id", "words", "times"])

    made = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(run, "item_id bigint, words array<string>, times array<bigint>").where(F.size("words") > 0)
    return materialise(made.withColumn("item", F.monotonically_increasing_id()), "search-items")


def blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Block]:
    """The items of `item_terms` in blocks of ``most`` pairs (or one item); one block is held at a time."""
    block, pairs = Block(), 0
    for r in items.toLocalIterator():
        if pairs and pairs + len(r.words) > most:
            yield block
            block, pairs = Block(), 0
        block.add(r.item, r.words, r.times)
        pairs += len(r.words)
    if block.rows:
        yield block


def vectors(docs: DataFrame, block: Block) -> DataFrame:
    """`VECTORS` of ``docs(doc_id, text)`` in the block's terms.

    ``row`` numbers the documents; each partition ends with a row of -1 that holds its
    number of documents (``doc_id``), the sum of their lengths and its documents per term.
    """
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def vector(text: str | None, known: dict[bytes, int]) -> tuple[int, Counter]:
        n, counts = 0, Counter()
        for portion in terms(text):
            n += len(portion)
            counts.update([known[w] for w in portion if w in known])
        return n, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = shared.value, pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
        number, held, documents, words, per_term = (TaskContext.get().partitionId() << 33), [], 0, 0, Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, counts = vector(text.as_py(), known)
                documents, words, number = documents + (n > 0), words + n, number + 1
                per_term.update(counts.keys())
                if counts:
                    held.append((number, doc_id, n, [*counts.keys()], [*counts.values()]))
                if len(held) >= 2000:
                    yield made(held)
                    held = []
        yield made([*held, (-1, documents, words, [*per_term.keys()], [*per_term.values()])])

    return materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, VECTORS), "search-vectors")


@dataclass(frozen=True)
class Statistics:
    """Documents with terms, the sum of their lengths, and each term's weight."""

    documents: int
    words: int
    weights: np.ndarray


def statistics(made: DataFrame, terms_: int) -> Statistics:
    """Sums over all documents of `vectors`; what comes to the driver is a number per term of the block."""
    sums = made.where("row = -1")
    n, words = sums.agg(F.coalesce(F.sum("doc_id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(terms_, np.int64)
    for r in sums.select(F.explode(F.arrays_zip("ids", "tfs")).alias("t")).groupBy("t.ids").agg(F.sum("t.tfs").alias("df")).collect():
        df[r.ids] = r.df
    return Statistics(n, words, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))


class ItemNode:
    """Items and the maxima of their weights, by term; ``weakest`` is the least of their k-th scores."""

    def __init__(self, children: list[ItemNode], terms_: np.ndarray, most: np.ndarray):
        self.children, self.terms, self.most = children, terms_, most
        self.weakest = 1

    def bound(self, maxima: np.ndarray) -> float:
        return float(self.most @ maxima[self.terms]) * SLACK

    def refresh(self) -> None:
        self.weakest = min(c.weakest for c in self.children)


class ItemLeaf(ItemNode):
    def __init__(self, places: list[int], counts: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
        terms_ = np.unique(np.concatenate([ids for ids, _ in counts]))
        self.places, self.weights = np.array(places), np.zeros((len(places), len(terms_)))
        for row, (ids, times) in zip(self.weights, counts, strict=True):
            row[np.searchsorted(terms_, ids)] = times * weights[ids]
        self.whole = self.weights.astype(np.int64) if self.weights.sum(axis=1).max() * 1e6 >= 2.0**53 else None
        super().__init__([], terms_, self.weights.max(axis=0))


def item_tree(block: Block, weights: np.ndarray) -> tuple[ItemNode, list[ItemLeaf]]:
    """The hierarchy of a block's items, alike ones side by side (by their most frequent and their weightiest term)."""

    def key(place: int) -> tuple[int, int]:
        ids, times = block.counts[place]
        w = weights[ids]
        return int(ids[np.lexsort((ids, w))[0]]), int(ids[np.lexsort((ids, -times * w))[0]])

    order = sorted(range(len(block.rows)), key=key)
    leaves = [ItemLeaf(part, [block.counts[p] for p in part], weights) for part in (order[i : i + ITEMS] for i in range(0, len(order), ITEMS))]
    level: list[ItemNode] = [*leaves]
    while len(level) > 1:
        level = [_parent(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0], leaves


def _merged(ids: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and each one's greatest value."""
    found, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    most = np.zeros(len(found))
    np.maximum.at(most, inverse, np.concatenate(values))
    return found, most


def _parent(children: list[ItemNode]) -> ItemNode:
    return ItemNode(children, *_merged([c.terms for c in children], [c.most for c in children]))


class DocNode:
    """Documents and the maxima of their impacts, by term; a leaf's ``rows`` are its documents' places."""

    def __init__(self, children: list[DocNode], rows: np.ndarray | None, ids: np.ndarray, most: np.ndarray):
        self.children, self.rows, self.ids, self.most = children, rows, ids, most


class Documents:
    """Documents as vectors: ``ids`` and ``impacts`` of each one lie between two ``cuts``."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray, s: Statistics):
        self.doc_ids = doc_ids
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        self.ids, n = ids, len(sizes)
        m = 75 + (25 * lengths * s.documents) // s.words
        self.impacts = ((1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, sizes))).astype(np.float64)
        self.weighted = self.impacts * s.weights[ids]
        self.lightest = s.weights[ids]
        self.n = n

    def tree(self) -> DocNode:
        """Alike documents side by side: by the most common term they hold, then by the one that counts most."""
        owner = np.repeat(np.arange(self.n), np.diff(self.cuts))
        first = lambda *keys: self.ids[np.lexsort((self.ids, *keys, owner))[self.cuts[:-1]]]
        order = np.lexsort((first(-self.weighted), first(self.lightest)))
        level = []
        for i in range(0, self.n, LEAF):
            rows = order[i : i + LEAF]
            at = np.concatenate([np.arange(self.cuts[r], self.cuts[r + 1]) for r in rows])
            level.append(DocNode([], rows, *_merged([self.ids[at]], [self.impacts[at]])))
        while len(level) > 1:
            level = [self._parent(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        return level[0]

    @staticmethod
    def _parent(children: list[DocNode]) -> DocNode:
        return DocNode(children, None, *_merged([c.ids for c in children], [c.most for c in children]))


class Search:
    """The ``k`` best documents of each item of a block so far."""

    def __init__(self, block: Block, s: Statistics, k: int, known: np.ndarray | None):
        self.k, self.terms = k, len(block.vocabulary)
        self.root, self.leaves = item_tree(block, s.weights)
        self.best: list[list[tuple]] = [[] for _ in block.rows]
        self.weakest = np.maximum(1, known) if known is not None else np.ones(len(block.rows), np.int64)
        self.maxima, self.column = np.zeros(self.terms), np.full(self.terms, -1)
        self.scored = self.pairs = 0
        for leaf in self.leaves:
            leaf.weakest = int(self.weakest[leaf.places].min())
        self._refresh(self.root)

    def _refresh(self, node: ItemNode) -> None:
        for c in node.children:
            self._refresh(c)
        if node.children:
            node.refresh()

    def add(self, docs: Documents) -> None:
        self.pairs += docs.n * len(self.best)
        self._visit(docs, docs.tree(), [self.root])

    def _visit(self, docs: Documents, node: DocNode, against: list[ItemNode]) -> None:
        """Goes down both hierarchies: each level of documents meets the items' nodes that are left, one level further down."""
        self.maxima[node.ids] = node.most
        left = [i for i in against if i.bound(self.maxima) >= i.weakest]
        if node.rows is not None:
            while any(i.children for i in left):
                left = [c for i in left for c in (i.children or [i]) if c is i or c.bound(self.maxima) >= c.weakest]
            if left:
                self._score(docs, node, left)
        self.maxima[node.ids] = 0
        if node.rows is None and left:
            below = [c for i in left for c in (i.children or [i])]
            for child in node.children:
                self._visit(docs, child, below)
            for i in left:
                self._refresh(i)

    def _score(self, docs: Documents, node: DocNode, leaves: list[ItemLeaf]) -> None:
        """Exact scores of a leaf's documents for the items whose own bound still allows them."""
        self.column[node.ids] = np.arange(len(node.ids))
        dense = np.zeros((len(node.rows), len(node.ids) + 1))  # the last column is that of absent terms
        for r, d in enumerate(node.rows):
            a, b = docs.cuts[d], docs.cuts[d + 1]
            dense[r, self.column[docs.ids[a:b]]] = docs.impacts[a:b]
        for leaf in leaves:
            open_ = leaf.weights @ self.maxima[leaf.terms] * SLACK >= self.weakest[leaf.places]
            places = leaf.places[open_]
            if not len(places):
                continue
            impacts = dense[:, self.column[leaf.terms]].T
            scores = (leaf.weights[open_] @ impacts).astype(np.int64) if leaf.whole is None else leaf.whole[open_] @ impacts.astype(np.int64)
            self.scored += scores.size
            for place, row in zip(places.tolist(), scores, strict=True):
                found = np.flatnonzero(row >= self.weakest[place])
                for r in found.tolist():
                    doc_id = docs.doc_ids[node.rows[r]]
                    self.best[place].append((-int(row[r]), doc_id is None, doc_id))
                if len(found):
                    self._shorten(place)
            leaf.weakest = int(self.weakest[leaf.places].min())
        self.column[node.ids] = -1

    def _shorten(self, place: int) -> None:
        best = self.best[place]
        best.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        del best[self.k :]
        if len(best) == self.k:
            self.weakest[place] = max(self.weakest[place], -best[-1][0])

    def results(self) -> Iterator[tuple[int, int | None, int]]:
        for place in range(len(self.best)):
            self._shorten(place)
            for score, _, doc_id in self.best[place]:
                yield place, doc_id, -score


def _documents(batches: Iterator[pa.RecordBatch], s: Statistics, most: int) -> Iterator[Documents]:
    """Batches of `VECTORS` as `Documents` of about ``most`` rows."""
    held, rows = [], 0

    def made() -> Documents:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, tfs = t["ids"].combine_chunks(), t["tfs"].combine_chunks()
        return Documents(t["doc_id"].to_pylist(), t["n"].to_numpy(), np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy(), tfs.flatten().to_numpy(), s)

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            held.append(part)
            rows += part.num_rows
            if rows >= most:
                yield made()
                held, rows = [], 0
    if held:
        yield made()


def search(rows: DataFrame, block: Block, s: Statistics, k: int, known: np.ndarray | None) -> DataFrame:
    """`FOUND`: each task's ``k`` best of ``rows`` (`vectors`) for the block's items; those below ``known`` scores are left out."""
    shared = rows.sparkSession.sparkContext.broadcast((block.counts, s, known))
    size = len(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, stats, least = shared.value
        found = Search(Block([*range(len(counts))], counts, dict.fromkeys(range(size))), stats, k, least)
        for docs in _documents(batches, stats, TREE):
            found.add(docs)
        out = [*found.results()]
        if out:
            item, doc_id, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item with their ``rank``; partitions are cut to ``k`` before they are shuffled."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``."""
    spark = docs.sparkSession
    queries = item_terms(items)
    out = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint, rank int")
    for block in blocks(queries):
        made = vectors(docs, block)
        s = statistics(made, len(block.vocabulary))
        if not s.words:
            continue
        rows = made.where("row >= 0")
        known = np.zeros(len(block.rows), np.int64)
        first = search(rows.where(F.pmod(F.xxhash64("row"), F.lit(SEED)) == 0), block, s, k, None)
        for r in ranked(first, k).where(F.col("rank") == k).collect():  # a row per item of the block
            known[r.item] = r.score
        best = ranked(search(rows, block, s, k, known), k)
        numbers = F.broadcast(spark.createDataFrame([*enumerate(block.rows)], "item int, number bigint"))  # as many rows as the block has items
        best = best.join(numbers, "item").select(F.col("number").alias("item"), "doc_id", "score", "rank")
        out = out.unionByName(materialise(best, "search-found"))
    return out.join(queries.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SQL = rf"""with words as (select doc_id, rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select doc_id, text, row_number() over () as rid from documents)),
sizes as (select rid, any_value(doc_id) as doc_id, count(*) as n from words group by rid),
totals as (select count(*) as docs, sum(n)::bigint as total from sizes),
tfs as (select rid, term, count(*) as tf from words group by rid, term),
dfs as (select term, count(*) as df from tfs group by term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from dfs, totals),
asked as (select item_id, iid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select item_id, text, row_number() over () as iid from benchmark)),
items as (select iid, any_value(item_id) as item_id, term, count(*) as times from asked group by iid, term),
scores as (select iid, any_value(i.item_id) as item_id, rid, any_value(doc_id) as doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::bigint as score
  from items i join tfs using (term) join weights using (term) join sizes using (rid), totals group by iid, rid)
select item_id, row_number() over (partition by iid order by score desc, doc_id nulls last)::int as rank, doc_id, score from scores where score > 0 qualify rank <= {K}"""
