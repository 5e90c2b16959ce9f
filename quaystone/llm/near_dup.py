"""Near-duplicate documents by BagMinHash signatures, banding and exact verification.

A document is the multiset of its shingles of five words; similarity is the weighted
Jaccard measure of the multisets, sum of minima over sum of maxima. Signatures are
BagMinHash: each shingle runs Poisson processes over the cells of the discretised
weight axis, (0, 1], (1, 2], (2, 4], (4, 8] and so on; a cell that a weight covers
only in part is split in halves by the bits of a point's position. Each point falls
into one signature component, which keeps the earliest; points beyond the time by
which all components must be filled are never made.

1. Documents of the same words are one node (`sketches`).
2. Nodes that share a band of the signature meet in that bucket, and those whose
   signatures agree well enough are joined into candidate clusters (`candidates`).
3. In a cluster every two members are compared on their whole multisets; pairs of
   0.8 and more are links (`links`), and the connected nodes are a class.

Buckets and clusters of any size are compared in bounded parts, and what comes back is a
spanning forest, never all pairs. In a group of more than one block the first step is a
pivot: its members meet it block by block, which is one row a member, and those near it
are connected by that. Only members that are not near the pivot still have to meet others,
and, as both distances (the share of components that differ, and one less the weighted
Jaccard measure) obey the triangle inequality, only those whose distance from the pivot
is like theirs: members within the limit of the pivot that are closer to it than what
the nearest of the others leaves open take no further part. So a group of n near copies costs
n rows, however large it is; members far from the pivot are compared in pairs of blocks (`spanning`).

A pair at exactly 0.8 shares no band with a probability of 1.5e-5, and its
signature falls below the limit with one of about 1e-4; both shrink fast above 0.8.

Defined results
    null text: as the empty text. Documents without words are in a class only with
    documents of the very same text. Documents of fewer than five words have all
    their words as one shingle. A class id is the least doc_id of the class (null if
    all its ids are null); rows without id get the class of their text. Rows are told
    apart by a number of their own, so one id may have several texts, each with its
    class, and any number of rows may be without id. Repeated rows share a class.
    Empty table: empty result. Other columns, of any name, are carried along by
    `keep_one` and ignored otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.shared import components, dealt, materialise, spread_join, whole_groups

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 5
M = BANDS * ROWS
#: Signatures must agree in this share of the components: 0.8 less 4.5 deviations.
AGREE = SIMILARITY - 4.5 * (SIMILARITY * (1 - SIMILARITY) / M) ** 0.5
BUCKET_ROWS, CLUSTER_ROWS = 1024, 256
KNOWN_WORDS = 60_000
#: Up to so many members of clusters are sent to the texts (8 bytes each), so that no other text is shuffled to be verified.
SENT_MEMBERS = 1_000_000

_WORD = re.compile(r"\w+")
_TICKS, _NEVER = 2.0**40, np.iinfo(np.int64).max
_GOLDEN, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


_hashes = _Hashes()


def document(text: str | None) -> tuple[bytes, np.ndarray]:
    """A document's node (16 bytes) and the hashes of its shingles, repeats included."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return xxhash.xxh3_128_digest("\0" + (text or "")), np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _GOLDEN + w[k : len(w) - size + 1 + k]
    return xxhash.xxh3_128_digest(w.tobytes()), mix(h)


def elements(shingles: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the n-th repeat of a shingle is an element of its own."""
    s = np.sort(shingles)
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    at = np.arange(len(s))
    repeat = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.sort(np.where(repeat == 0, s, mix(s + repeat.astype(np.uint64) * _GOLDEN)))


def signatures(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """BagMinHash signatures (n, m): the earliest points' times.

    Times are whole multiples of 2**-40, so their sums are exact in any grouping and
    do not depend on what else is in a batch. ``hashes`` are the distinct shingles of document ``owner`` with integer ``weights``.
    """
    total = np.bincount(owner, weights, n)
    out = np.full((n, m), _NEVER)
    todo, slack = np.flatnonzero(total > 0), 2.0
    while len(todo):
        open_ = np.zeros(n, bool)
        open_[todo] = True
        of = open_[owner]
        limit = np.where(open_, m / np.maximum(total, 1) * (np.log(m) + slack) * _TICKS, 0).astype(np.int64)
        _run(hashes[of], weights[of].astype(np.int64), owner[of], limit, out)
        todo = todo[(out[todo] == _NEVER).any(axis=1)]
        slack *= 6
    out[total == 0] = 0
    return out.view(np.uint64)


def _run(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray, out: np.ndarray) -> None:
    """Run the processes of all shingles up to their documents' time limits."""
    m = out.shape[1]
    cell = 0
    while len(hashes):
        low = 0 if cell == 0 else 1 << (cell - 1)
        width = 1 if cell == 0 else low
        seed = mix(hashes + np.full(1, cell + 1, np.uint64) * _B)
        who, time, point = np.arange(len(hashes)), np.zeros(len(hashes), np.int64), 0
        while len(who):
            step = int(max(1, min(64, 200_000 // len(who))))
            u = mix(seed[who][:, None] + np.arange(point + 1, point + step + 1, dtype=np.uint64) * _GOLDEN)
            gap = (-np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) * (_TICKS / width)).astype(np.int64)
            t = time[:, None] + np.cumsum(gap, axis=1)
            r, c = np.nonzero(t <= limit[owner[who]][:, None])
            bits = mix(u[r, c] ^ _A)
            place = low + ((bits >> np.uint64(32)).astype(np.int64) * width >> 32)  # the leaf that the halvings lead to
            r, c, bits = (x[place < weights[who[r]]] for x in (r, c, bits))
            component = ((bits & np.uint64(0xFFFFFFFF)).astype(np.int64) * m) >> 32
            np.minimum.at(out, (owner[who[r]], component), t[r, c])
            on = t[:, -1] <= limit[owner[who]]
            who, time, point = who[on], t[on, -1], point + step
        cell += 1
        high = weights > (1 << (cell - 1))
        hashes, weights, owner = hashes[high], weights[high], owner[high]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the bands."""
    x = sig.reshape(len(sig), BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)[None, :] * _B + np.uint64(1)
    for k in range(ROWS):
        h = mix(h * _GOLDEN + x[:, :, k])
    return h.view(np.int64)


def short(sig: np.ndarray) -> np.ndarray:
    """16 bits of each component, to compare signatures with."""
    return (mix(sig) >> np.uint64(48)).astype(np.uint16)


#: What a sketch adds to a row. The row's own columns are called c0, c1, ... meanwhile.
SKETCH = "node binary, sig binary, bands array<bigint>"


def _sketcher(text: int):
    """Adds the columns of `SKETCH` to batches whose texts are in column ``text``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, size, begin = [], 0, 0
            for k, value in enumerate(batch.column(text)):
                docs.append(document(value.as_py()))
                size += len(docs[-1][1]) + 64
                if size > 200_000 or k == batch.num_rows - 1:
                    yield with_sketches(batch.slice(begin, len(docs)), docs)
                    docs, size, begin = [], 0, k + 1

    def with_sketches(batch: pa.RecordBatch, docs: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
        distinct = [np.unique(s, return_counts=True) for _, s in docs]
        owner = np.repeat(np.arange(len(docs)), [len(d[0]) for d in distinct])
        sig = signatures(np.concatenate([d[0] for d in distinct]), np.concatenate([d[1] for d in distinct]), owner, len(docs))
        bands = [b if len(d[0]) else [] for b, d in zip(band_keys(sig), distinct, strict=True)]
        made = [pa.array([k for k, _ in docs], pa.binary()), pa.array([r.tobytes() for r in short(sig)], pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "node", "sig", "bands"])

    return sketch


def sketches(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, columns renamed to c0, c1, ..., with `SKETCH` and a number ``row``.

    Written once: the numbers must not change, and the texts are read again from it.
    """
    carried = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join([*(f"{c} {t}" for c, (_, t) in zip(carried, docs.dtypes, strict=True)), SKETCH])
    made = docs.toDF(*carried).mapInArrow(_sketcher(docs.columns.index("text")), schema)
    return materialise(made.withColumn("row", F.monotonically_increasing_id()), "near-sketches")


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each connected part of ``n`` rows with links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: What is found about the members of a part: a link ``a, b``; or (``d`` not null) the distance of ``a`` from its group's pivot, and ``b`` if it is near.
FOUND = "a binary, b binary, grp {group}, d double, ref bigint"


def _found(table: pa.Table, rows: np.ndarray, others: np.ndarray, d: np.ndarray | None = None, near: np.ndarray | None = None) -> pa.RecordBatch:
    """``rows`` of ``table`` with ``others`` as `FOUND`; with distances ``d``, ``b`` is null where it is not ``near``."""
    take = lambda name, at: table[name].take(pa.array(at)).combine_chunks()
    b = pa.array(np.where(near, others, 0), pa.int64(), mask=~near) if near is not None else pa.array(others)
    distance = pa.array(d, pa.float64()) if d is not None else pa.nulls(len(rows), pa.float64())
    return pa.RecordBatch.from_arrays([take("node", rows), table["node"].take(b).combine_chunks(), take("grp", rows), distance, take("ref", rows)], names=["a", "b", "grp", "d", "ref"])


def _forest(table: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the linked rows of ``table``."""
    label = _labels(a, b, len(table))
    rows = np.flatnonzero(label != np.arange(len(table)))
    return _found(table, rows, label[rows])


def _compare(read: Callable, pairs: Callable, pivoted: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the members of each part: all pairs, or in parts with a ``pivot`` each member with it.

    ``read(table)`` gives the members' contents, ``pairs(contents, a, b)`` the links among
    members a to b, ``pivoted(contents, rows, pivots)`` distances and which are near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            g, pivot, contents = table["g"].to_numpy(), table["pivot"].to_numpy(zero_copy_only=False), read(table)
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            left, right, members, pivots = [], [], [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                at = np.flatnonzero(pivot[a:b])
                if len(at):
                    rows = np.flatnonzero(~pivot[a:b]) + a
                    members.append(rows)
                    pivots.append(np.full(len(rows), at[0] + a))
                else:
                    i, j = pairs(contents, a, b)
                    left.append(i)
                    right.append(j)
            if left:
                yield _forest(table, np.concatenate(left), np.concatenate(right))
            if members:
                rows, others = np.concatenate(members), np.concatenate(pivots)
                yield _found(table, rows, others, *pivoted(contents, rows, others))

    return run


def spanning(members: DataFrame, total: int, block_rows: int, radius: float, attach: Callable[[DataFrame], DataFrame], compare: Callable, label: str) -> DataFrame:
    """Links ``a, b`` that connect what all links within the groups of ``members(grp, node, ref)`` connect.

    ``total`` is at least the number of members; groups of one have no links. ``attach``
    adds the contents to parts ``(g, pivot, grp, node, ref)``, ``compare`` is a `_compare`; members are
    near if their distance is at most ``radius``.
    """
    schema = FOUND.format(group=dict(members.dtypes)["grp"])
    hashed = F.xxhash64("node")
    sizes = members.groupBy("grp").agg(F.count("*").alias("members"), F.min(hashed).alias("first")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / block_rows).cast("int"))
    rows = spread_join(members, "grp", sizes, "members", total)
    # Each member in its block's part; the pivot of a large group besides in all of its parts.
    own = F.array(F.struct(F.xxhash64("grp", F.pmod(hashed, F.col("blocks"))).alias("g"), F.lit(False).alias("pivot")))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.xxhash64("grp", b.cast("long")).alias("g"), F.lit(True).alias("pivot")))
    parts = rows.select("grp", "node", "ref", F.explode(F.when((F.col("blocks") > 1) & (hashed == F.col("first")), F.concat(own, every)).otherwise(own)).alias("p")).select("p.g", "p.pivot", "grp", "node", "ref")
    found = materialise(dealt(attach(parts), "g").mapInArrow(compare, schema), label)
    links = found.where("b is not null and a <> b").select("a", "b")
    far = found.where("d is not null and b is null")
    if far.isEmpty():
        return links
    # Members that are not near their pivot, and those near it that could be near one of them.
    lowest = found.where("d is not null").groupBy("grp").agg(F.count("*").alias("members"), F.min(F.when(F.col("b").isNull(), F.col("d"))).alias("lowest")).where("lowest is not null")
    rest = spread_join(found.where("d is not null"), "grp", lowest, "members", total).where(F.col("d") >= F.col("lowest") - radius - 1e-9)
    width = radius * (1 + 1e-9)
    rest = materialise(rest.select("grp", F.col("a").alias("node"), "ref", F.when(F.col("b").isNotNull(), 0).otherwise(1 + F.greatest(F.floor((F.col("d") - radius) / width), F.lit(0))).cast("int").alias("bin")), label)
    bins = rest.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    # At most as many bins as the radius goes into one.
    held = bins.groupBy("grp").agg(F.sum("n").alias("members"), F.map_from_entries(F.collect_list(F.struct("bin", F.ceil(F.col("n") / block_rows).cast("int")))).alias("blocks"))
    rows = spread_join(rest, "grp", held, "members", total)
    blocks = lambda k: F.coalesce(F.try_element_at("blocks", F.col("bin") + k), F.lit(0))
    block = F.pmod(F.xxhash64("node"), blocks(0))
    # In the same bin (but for those near the pivot), in the next one, in the one before.
    over = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), f)).otherwise(F.array().cast("array<bigint>"))
    same = over(F.when(F.col("bin") > 0, blocks(0)).otherwise(0), lambda o: F.xxhash64("grp", F.lit("same"), "bin", F.least(block, o.cast("long")), F.greatest(block, o.cast("long"))))
    up = over(blocks(1), lambda o: F.xxhash64("grp", F.lit("next"), "bin", block, o.cast("long")))
    down = over(F.when(F.col("bin") > 0, blocks(-1)).otherwise(0), lambda o: F.xxhash64("grp", F.lit("next"), F.col("bin") - 1, o.cast("long"), block))
    parts = rows.select(F.explode(F.array_distinct(F.concat(same, up, down))).alias("g"), F.lit(False).alias("pivot"), "grp", "node", "ref")
    more = dealt(attach(parts), "g").mapInArrow(compare, schema)
    return links.unionByName(more.where("b is not null").select("a", "b"))


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(table), M)


def _agreeing(sig: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    for k in range(a, b - 1):
        near = np.flatnonzero((sig[k + 1 : b] == sig[k]).mean(axis=1) >= AGREE) + k + 1
        left.append(np.full(len(near), k))
        right.append(near)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _signature_distances(sig: np.ndarray, rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    agree = np.concatenate([(sig[rows[k : k + 20_000]] == sig[pivots[k : k + 20_000]]).mean(axis=1) for k in range(0, len(rows), 20_000)]) if len(rows) else np.zeros(0)
    return 1 - agree, agree >= AGREE


def candidates(nodes: DataFrame, total: int) -> DataFrame:
    """``node, component``: clusters of the ``total`` rows ``nodes(node, sig, bands)`` that may hold links."""
    members = nodes.select(F.explode("bands").alias("grp"), "node", F.lit(0).cast("bigint").alias("ref"))
    attach = lambda parts: parts.join(nodes.select("node", "sig"), "node")
    return components(spanning(members, BANDS * total, BUCKET_ROWS, 1 - AGREE, attach, _compare(_signatures, _agreeing, _signature_distances), "near-agreeing"), "near-candidates")


def overlaps(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the incidence matrix."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = counts[inverse] > 1
    rows, columns = rows[keep], shared[inverse[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        a, b = np.searchsorted(columns, [at, at + width])
        x = np.zeros((len(sets), width), np.float32)
        x[rows[a:b], columns[a:b] - at] = 1
        out += x @ x.T
    return out


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in table["elements"].combine_chunks()]


def _linked(sets: list[np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    both, size = overlaps(sets[a:b]), np.array([len(s) for s in sets[a:b]], np.float64)
    i, j = np.nonzero(np.triu(both >= SIMILARITY * (size[:, None] + size - both) - 1e-6, 1))
    return i + a, j + a


def _set_distances(sets: list[np.ndarray], rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.array([len(np.intersect1d(sets[r], sets[p], assume_unique=True)) for r, p in zip(rows, pivots, strict=True)], np.float64)
    size = np.array([len(s) for s in sets], np.float64)
    either = size[rows] + size[pivots] - both
    return 1 - both / np.maximum(either, 1), both >= SIMILARITY * either - 1e-6


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (the first column) as their elements."""
    for batch in batches:
        sets = [elements(document(text.as_py())[1]).tobytes() for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], names=[*batch.schema.names[1:], "elements"])


def links(texts: DataFrame, clusters: DataFrame, total: int) -> DataFrame:
    """Verified links ``a, b`` that connect all that are linked inside the ``total`` rows ``clusters(node, cluster, row)``; ``texts(row, text)``."""
    if total <= SENT_MEMBERS:
        texts = texts.join(F.broadcast(clusters.select("row")), "row", "left_semi")

    def attach(parts: DataFrame) -> DataFrame:
        rows = parts.join(texts, F.col("ref") == F.col("row")).select("text", "g", "pivot", "grp", "node", "ref")
        return rows.mapInArrow(_contents, "g bigint, pivot boolean, grp binary, node binary, ref bigint, elements binary")

    members = clusters.select(F.col("cluster").alias("grp"), "node", F.col("row").alias("ref"))
    return spanning(members, total, CLUSTER_ROWS, 1 - SIMILARITY, attach, _compare(_sets, _linked, _set_distances), "near-compared")


def classed_nodes(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``node, n, class_node, best`` of the `sketches` ``rows``.

    ``n`` is the number of rows, ``class_node`` names the class, and ``best`` is the
    node's least ``doc_id`` (``id``, null last) with its first row (``row``).
    """
    best = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).cast("long").alias("id"), "row")
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min(best).alias("best"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "near-nodes")
    total = nodes.count()
    ids = nodes.select("node", "n", "best")
    found = materialise(candidates(nodes.select("node", "sig", "bands"), total), "near-clusters")
    clusters = found.withColumnRenamed("component", "cluster").join(ids, "node").select("node", "cluster", F.col("best.row").alias("row"))
    parts = components(links(rows.select("row", F.col(text).alias("text")), clusters, found.count()), "near-links")
    return ids.join(parts, "node", "left").select("node", "n", F.coalesce("component", "node").alias("class_node"), "best")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, members`` for every row of ``docs(doc_id, text)``; ``members`` is how many rows the class has."""
    rows = sketches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    nodes = materialise(classed_nodes(rows, "c0", "c1"), "near-classed")
    # Sums are made before the shuffle, and large classes and nodes are spread out.
    least = nodes.groupBy("class_node").agg(F.min("best").alias("least"), F.count("*").alias("nodes"), F.sum("n").alias("members"))
    counted = nodes.agg(F.count("*"), F.sum("n")).first()
    named = spread_join(nodes.drop("best"), "class_node", least, "nodes", counted[0]).select("node", "n", F.col("least.id").alias("class_id"), "members")
    named = materialise(named, "near-named")
    return spread_join(rows.select(F.col("c0").alias("doc_id"), "node"), "node", named, "n", counted[1] or 0, written=True).select("doc_id", "class_id", "members")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the first one of the class's least id (null last)."""
    columns = docs.columns
    rows = sketches(docs)
    nodes = classed_nodes(rows, f"c{columns.index('doc_id')}", f"c{columns.index('text')}")
    kept = nodes.groupBy("class_node").agg(F.min("best").alias("best")).select("best.row")
    return rows.join(kept, "row", "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
