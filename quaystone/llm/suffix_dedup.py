"""Removal of long passages that occur more than once, with a difference cover.

Texts are strings of symbols: their bytes, or (``by_words``) their words, runs without
ASCII white space. A start is repeated if the ``length`` symbols from it also start
anywhere else; every symbol covered by such a string goes, and with words the white
space between them. What follows speaks of bytes; with words all is counted in words.

The difference cover makes this affordable. Positions whose offset modulo ``v`` lies
in the cover are sampled (about one in eleven); for any two starts there is a shift
below ``v`` that takes both to sampled positions. So equal strings of ``length``
bytes hold equal sampled tuples of ``length - v + 1`` bytes at one shift.

1. Sampled tuples are named by fingerprints and sorted in ranges of names; equal
   neighbours are tuples that occur again (`SampledNames`).
2. Only starts that reach such a tuple within ``v`` bytes can be repeated. They are
   the suffixes to be merged: named by their whole prefix of ``length`` bytes, sorted
   in ranges again, and compared with their neighbours (`PrefixNames`).
3. The repeated starts go back to their texts, which are cut.

As matches end after ``length`` bytes, one round of names takes the place of the full
recursion to ranks, and the order between different names is of no use.

Texts are dealt out in units of a few megabytes by hash; one shuffle of the texts
serves all three steps. Names travel as sorted arrays per unit and range, distinct
within the unit, so a passage that everyone shares is one number per unit; they are
written as differences by byte planes (`pack`), whose high bytes compress away. Exact
copies of a document are found in step 1 by a fingerprint of the whole text, and only
one of them goes through step 2. Fingerprints have 64 bits (names of step 1, which
only preselect, 32 within their range). Bytes and words can be asked for at once
(``passages`` of `cut`): both forms go through the same steps on the same shuffle.

Defined results
    null text: as the empty text, nothing to remove. Texts shorter than ``length``
    stay whole. White space at the ends of a removed run of words stays. Repeated rows
    are copies: both are removed if long enough. Empty table: empty result. All columns are carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 400
#: Passages of at least so many words are repeats where texts are strings of words.
PASSAGE_WORDS = 50
UNIT_BYTES = 3 << 20
#: Bytes of texts for each partition of units, where the session's number of partitions would make larger ones.
PART_BYTES = 128 << 20
#: Bytes of input for each range of names; a range's names are sorted in one task.
NAME_RANGE, PREFIX_RANGE = 24 << 20, 4 << 20
#: The same for prefixes of words, of which there are fewer.
WORD_PREFIX_RANGE = 16 << 20

#: Kinds of names of the first form; those of the second come after them.
DOCUMENTS, SAMPLES, PREFIXES, KINDS = 0, 1, 2, 3
ASKED = "kind int, part int, unit int, names binary"
TOLD = "unit int, kind int, part int, again binary, first binary"


@lru_cache(4)
def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """``v`` and a difference cover modulo ``v`` for strings of ``length`` bytes (Colbourn and Ling's form)."""
    r = -1
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= (length + 1) // 2:
        r += 1
    if r < 0:
        return 1, np.zeros(1, np.int64)
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)])


_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    t = np.full(n, base, np.uint64)
    t[0] = 1
    return np.cumprod(t, out=t)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(names: np.ndarray, parts: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def pack(names: np.ndarray) -> bytes:
    """Sorted numbers as their differences: all lowest bytes, then all next ones."""
    return np.diff(names, prepend=names.dtype.type(0)).view(np.uint8).reshape(-1, names.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Rolling:
    """Fingerprints of all substrings of an array of numbers.

    Making it holds two numbers a value beside ``values``, which are the largest arrays of a task.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        terms = powers(_BASE, n + 1)
        terms[:-1] *= values
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms[:-1], out=self.sums[1:])
        del terms, values
        self.down = powers(pow(_BASE, -1, 1 << 64), n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def words_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of texts that lie one after the other, ``cuts`` being their starts and the end."""
    inside = np.concatenate([~_BLANK[data], [False]])
    before = np.concatenate([[False], inside[:-1]])
    before[cuts] = False  # a word ends with its text
    begin = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[cuts[1:] - 1] = False
    return begin, np.flatnonzero(inside & ~after) + 1


class Unit:
    """The distinct texts of a unit that are long enough, as one string of symbols with rolling fingerprints.

    ``starts`` are where texts start among the symbols; symbol ``i`` is the bytes from
    ``begin[i]`` to ``end[i]`` of its text (both None where symbols are bytes).
    """

    def __init__(self, texts: list[bytes], length: int, by_words: bool = False):
        self.length, (self.v, self.cover) = length, difference_cover(length)
        found: dict[bytes, int] = {}
        self.copies: list[int] = []
        self.of_row = []
        docs = []
        for t in texts:
            if len(t) < length:
                self.of_row.append(-1)
                continue
            k = found.setdefault(xxhash.xxh3_128_digest(t), len(docs))
            if k == len(docs):
                docs.append(t)
                self.copies.append(0)
            self.copies[k] += 1
            self.of_row.append(k)
        self.starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        data = np.frombuffer(b"".join(docs), np.uint8)
        self.begin = self.end = None
        self.symbols = Rolling(_LETTERS[data])
        if by_words:
            begin, end = words_of(data, self.starts)
            self.symbols = Rolling(self.symbols.of(begin, end) | np.uint64(1))
            of = np.searchsorted(self.starts, begin, "right") - 1
            self.begin, self.end = begin - self.starts[of], end - self.starts[of]
            self.starts = np.searchsorted(begin, self.starts)
        enough = np.diff(self.starts) >= length
        self.of_row = [k if k >= 0 and enough[k] else -1 for k in self.of_row]
        self.whole = np.array([xxhash.xxh3_64_intdigest(d) for d in docs], np.uint64)

    def names(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.symbols.of(at, at + size)

    def sampled(self) -> np.ndarray:
        """All positions of the cover that hold a whole tuple."""
        size = self.length - self.v + 1
        longest = int(np.diff(self.starts).max(initial=0))
        grid = (np.arange(longest // self.v + 1)[:, None] * self.v + self.cover).ravel()
        parts = [grid[: np.searchsorted(grid, b - a - size, "right")] + a for a, b in zip(self.starts, self.starts[1:], strict=False)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def reaching(self, sampled: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """The starts from which one of the ``sampled`` positions lies within ``v`` bytes, outside texts to ``skip``."""
        doc = np.searchsorted(self.starts, sampled, "right") - 1
        low = np.maximum(sampled - self.v + 1, self.starts[doc])
        high = np.minimum(sampled, self.starts[doc + 1] - self.length)
        good = (low <= high) & ~skip[doc]
        n = len(self.symbols.sums)
        return np.flatnonzero(np.cumsum(np.bincount(low[good], minlength=n) - np.bincount(high[good] + 1, minlength=n + 1)[:n]) > 0)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which bytes lie in a string of ``length`` bytes from one of the ``starts``."""
        n = len(self.symbols.sums)
        return np.cumsum(np.bincount(starts, minlength=n) - np.bincount(starts + self.length, minlength=n)[:n])[:-1] > 0


class Asked:
    """Distinct names of one kind in a unit, in ranges, and what is told about them."""

    def __init__(self, kind: int, names: np.ndarray, parts: int):
        self.kind, part = kind, ranges(names, parts)
        self.short = kind % KINDS == SAMPLES
        keys = (part << np.uint64(32)) | (names & np.uint64(0xFFFFFFFF)) if self.short else names
        self.keys, self.inverse, self.counts = np.unique(keys, return_inverse=True, return_counts=True)
        part = self.keys >> np.uint64(32) if self.short else ranges(self.keys, parts)
        self.cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))

    def rows(self, unit: int) -> Iterator[tuple[int, int, int, bytes]]:
        """Without the kind's bits that the range implies."""
        sent = self.keys.astype(np.uint32) if self.short else self.keys
        for p in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield self.kind, p, unit, pack(sent[self.cuts[p] : self.cuts[p + 1]])

    def told(self, replies: list[dict], field: str) -> np.ndarray:
        """The bits told about each distinct name."""
        out = np.zeros(len(self.keys), bool)
        for r in replies:
            if r["kind"] == self.kind:
                a, b = self.cuts[r["part"]], self.cuts[r["part"] + 1]
                out[a:b] = np.unpackbits(np.frombuffer(r[field], np.uint8), count=int(b - a)).astype(bool)
        return out


def compare(asked: pa.Table) -> pa.Table:
    """For the names of one range: which occur in several units, and which unit is their first."""
    schema = pa.schema([("unit", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("again", pa.binary()), ("first", pa.binary())])
    asked = asked.sort_by("unit")
    kind = asked["kind"][0].as_py()
    arrays = [unpack(b, np.uint32 if kind % KINDS == SAMPLES else np.uint64) for b in asked["names"].to_pylist()]
    _, index, inverse, counts = np.unique(np.concatenate(arrays), return_index=True, return_inverse=True, return_counts=True)
    again, first = counts[inverse] > 1, np.zeros(len(inverse), bool)
    first[index] = True
    cuts = np.cumsum([len(a) for a in arrays])[:-1]
    rows = [
        (u, kind, p, np.packbits(x).tobytes(), np.packbits(y).tobytes() if kind % KINDS == DOCUMENTS else b"")
        for u, p, x, y in zip(asked["unit"].to_pylist(), asked["part"].to_pylist(), np.split(again, cuts), np.split(first, cuts), strict=True)
        if x.any()
    ]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


class SampledNames:
    """Step 1 in a unit: names of whole texts and of sampled tuples."""

    def __init__(self, unit: Unit, parts: int, kinds: int = 0):
        self.unit, self.at = unit, unit.sampled()
        self.whole = Asked(kinds + DOCUMENTS, mix(unit.whole), parts)
        self.tuples = Asked(kinds + SAMPLES, unit.names(self.at, unit.length - unit.v + 1), parts)

    def verdict(self, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Which texts have copies, and the starts that step 2 has to look at."""
        again = self.whole.told(replies, "again")
        away = again & ~self.whole.told(replies, "first")  # another unit's copy takes part
        copied = again[self.whole.inverse] | (np.array(self.unit.copies, int) > 1)
        alive = (self.tuples.told(replies, "again") | (self.tuples.counts > 1))[self.tuples.inverse]
        return copied, self.unit.reaching(self.at[alive], away[self.whole.inverse])


class PrefixNames:
    """Step 2 in a unit: names of whole prefixes of the starts in question."""

    def __init__(self, unit: Unit, starts: np.ndarray, parts: int, kinds: int = 0):
        self.starts = starts
        self.asked = Asked(kinds + PREFIXES, unit.names(starts, unit.length), parts)

    def repeated(self, replies: list[dict]) -> np.ndarray:
        return self.starts[(self.asked.told(replies, "again") | (self.asked.counts > 1))[self.asked.inverse]]


def _texts(table: pa.Table, column: str) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in table[column].combine_chunks().cast(pa.binary())] if len(table) else []


def _asked_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("unit", pa.int32()), ("names", pa.binary())])
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


class Form:
    """The steps in a unit for strings of ``length`` bytes or words; what a step holds ends with it."""

    def __init__(self, total: int, length: int, by_words: bool, kinds: int):
        self.length, self.by_words, self.kinds = length, by_words, kinds
        self.name_parts, self.prefix_parts = max(1, -(-total // NAME_RANGE)), max(1, -(-total // (WORD_PREFIX_RANGE if by_words else PREFIX_RANGE)))

    def first(self, texts: list[bytes], number: int) -> list[tuple[int, int, int, bytes]]:
        step = SampledNames(Unit(texts, self.length, self.by_words), self.name_parts, self.kinds)
        return [r for asked in (step.whole, step.tuples) for r in asked.rows(number)]

    def second(self, texts: list[bytes], told: list[dict], number: int) -> list[tuple[int, int, int, bytes]]:
        unit = Unit(texts, self.length, self.by_words)
        _, starts = SampledNames(unit, self.name_parts, self.kinds).verdict(told)
        return list(PrefixNames(unit, starts, self.prefix_parts, self.kinds).asked.rows(number))

    def third(self, texts: list[bytes], told: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
        """Begins and ends of each text's removed runs, and what is left of it."""
        unit = Unit(texts, self.length, self.by_words)
        copied, starts = SampledNames(unit, self.name_parts, self.kinds).verdict(told)
        gone = unit.covered(PrefixNames(unit, starts, self.prefix_parts, self.kinds).repeated(told))
        for k, data in zip(unit.of_row, texts, strict=True):
            begin = end = np.zeros(0, np.int64)
            if k >= 0:
                a, b = unit.starts[k], unit.starts[k + 1]
                mask = np.ones(b - a, bool) if copied[k] else gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
                begin, end = edges[::2], edges[1::2]
                if self.by_words:
                    begin, end = unit.begin[a + begin], unit.end[a + end - 1]
            yield begin, end, b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True))


def cut(docs: DataFrame, length: int = LENGTH, text_column: str = "text", unit_bytes: int = UNIT_BYTES, as_text: bool = False, result: str = "cut", by_words: bool = False, passages: int = 0) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_bytes, removed, kept`` as a struct ``result``.

    ``length`` is in bytes, or in words if ``by_words``. ``removed`` are the maximal
    runs of removed bytes as (begin, end), ``kept`` the bytes that stay (``as_text``:
    as a string, without what is no whole character). The struct's column is put last.
    With ``passages`` a second struct, ``result`` and ``_passages``, follows: the same with
    strings of so many words, judged on the input and not on what the first leaves, as text.
    """
    total = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    units = max(1, -(-total // unit_bytes))
    forms = [Form(total, n, w, k * KINDS) for k, (n, w) in enumerate([(length, by_words), (passages, True)][: 2 if passages else 1])]
    strings = [as_text, True]
    columns, at = docs.columns, docs.columns.index(text_column)
    carried = [f"c{i}" for i in range(len(columns))]
    text = carried[at]
    parts = max(-(-total // PART_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.toDF(*carried).withColumn("unit", F.pmod(F.xxhash64(*[c for c in carried if dict(zip(carried, [t for _, t in docs.dtypes], strict=True))[c] in ("bigint", "int", "string")]), F.lit(units)).cast("int"))
    rows = rows.repartition(parts, "unit")  # the one shuffle of the texts

    def first(table: pa.Table) -> pa.Table:
        texts, number = _texts(table, text), table["unit"][0].as_py()
        return _asked_table([r for form in forms for r in form.first(texts, number)])

    def second(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts, told = _texts(table, text), replies.to_pylist()
        number = table["unit"][0].as_py() if len(table) else -1
        return _asked_table([r for form in forms for r in form.second(texts, told, number)])

    def third(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts, told = _texts(table, text), replies.to_pylist()
        table = table.select([*carried]).append_column("n_bytes", pa.array([len(t) for t in texts], pa.int64()))
        longs = pa.list_(pa.int64())
        for k, (form, string) in enumerate(zip(forms, strings, strict=False)):
            begins, ends, kept = [], [], []
            for begin, end, left in form.third(texts, told):
                begins.append(begin)
                ends.append(end)
                kept.append(left.decode(errors="ignore") if string else left)
            for name, values, kind in ((f"begins{k}", begins, longs), (f"ends{k}", ends, longs), (f"kept{k}", kept, pa.string() if string else pa.binary())):
                table = table.append_column(name, pa.array(values, kind))
        return table

    asked = rows.groupBy("unit").applyInArrow(first, ASKED)
    told = asked.groupBy("kind", "part").applyInArrow(compare, TOLD)
    asked = rows.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(second, ASKED)
    told = told.unionByName(asked.groupBy("kind", "part").applyInArrow(compare, TOLD))
    out = [*(f"{c} {t}" for c, (_, t) in zip(carried, docs.dtypes, strict=True)), "n_bytes bigint"]
    out += [f"begins{k} array<bigint>, ends{k} array<bigint>, kept{k} {'string' if strings[k] else 'binary'}" for k in range(len(forms))]
    done = rows.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(third, ", ".join(out))
    removed = lambda k: F.zip_with(f"begins{k}", f"ends{k}", lambda a, b: F.struct(a.alias("begin"), b.alias("end"))).alias("removed")
    structs = [F.struct("n_bytes", removed(k), F.col(f"kept{k}").alias("kept")).alias(name) for k, name in zip(range(len(forms)), (result, f"{result}_passages"), strict=False)]
    return done.select(*[F.col(c).alias(name) for c, name in zip(carried, columns, strict=True)], *structs)


def remove_repeats(docs: DataFrame, length: int = PASSAGE_WORDS, by_words: bool = True) -> DataFrame:
    """``docs`` with repeated passages of ``length`` words (or bytes) and more taken out of ``text``.

    Where symbols are bytes, parts of a character that are left at an edge are dropped.
    ``n_chars``, where it is a column, is that of the new text.
    """
    name = "cut"
    while name in docs.columns:
        name += "_"
    new = F.col(f"{name}.kept")
    changed = {"text": F.when(F.col("text").isNotNull(), new)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return cut(docs, length, as_text=True, result=name, by_words=by_words).select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, str]]:
    """``n_removed, n_spans, sha256 of what is kept`` for a few small texts."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        out.append((sum(mask), len([s for s in bytes(mask).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    return out


def brute_force_words(texts: list[bytes], length: int) -> list[bytes]:
    """What is kept of a few small texts whose symbols are words."""
    words = [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    strings = [[tuple(w for _, _, w in found[i : i + length]) for i in range(len(found) - length + 1)] for found in words]
    seen = Counter(chain.from_iterable(strings))
    out = []
    for t, found, own in zip(texts, words, strings, strict=True):
        gone = {k for i, string in enumerate(own) if seen[string] > 1 for k in range(i, i + length)}
        left, at = [], 0
        for k, (a, b, _) in enumerate(found):
            if k in gone:
                if k - 1 not in gone:
                    left.append(t[at:a])
                at = b
        out.append(b"".join([*left, t[at:]]))
    return out
