"""Repair of conversation structure by aligning turns with the grammar ``(s?(ua)+)?``.

A conversation's rows, ordered by turn, are edited until the first letters of their roles
spell a string of the grammar: nothing, or pairs of user and assistant, with one system
turn before them or without. Edits and what they cost:

    D  Delete a row (4); rows that are blank or repeat an earlier one have to go
    I  Insert an empty turn of user or assistant (3)
    K  Keep a row as it is (0)
    R  Rerole a row to user or assistant (3)

and 3 more for each truncated row that stays. Of the cheapest sequences of edits the one
whose letters come first in ASCII is the conversation's audit. A target of given length
is one string, so the audit tells each edit's role as well.

`align` is the Wagner-Fischer alignment of the rows with the target of each feasible
length. All targets end alike, so one table of costs of suffixes (rows that are left,
letters that are left) serves all lengths; targets with a system turn have a second one.
A greedy repair gives the incumbent cost. Cells from which the incumbent cannot be
reached any more, given what their rows cost at least, lie outside Ukkonen's band and are
not computed; the same bound leaves out lengths. Lengths are taken from the number of
live rows outwards, each cheaper one becoming the incumbent, and the audits of the
cheapest are traced back and compared.

Two shuffles by conversation: `audits` sends each row's first letter, marks and digest
(some dozens of bytes, no texts) and aligns; `walk` sends the rows with their texts behind
their conversation's audit, and reads both as a stream: no task holds a conversation's
texts. A table of more than `CELLS` cells is not kept: such a conversation (some ten
thousand rows) is aligned with the grammar's states in place of lengths, which needs a few
bytes a row and gives the same cost and audit.

Defined results
    null role and text: one space (`damaged`; such a row is blank). Null turns come first;
    gaps ignore them. Null conversation ids are one conversation. Rows of one turn: by the
    MD5 of role and text. Repeated rows: later ones are duplicates. An empty role has no
    letter and cannot be kept. Texts of any length are whole; empty texts are blank. Empty
    table: empty result. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm.shared import materialise

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Cells of a table of costs (4 bytes each) that are kept for tracing back.
CELLS = 1 << 24
_INF = 1 << 28

BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
AUDIT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPAIRED = "conv_id bigint, position bigint, edit string, role string, text string"
DIGEST = AUDIT + ", repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that the checksum of ``conv_id:turn`` names."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def mark(role: Column, text: Column) -> Column:
    """A digest of role and text; equal ones are repeats."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _suffix(row: tuple[int, np.ndarray], low: int, high: int) -> np.ndarray:
    """Cells ``low`` to ``high`` of a row of the table, infinite outside its band."""
    at, cells = row
    out = np.full(high - low + 1, _INF, np.int32)
    a, b = max(low, at), min(high, at + len(cells) - 1)
    if a <= b:
        out[a - low : b - low + 1] = cells[a - at : b - at + 1]
    return out


def greedy(codes: str) -> int:
    """What a repair made from left to right costs: the first incumbent."""
    cost = letters = system = 0
    for c in codes:
        more, c = TRUNCATED if c.isupper() else 0, c.lower()
        if c == "x":
            cost += DELETE
        elif c == "s" and not system and not letters:
            system, cost = 1, cost + more
        elif c in "ua":
            wrong = c != "ua"[letters % 2]
            letters, cost = letters + 1 + wrong, cost + more + wrong * INSERT
        else:
            letters, cost = letters + 1, cost + more + REROLE
    missing = 2 if system and not letters else letters % 2
    return cost + missing * INSERT


def align(codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation's rows.

    A row's code is ``x`` if it has to go, else its letter, ``-`` for any but ``s``, ``u``
    and ``a``, in upper case (``_`` for ``-``) if the row is truncated.
    """
    n, incumbent = len(codes), greedy(codes.replace("_", "Z"))
    lives = np.frombuffer(codes.encode(), np.uint8) != ord("x")
    extra = np.array([TRUNCATED if c.isupper() or c == "_" else 0 for c in codes], np.int64)
    ahead = lambda a: np.concatenate([np.cumsum(a[::-1])[::-1], [0]])  # noqa: E731  sums over the rows that are left
    live, cut_off, least = ahead(lives.astype(np.int64)), ahead(extra) // TRUNCATED, ahead(np.where(lives, extra, DELETE))
    # The incumbent leaves so much beyond the least cost; a truncated row's deletion adds 1 to it, another's 4.
    spare = incumbent - int(least[0])
    gone = np.where(spare <= cut_off, spare, cut_off + (spare - cut_off) // DELETE)
    low, high = np.maximum(0, live - gone), live + spare // INSERT
    if int((high - low + 1).sum()) > CELLS:
        return align_by_states(codes)
    low, high, count = low.tolist(), high.tolist(), np.arange(int(high.max()) + 1, dtype=np.int32)
    letters = codes.lower().replace("_", "-")
    table: list = [None] * n + [(0, INSERT * count[: high[n] + 1])]
    leading: list | None = [None] * n + [(0, np.full(high[n] + 1, _INF, np.int32))] if "s" in letters else None
    for i in range(n - 1, -1, -1):
        a, b, more = low[i], high[i], int(extra[i])
        cells = DELETE + _suffix(table[i + 1], a, b)
        q = count[a : b + 1]
        if lives[i]:
            c = letters[i]
            cells = np.minimum(cells, np.where(q & 1, more + (c != "a") * REROLE, more + (c != "u") * REROLE).astype(np.int32) + _suffix(table[i + 1], a - 1, b - 1))
        table[i] = a, np.minimum.accumulate(cells - INSERT * q) + INSERT * q
        if leading is not None:
            a = max(0, a - 1)
            cells = DELETE + _suffix(leading[i + 1], a, b)
            leading[i] = a, np.minimum(cells, more + _suffix(table[i + 1], a, b)) if lives[i] and letters[i] == "s" else cells

    def cost(length: int) -> int:
        return int(_suffix(table[0], length, length)[0] if length % 2 == 0 else _suffix(leading[0], length - 1, length - 1)[0])

    def bound(length: int) -> int:
        d, t = int(live[0]) - length, int(cut_off[0])
        return int(least[0]) + (-INSERT * d if d < 0 else min(d, t) + DELETE * max(0, d - t))

    best, cheapest = incumbent, []
    for length in sorted((k for k in range(low[0], high[0] + 1) if k % 2 == 0 or k > 1 and leading is not None), key=bound):
        if bound(length) > best:
            break
        if (c := cost(length)) <= best:
            cheapest = [*cheapest, length] if c == best else [length]
            best = c

    def trace(length: int) -> str:
        at = lambda rows, i, q: int(_suffix(rows[i], q, q)[0])
        i, q, system, out = 0, length - length % 2, length % 2, []
        while i < n or q:
            rows = leading if system else table
            now = at(rows, i, q)
            if i < n and DELETE + at(rows, i + 1, q) == now:
                i, edit = i + 1, "D"
            elif not system and q and INSERT + at(table, i, q - 1) == now:
                q, edit = q - 1, "I"
            elif system:
                i, system, edit = i + 1, 0, "K"
            else:
                edit = "K" if letters[i] == "ua"[q % 2] else "R"
                i, q = i + 1, q - 1
            out.append(edit)
        return "".join(out)

    return best, min(map(trace, cheapest))


def align_by_states(codes: str) -> tuple[int, str]:
    """The same with the grammar's states instead of lengths, in memory linear in the rows.

    Costs of the rows from ``i`` on if the next letter is user or none is left (0), is
    assistant (1), is the user of a first pair (2), or is the system turn (3).
    """
    n = len(codes)
    letters, extra = codes.lower().replace("_", "-"), lambda i: TRUNCATED if codes[i].isupper() or codes[i] == "_" else 0
    best = np.full((n + 1, 4), _INF, np.int64)
    best[n] = 0, INSERT, 2 * INSERT, _INF
    take = lambda i, c: _INF if letters[i] == "x" else extra(i) + (letters[i] != c) * REROLE
    for i in range(n - 1, -1, -1):
        end, mid, first, system = best[i + 1].tolist()
        zero, one = min(DELETE + end, take(i, "u") + mid), min(DELETE + mid, take(i, "a") + end)
        zero, one = min(zero, INSERT + one), min(one, INSERT + zero)
        pair = min(DELETE + first, INSERT + one, take(i, "u") + mid)
        kept = extra(i) + first if letters[i] == "s" else _INF
        best[i] = zero, one, pair, min(DELETE + system, kept)

    def trace(state: int) -> str:
        i, out = 0, []
        while i < n or state:
            now = best[i, state]
            after = (1, 0, 1, 2)[state]
            if i < n and DELETE + best[i + 1, state] == now:
                i, edit = i + 1, "D"
            elif state < 3 and INSERT + best[i, after] == now:
                state, edit = after, "I"
            else:
                edit = "K" if state == 3 or letters[i] == "uau"[state] else "R"
                i, state = i + 1, after
            out.append(edit)
        return "".join(out)

    cost = int(min(best[0, 0], best[0, 3]))
    return cost, min(trace(s) for s in (0, 3) if best[0, s] == cost)


class _Aligned(dict):
    """Alignments of short conversations, made when first asked for; bounded."""

    def __missing__(self, codes: str) -> tuple[int, str]:
        found = align(codes)
        if len(codes) <= 32 and len(self) < 50_000:
            self[codes] = found
        return found


_aligned = _Aligned()


class _Conversation:
    """What is known of a conversation's rows so far, in order."""

    def __init__(self, number: int | None):
        self.number, self.codes, self.turns = number, [], []
        self.seen: set[str] = set()
        self.counts, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.first = self.last = None
        self.distinct = 0

    def add(self, turn: int | None, letter: str, kind: int, digest: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        if self.before is not None and self.before + letter not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = letter
        fault = DUPLICATE if kind != BLANK and digest in self.seen else kind
        self.seen.add(digest)
        self.counts[fault] += 1
        self.codes.append("x" if fault in (BLANK, DUPLICATE) else {"-": "_"}.get(letter, letter.upper()) if fault == CUT_OFF else letter)

    def row(self) -> tuple:
        cost, audit = _aligned["".join(self.codes)]
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, (1 << 63) - 1)
        return self.number, gaps, *self.counts[1:], self.illegal, cost, audit


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in schema.split(", "))])


def _batches(rows: Iterator[tuple], schema: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` characters."""
    kind, held, size = _arrow(schema), [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        now = None
        for batch in batches:
            for number, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or number != now.number:
                    if now is not None:
                        yield now.row()
                    now = _Conversation(number)
                now.add(*rest)
        if now is not None:
            yield now.row()

    return _batches(rows(), AUDIT)


def audits(rows: DataFrame) -> DataFrame:
    """`AUDIT` for each conversation of ``rows(conv_id, turn, role, text)``."""
    first = F.substring("role", 1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_OFF).otherwise(0)
    slim = rows.select("conv_id", "turn", F.when(first.isin("s", "u", "a"), first).otherwise("-").alias("letter"), fault.alias("kind"), mark(F.col("role"), F.col("text")).alias("digest"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest").mapInArrow(_audited, AUDIT)


class _Edited:
    """A conversation that is rewritten row by row, as its audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.position = audit, 0, 0
        self.system = (len(audit) - audit.count("D")) % 2

    def _role(self) -> str:
        return ("user", "assistant")[(self.position - 1 - self.system) % 2]

    def inserted(self) -> Iterator[tuple[int, str, str, str]]:
        while self.audit.startswith("I", self.at):
            self.at, self.position = self.at + 1, self.position + 1
            yield self.position, "I", self._role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        """``position, edit, role, text`` of what comes of a row, turns inserted before it first."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.position += 1
            yield self.position, edit, self._role() if edit == "R" else role, text


def walk(rows: DataFrame, audited: DataFrame, digest: bool) -> DataFrame:
    """`REPAIRED`, the turns after repair, or (``digest``) `DIGEST`, the audits with a hash of all turns.

    A conversation's audit comes first (``head`` 0), its rows follow in the order of `audits`.
    """
    names = [c.split(" ")[0] for c in AUDIT.split(", ")[1:]]
    heads = audited.select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("digest"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text")], F.struct(*names).alias("audit"))
    marked = rows.select("conv_id", F.lit(1).alias("head"), F.col("turn").cast("bigint").alias("turn"), mark(F.col("role"), F.col("text")).alias("digest"), "role", "text", F.lit(None).cast(heads.schema["audit"].dataType).alias("audit"))
    both = heads.unionByName(marked).repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "digest").select("conv_id", "role", "text", "audit")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number = now = None
        for batch in batches:
            for conv_id, role, text, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is None:
                    for turn in now.row(role, text):
                        yield number, *turn
                    continue
                if now:
                    for turn in now.inserted():
                        yield number, *turn
                number, now = conv_id, _Edited(audit["audit"])
                yield conv_id, 0, None, None, audit
        if now:
            for turn in now.inserted():
                yield number, *turn

    def digests(found: Iterator[tuple]) -> Iterator[tuple]:
        head = sha = None
        for number, position, _, role, text in found:
            if not position:
                if head:
                    yield *head, sha.hexdigest()
                head, sha = (number, *(text[n] for n in names)), hashlib.sha256()
            else:
                sha.update(f"{chr(10) if position > 1 else ''}{role}:{text}".encode())
        if head:
            yield *head, sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = turns(batches)
        return _batches(digests(found), DIGEST) if digest else _batches((t for t in found if t[1]), REPAIRED)

    return both.mapInArrow(run, DIGEST if digest else REPAIRED)


def _filled(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))


def repair(rows: DataFrame) -> DataFrame:
    """`REPAIRED`: the turns of each conversation of ``rows(conv_id, turn, role, text)`` after repair, with the edit that each comes of."""
    rows = _filled(rows)
    return walk(rows, materialise(audits(rows), "conversation-audits"), False)


def audit(rows: DataFrame) -> DataFrame:
    """`DIGEST`: faults, cost, audit and the repaired turns' hash of each conversation."""
    rows = _filled(rows)
    return walk(rows, materialise(audits(rows), "conversation-audits"), True)


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """`DIGEST` of the `damaged` rows for every conversation; zeros where no row is left."""
    found = audit(damaged(conversations)).withColumnRenamed("conv_id", "found_id")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    columns = [F.coalesce(c, empty.get(c, F.lit(0).cast("bigint"))).alias(c) for c in found.columns if c != "found_id"]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select("conv_id", *columns)


def _sql() -> str:
    """The same for DuckDB: costs and audits of all suffixes and lengths, row by row from the end."""
    least = lambda items: f"list_sort({items})[1]"
    cell = lambda rows, q: f"{rows}[{q} + 1]"
    return rf"""with recursive crc_bits(i, k, v) as (select i, 0, i from range(256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from crc_bits where k < 8),
crc as (select list(v order by i) as t from crc_bits where k = 8),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: unicode(x)::bigint) as key from conversations),
hits as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, key), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as hit from keyed, crc),
damaged as (select conv_id, turn, case when hit = 4 then 'user' else role end as role, case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when hit = 3 then [0, 1] else [0] end) as copy from hits where hit <> 0),
marked as (select *, md5(strlen(role) || ':' || role || text) as mark from damaged),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, mark, copy) as i, row_number() over (partition by conv_id, mark order by turn nulls first, copy) as seen, left(role, 1) as letter, count(*) over (partition by conv_id) as n from marked),
judged as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when seen > 1 then 2 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 3 else 0 end as fault, lag(letter) over w || letter not in ('su', 'ua', 'au') as bad from placed window w as (partition by conv_id order by i)),
steps(conv_id, i, n, costs, headed) as (
  select distinct conv_id, n + 1, n, list_transform(range(0, 2 * n + 3), lambda q: {{'c': 3 * q, 'a': repeat('I', q)}}), list_transform(range(0, 2 * n + 3), lambda q: {{'c': 1000000::bigint, 'a': ''}}) from judged
  union all
  select conv_id, i, n, list_transform(range(0, 2 * n + 3), lambda q: {least("list_transform(range(0, q + 1), lambda k: {'c': " + cell("base", "q - k") + ".c + 3 * k, 'a': repeat('I', k) || " + cell("base", "q - k") + ".a})")}),
    list_transform(range(0, 2 * n + 3), lambda q: {least("[{'c': " + cell("headed", "q") + ".c + 4, 'a': 'D' || " + cell("headed", "q") + ".a}, {'c': case when live and letter = 's' then " + cell("costs", "q") + ".c + more else 1000000 end, 'a': 'K' || " + cell("costs", "q") + ".a}]")})
  from (select *, list_transform(range(0, 2 * n + 3), lambda q: {least("[{'c': " + cell("costs", "q") + ".c + 4, 'a': 'D' || " + cell("costs", "q") + ".a}, {'c': case when live and q > 0 then more + case when letter = case when q % 2 = 0 then 'u' else 'a' end then 0 else 3 end + " + cell("costs", "greatest(q, 1) - 1") + ".c else 1000000 end, 'a': case when letter = case when q % 2 = 0 then 'u' else 'a' end then 'K' else 'R' end || " + cell("costs", "greatest(q, 1) - 1") + ".a}]")}) as base
    from (select s.conv_id, j.i, s.n, s.costs, s.headed, j.letter, j.fault not in (1, 2) as live, case when j.fault = 3 then 3 else 0 end as more from steps s join judged j on s.conv_id is not distinct from j.conv_id and j.i = s.i - 1))),
best as (select conv_id, {least("list_transform(range(0, n + 2), lambda h: " + cell("costs", "2 * h") + ") || list_transform(range(1, n + 2), lambda h: " + cell("headed", "2 * h") + ")")} as b from steps where i = 1),
edits as (select conv_id, b.a as audit, unnest(range(1, length(b.a) + 1)) as p from best),
turns as (select conv_id, p, substr(audit, p, 1) as edit, length(replace(left(audit, p), 'I', '')) as i, length(replace(left(audit, p), 'D', '')) as pos, length(replace(audit, 'D', '')) % 2 as sys from edits),
texts as (select t.conv_id, string_agg(case when edit = 'K' then j.role else case when (pos - 1 - sys) % 2 = 0 then 'user' else 'assistant' end end || ':' || case when edit = 'I' then '' else j.text end, chr(10) order by p) as repaired
  from turns t left join judged j on t.conv_id is not distinct from j.conv_id and j.i = t.i where edit <> 'D' group by t.conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated, count(*) filter (where bad) as illegal from judged group by conv_id),
every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from every e left join counts c on e.conv_id is not distinct from c.conv_id left join best b on e.conv_id is not distinct from b.conv_id left join texts x on e.conv_id is not distinct from x.conv_id"""


SQL = _sql()
