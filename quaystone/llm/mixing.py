"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words (`source_targets`). A source with target
``T`` and size ``S`` gives ``floor(T / S)`` certain whole copies of each document; what
is left of the target is drawn as one more copy of some documents, with unequal
probabilities in proportion to their sizes, ``p = c * size``. ``c`` is set so that the
expected words are those left; documents with ``c * size >= 1`` are certain of their
copy, too. The others are a Pareto order sample: they are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with a random ``u`` drawn from the document's id.

The size of the sample is fixed in words, as the target is: the ranking is followed
until the words run out. Then it is followed further: documents too long for the words
still missing are passed over, until none that is left fits. What remains goes to the
single left-out document whose size is nearest to it, if that brings the source closer.

Whether a document is taken depends on its source, size and key alone, so the plan is
a few numbers per source and the short list of documents taken past the cut.

Defined results
    null text: size 0, nothing to take. Null source: a source of its own, last.
    Null ids draw one common random number. Rows that are tied (equal id, source and
    size), repeated rows among them, are taken or left together, each on its own count.
    Empty table: empty result. Other columns are carried along by `mixed_documents`
    and ignored otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.llm.shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of the ranking per doubling of the key, a power of two from 2 on; the part in which the
#: words run out is split by as many again until it has at most `EDGE_ROWS` rows. So the
#: ranking of a hot source is sums and one part of bounded size, never one task.
RANK_PARTS = 64
EDGE_ROWS = 4_096
#: Parts per doubling up to which keys still tell parts apart in double precision.
FINEST = 1 << 42
#: Rows per source are sent to all tasks up to so many; beyond, they are joined.
SENT_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_column: Column) -> Column:
    """A reproducible number in (0, 1): 52 bits of the id's MD5."""
    digest = F.md5(F.coalesce(id_column.cast("string"), F.lit("null")).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def sender(rows: int):
    """Marks tables of at most ``rows`` rows for broadcast, if that is within `SENT_ROWS`; else joins shuffle."""
    return F.broadcast if rows <= SENT_ROWS else lambda df: df


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def numbered(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``df`` with its place in ``order``, from 0: more than `SENT_ROWS` rows are sorted in ranges, which are counted and then numbered each."""
    if df.count() <= SENT_ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    df = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "mix-order")
    parts = df.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return df.withColumn(name, place).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Targets for ``sizes(source, source_size)``: ``source, source_size, target``.

    Sources in code-point order (null last) take the weights in turn. The words of
    all sources are shared out by weight; a target stops at ``cap`` times the
    source's size and the excess is shared again by weight among the others, until
    none is above. Each round is one sum over the sources that are still free.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    ranked = numbered(sizes, "turn", [F.col("source").asc_nulls_last()])
    ranked = materialise(ranked.withColumn("weight", weight.cast("long")).withColumn("most", (F.col("source_size") * cap).cast("decimal(38,0)")), "mix-sources")
    level, water = F.col("most").cast("double") / F.col("weight"), None
    while True:
        full = F.lit(False) if water is None else level < water
        total, taken, left, free = ranked.agg(F.sum(F.col("source_size").cast("decimal(38,0)")), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(~full)).first()
        share = float(total - (taken or 0)) / float(left) if free else float("inf")
        if water == share or not free:
            break
        water = share
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(share))
    return ranked.select("source", "source_size", target.alias("target"))


def inclusion(sized: DataFrame, targets: DataFrame, send) -> DataFrame:
    """Per source ``whole`` copies, the words ``rest`` to be drawn, the factor ``c`` and the size ``sure`` from which a document is certain.

    Sizes from the largest down are certain while the factor of the others would
    give them a probability of one; sums over distinct sizes decide.
    """
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(factor)).withColumn("some", factor > F.floor(factor))
    plan = plan.withColumn("words", F.when(F.col("some"), F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    plan = plan.drop("some")
    wide = lambda c: c.cast("decimal(38,0)")
    counts = sized.where("size > 0").groupBy("source", "size").agg(wide(F.count("*")).alias("n"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("above", F.coalesce(F.sum(F.col("n") * wide(F.col("size"))).over(before), wide(F.lit(0))))
    sums = sums.withColumn("squares", F.sum(F.col("n") * wide(F.col("size")) * wide(F.col("size"))).over(down.rowsBetween(0, Window.unboundedFollowing)))
    sums = sums.withColumnRenamed("source", "s_source").join(send(plan.select("source", "words")), same("s_source", "source")).where("words > 0")
    c = (F.col("words") - F.col("above").cast("double")) / F.col("squares").cast("double")
    first = sums.withColumn("c", c).where(F.col("c") * F.col("size") < 1).groupBy("s_source").agg(F.max(F.struct("size", "c", F.col("above").cast("double").alias("above"))).alias("first"))
    joined = plan.join(send(first), same("source", "s_source"), "left")
    return joined.select(
        "source", "source_size", "target", F.col("whole").cast("long").alias("whole"), F.col("first.c").alias("c"), F.when(F.col("first").isNotNull(), F.col("first.size") + 1).alias("sure"),
        F.greatest(F.col("words") - F.coalesce("first.above", F.lit(0.0)), F.lit(0.0)).alias("rest"),
    )


def keyed(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows(source, size, u, ...)`` with their source's ``bounds`` and the Pareto ``key`` (null: not in the ranking)."""
    rows = rows.join(bounds.withColumnRenamed("source", "b_source"), same("source", "b_source")).drop("b_source")
    p = F.col("c") * F.col("size")
    ranked = F.col("c").isNotNull() & (F.col("c") > 0) & (F.col("size") > 0) & (F.col("size") < F.col("sure"))
    return rows.withColumn("key", F.when(ranked, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))))


def first_words(left: DataFrame, gaps: DataFrame, send) -> DataFrame:
    """Of ``left(source, key, words)`` the front of each source's ranking that fits ``gaps(m_source, missing)``.

    Returns ``source, key, words`` and ``inside``: whole parts before the part in which
    the words run out are summed, and only that part is sorted. Parts are ranges of the
    key's logarithm; as they are split by powers of two, each lies in one of the level before.
    """
    part = lambda n: F.floor(F.log2("key") * n).cast("long").alias("part")
    parts = RANK_PARTS
    here = left.join(send(gaps), same("source", "m_source")).select("source", part(parts), "words", "missing", F.lit(0).cast("long").alias("before"))
    while True:
        sums = here.groupBy("source", "part").agg(F.sum("words").alias("w"), F.count("*").alias("n"), F.max("before").alias("before"), F.max("missing").alias("missing"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("w").over(Window.partitionBy("source").orderBy("part")))
        first = sums.where(F.col("upto") > F.col("missing")).groupBy("source").agg(F.min(F.struct("part", (F.col("upto") - F.col("w")).alias("before"), "missing", "n")).alias("edge"))
        edge = materialise(first.select(F.col("source").alias("e_source"), *[F.col(f"edge.{c}").alias(f"e_{c}") for c in ("part", "before", "missing", "n")]), "mix-edge")
        if parts >= FINEST or (edge.agg(F.max("e_n")).first()[0] or 0) <= EDGE_ROWS:
            break
        here = left.withColumn("part", part(parts)).join(send(edge), same("source", "e_source") & (F.col("part") == F.col("e_part")))
        parts *= RANK_PARTS
        here = here.select("source", part(parts), "words", F.col("e_missing").alias("missing"), F.col("e_before").alias("before"))
    placed = left.withColumn("part", part(parts)).join(send(edge), same("source", "e_source"), "left")
    at_edge = same("part", "e_part")
    rank = Window.partitionBy("source").orderBy("key")
    inside = placed.where(at_edge).withColumn("inside", F.col("e_before") + F.sum("words").over(rank) <= F.col("e_missing"))
    rest = placed.where(~at_edge).withColumn("inside", F.col("e_part").isNull() | (F.col("part") < F.col("e_part")))
    return inside.unionByName(rest).select("source", "key", "words", "inside")


def further(ranked: DataFrame, gaps: DataFrame, send) -> tuple[list[DataFrame], DataFrame]:
    """Follows the ranking past the cut: the groups taken, as tables ``source, key``, and the gaps that remain.

    A round takes what fits before the first group that does not; that one is longer
    than what is missing from then on, so it is never looked at again.
    """
    taken: list[DataFrame] = []
    left = ranked
    while True:
        left = left.join(send(gaps), same("source", "m_source")).where((F.col("words") <= F.col("missing")) & (F.col("key") > F.col("last"))).select("source", "key", "words")
        left = materialise(left, "mix-left")
        if left.isEmpty():
            return taken, gaps
        got = materialise(first_words(left, gaps.select("m_source", "missing"), send).where("inside").select("source", "key", "words"), "mix-further")
        gaps = materialise(after(gaps, got, send), "mix-gaps")
        taken.append(got.select("source", "key"))


def after(gaps: DataFrame, got: DataFrame, send) -> DataFrame:
    """``gaps(m_source, missing, last)`` once ``got(source, key, words)`` is taken."""
    sums = got.groupBy(F.col("source").alias("g_source")).agg(F.sum("words").alias("got"), F.max("key").alias("to"))
    return gaps.join(send(sums), same("m_source", "g_source"), "left").select("m_source", (F.col("missing") - F.coalesce("got", F.lit(0))).alias("missing"), F.coalesce("to", "last").alias("last"))


def plan(sized: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    """From ``sized(source, size, u)``, which is read several times: per source its bounds with the cut of the
    ranking (`keyed`, ``cut``, ``pick_key``, ``pick_size``), and the documents ``x_source, x_key`` taken past the cut.
    """
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    send = sender(targets.count())  # all tables of sources have at most as many rows
    bounds = materialise(inclusion(sized, targets, send), "mix-bounds")
    ranked = keyed(sized, send(bounds)).where("key is not null").groupBy("source", "key").agg(F.sum("size").alias("words"), F.max("size").alias("size"))
    ranked = materialise(ranked, "mix-ranked")  # a number or two per document
    gaps = bounds.where("c is not null").select(F.col("source").alias("m_source"), F.col("rest").alias("missing"), F.lit(0.0).alias("last"))
    front = materialise(first_words(ranked, gaps.select("m_source", "missing"), send).where("inside").groupBy("source").agg(F.sum("words").alias("words"), F.max("key").alias("key")), "mix-front")
    gaps = materialise(after(gaps, front, send), "mix-gaps")
    cut = front.select(F.col("source").alias("f_source"), F.col("key").alias("cut"))
    taken, gaps = further(ranked, gaps, send)
    # The document nearest to what is missing, of those left out.
    out = ranked.join(send(cut), same("source", "f_source"), "left").where(F.col("cut").isNull() | (F.col("key") > F.col("cut"))).select("source", "key", "size")
    extra = reduce(DataFrame.unionByName, taken).toDF("x_source", "x_key") if taken else ranked.limit(0).select(F.col("source").alias("x_source"), F.col("key").alias("x_key"))
    extra = materialise(extra, "mix-extra")
    out = out.join(sender(extra.count())(extra), same("source", "x_source") & (F.col("key") == F.col("x_key")), "left_anti")
    miss = F.abs(F.col("missing") - F.col("size"))
    pick = (
        out.join(send(gaps.drop("last")), same("source", "m_source")).where(miss < F.col("missing"))
        .groupBy(F.col("source").alias("p_source")).agg(F.min(F.struct(miss.alias("miss"), "key")).alias("pick")).select("p_source", F.col("pick.key").alias("pick"))
    )
    bounds = bounds.join(send(cut), same("source", "f_source"), "left").join(send(pick), same("source", "p_source"), "left").drop("f_source", "p_source")
    return materialise(bounds, "mix-plan"), extra


def decided(rows: DataFrame, bounds: DataFrame, extra: DataFrame) -> DataFrame:
    """``rows(source, size, u, ...)`` with ``source_size, target, copies`` by a `plan`."""
    rows = keyed(rows, sender(bounds.count())(bounds)).join(sender(extra.count())(extra), same("source", "x_source") & (F.col("key") == F.col("x_key")), "left")
    once = (F.col("size") >= F.col("sure")) | (F.col("key") <= F.col("cut")) | F.col("x_key").isNotNull() | (F.col("key") == F.col("pick"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(once, 1).otherwise(0)).otherwise(0)
    return rows.withColumn("copies", copies.cast("int")).drop("whole", "c", "sure", "rest", "cut", "pick", "key", "x_source", "x_key")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``size`` and ``u``, and the source as ``source``."""
    return docs.withColumns({"source": F.col(source), "size": word_count(F.col(text)), "u": uniform(F.col(doc_id))})


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Per row of ``docs(doc_id, text, source)``: ``doc_id, size, source_size, target, copies, taken``.

    ``copies`` is how often the mix takes the document (0 to ``cap``) and ``taken``
    the words of these copies.
    """
    sized = materialise(measured(docs.select("doc_id", "text", "source")).drop("text"), "mix-sizes")
    done = decided(sized, *plan(sized, weights, cap))
    return done.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The rows of ``docs`` the mix takes, each as often as it takes them; the texts stay where they are."""
    columns = docs.columns
    carried = [f"c{i}" for i in range(len(columns))]
    rows = measured(docs.toDF(*carried), *(carried[columns.index(c)] for c in ("doc_id", "text", "source")))
    sized = materialise(rows.select("source", "size", "u"), "mix-sizes")
    done = decided(rows, *plan(sized, weights, cap)).where("copies > 0")
    taken = done.select(*carried, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*[F.col(k).alias(c) for k, c in zip(carried, columns, strict=True)])


#: The same mix for DuckDB, without the ranking in parts.
SQL = r"""
with recursive sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         (cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 13)) as bigint)::double + 0.5) / 4503599627370496.0 as u
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) - 1 as turn
  from sized group by source),
weighed as (
  select *, case turn % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 3 as most,
         (source_size * 3)::double / case turn % 3 when 0 then 5 when 1 then 2 else 1 end as level
  from sources),
shared as (
  select *, (sum(source_size) over () - coalesce(sum(most) over (order by level, turn rows between unbounded preceding and 1 preceding), 0))::double
         / (sum(weight) over () - coalesce(sum(weight) over (order by level, turn rows between unbounded preceding and 1 preceding), 0))::double as share
  from weighed),
water as (select arg_min(share, row(level, turn)) as w from shared where level >= share),
targets as (
  select source, source_size, least(most::double, weight * coalesce(w, 'infinity'::double)) as target,
         case when source_size > 0 then least(most::double, weight * coalesce(w, 'infinity'::double)) / source_size else 0 end as f
  from shared, water),
whole as (
  select *, floor(f)::bigint as whole, case when f > floor(f) then target - floor(f) * source_size else 0 end as words from targets),
counts as (select source, size, count(*)::hugeint as n from sized where size > 0 group by all),
sums as (
  select *, coalesce(sum(n * size) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0)::double as above,
         (sum(n * size * size) over (partition by source order by size desc rows between current row and unbounded following))::double as squares
  from counts),
firsts as (
  select w.source, max(size) as size, arg_max((words - above) / squares, size) as c, arg_max(above, size) as above
  from sums s join whole w on s.source is not distinct from w.source where words > 0 and (words - above) / squares * size < 1 group by w.source),
bounds as (
  select w.*, c, size + 1 as sure, greatest(words - coalesce(above, 0), 0) as rest from whole w left join firsts f on w.source is not distinct from f.source),
keyed as (
  select d.*, b.source_size, b.target, b.whole, b.rest, d.size >= b.sure as certain,
         case when c > 0 and size > 0 and size < sure then (u / (1 - u)) / (c * size / (1 - c * size)) end as key
  from sized d join bounds b on d.source is not distinct from b.source),
ranked as (select source, key, sum(size) as words, max(size) as size, any_value(rest) as rest from keyed where key is not null group by source, key),
walk as (
  select 0 as step, source, key, words, rest as missing, false as got from ranked
  union all
  select step + 1, source, key, words, missing - coalesce(sum(case when fits then words end) over (partition by source), 0), fits
  from (select *, sum(words) over (partition by source order by key) <= missing as fits from walk where not got and words <= missing)),
taken as (select source, key from walk where got),
gaps as (
  select r.source, any_value(rest) - coalesce(sum(case when t.key is not null then words end), 0) as missing
  from ranked r left join taken t on r.source is not distinct from t.source and r.key = t.key group by r.source),
pick as (
  select r.source, arg_min(r.key, row(abs(missing - size), r.key)) as key
  from ranked r join gaps g on r.source is not distinct from g.source left join taken t on r.source is not distinct from t.source and r.key = t.key
  where t.key is null and abs(missing - size) < missing group by r.source)
select doc_id, size, source_size, target,
       case when size = 0 then 0 else size * (whole + case when certain or t.key is not null or p.key is not null then 1 else 0 end) end as taken
from keyed k left join taken t on k.source is not distinct from t.source and k.key = t.key
left join pick p on k.source is not distinct from p.source and k.key = p.key
"""
