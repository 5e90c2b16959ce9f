"""URL filter: per host a tree of path templates, judged by labelled purity.

Rules give the labels: a url that fits a rule takes the verdict of its longest
rule. All urls of a host form a tree of path segments. Level by level, segments
that are numbers become the wildcard ``*``; so do siblings whose labelled block
rates do not differ statistically from the rest of their node (two-proportion z
test). Others keep their names, however many they are; siblings without labels are
one branch ``?`` if their node has more than ``max_children``, which cannot change a
verdict. The branches that fell together are one template. A template blocks the
urls that no rule fits if its smoothed purity is over one half. Purity is smoothed
towards the node above, and so on up to the host: with ``W`` (`WEIGHT`) and, at the
host, ``P`` (`PRIOR`),

    node's purity     = (sum of the labelled segments' block rates + W * purity above) / (labelled segments + W)
    template's purity = (blocked + W * node's purity) / (labelled + W)

So labels reach siblings that have none: if two segments below a host are blocked, its
unlabelled urls are, too. One blocked segment alone does not decide over the others
(all numbers are one segment).

The levels go on until no path has a further segment. Past ``depth`` segments, the
rest of a node that is settled is one wildcard ``/**``: if the purity that comes from
above passes and nothing below is blocked, if it blocks and all labels below are blocks,
or if each url fits a rule. Purities below lie between the one above and the labels', so
``depth`` changes which templates are told apart and never a verdict.

All statistics are made on distinct (host, path) with counts, summed before
each shuffle; a hot host is a set of such rows, not a group in one task.

Defined results
    null url or no ``://``: host and path are empty, no rule fits, and the verdict
    is that of the empty host's only template (allow). Repeated rows count as often as they
    occur and each get a result. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm.shared import materialise, spread_join


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """``block example.com/de/`` as a rule."""
    verdict, _, place = line.strip().partition(" ")
    host, slash, rest = place.partition("/")
    return Rule(verdict, host, slash + rest)


RULES = tuple(map(parse_rule, ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")))
DEPTH, MAX_CHILDREN, Z = 3, 16, 1.96
#: Block rate expected of a host without labels, and how many branches that counts for.
PRIOR, WEIGHT = 0.25, 2
#: Purities this close to one half are one half (sums of fractions may differ in their last bits).
EXACT = 1e-9
#: Unlabelled siblings together; no segment of a path is so called.
UNLABELLED = "?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host (A-Z lower-cased) and the path; both empty without it."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as a struct ``rule, verdict``; null if none fits."""
    whens = reduce(
        lambda found, r: found.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))),
        sorted(rules, key=lambda r: (-len(r.text), r.text)),
        F,
    )
    return whens


def template_verdicts(paths: DataFrame, depth: int = DEPTH, max_children: int = MAX_CHILDREN, z: float = Z) -> DataFrame:
    """``paths(host, path, parts, n, m, k)`` (urls, labelled, blocked) with ``template, purity``.

    Nodes and branches with very many paths are spread out (`spread_join`).
    """
    tree = paths.withColumns({"template": F.lit(""), "q": F.lit(PRIOR), "shut": F.lit(False)})
    total, level, done = paths.count(), 0, []
    while True:
        ends = F.col("shut") | (F.size("parts") <= level)
        done.append(tree.where(ends))
        going = tree.where(~ends)
        if going.isEmpty():
            break
        level += 1
        going = going.withColumn("node", F.struct("host", "template")).withColumn("branch", F.struct("node", F.get("parts", level - 1).alias("seg")))
        kids = going.groupBy("branch").agg(F.first("q").alias("q"), F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("k").alias("k")).withColumn("node", F.col("branch.node"))
        kids = materialise(kids, "url-branches")
        nodes = kids.groupBy("node").agg(F.count("*").alias("kids"), F.first("q").alias("above"), F.sum("n").alias("nn"), F.sum("m").alias("nm"), F.sum("k").alias("nk"))
        m, k, rm, rk = F.col("m"), F.col("k"), F.col("nm") - F.col("m"), F.col("nk") - F.col("k")
        p, rest, pool = (k + 1) / (m + 2), (rk + 1) / (rm + 2), (F.col("nk") + 2) / (F.col("nm") + 4)
        same = (m > 0) & (rm > 0) & (F.abs(p - rest) < z * F.sqrt(pool * (1 - pool) * (1 / (m + 2) + 1 / (rm + 2))))
        name = F.when(F.col("branch.seg").rlike("^[0-9]+$") | same, F.lit("*")).when((m == 0) & (F.col("kids") > max_children), F.lit(UNLABELLED)).otherwise(F.col("branch.seg"))
        # Past ``depth`` a node ends as soon as all below it is on one side of one half, the purity from above included.
        blocks = F.col("above") > 0.5 + EXACT
        shut = F.lit(level > depth) & ((~blocks & (F.col("nk") == 0)) | (blocks & (F.col("nk") == F.col("nm"))) | (F.col("nm") == F.col("nn")))
        named = spread_join(kids, "node", nodes.withColumn("size", F.col("kids")), "size", total)
        kind = F.when(F.col("branch.seg").rlike("^[0-9]+$"), F.lit("*")).otherwise(F.col("branch.seg"))
        named = named.select("branch", "node", "rows", "kids", "above", "m", "k", kind.alias("kind"), F.when(shut, F.lit("**")).otherwise(name).alias("name"), shut.alias("ends"))
        named = materialise(named, "url-names")
        groups = named.groupBy("node", "kind").agg(F.first("kids").alias("kids"), F.first("above").alias("above"), F.sum("m").alias("m"), F.sum("k").alias("k"))
        rates = groups.groupBy("node").agg(F.first("kids").alias("kids"), F.first("above").alias("above"), F.count_if(F.col("m") > 0).alias("labelled"), F.sum(F.when(F.col("m") > 0, F.col("k") / F.col("m")).otherwise(0.0)).alias("rates"))
        rates = rates.select("node", "kids", ((F.col("rates") + WEIGHT * F.col("above")) / (F.col("labelled") + WEIGHT)).alias("next"))
        named = spread_join(named.select("branch", "node", "rows", "name", "ends"), "node", rates, "kids", total).select("branch", "rows", "name", "ends", "next")
        tree = spread_join(going.drop("node", "q", "shut"), "branch", named, "rows", total)
        tree = tree.withColumn("template", F.concat("template", F.lit("/"), "name")).withColumnRenamed("next", "q").withColumnRenamed("ends", "shut").drop("branch", "name")
        tree = materialise(tree.select("host", "path", "parts", "n", "m", "k", "template", "q", "shut"), "url-level")
    tree = materialise(reduce(DataFrame.unionByName, done).withColumn("node", F.struct("host", "template")), "url-tree")
    sums = tree.groupBy("node").agg(F.count("*").alias("rows"), ((F.sum("k") + WEIGHT * F.first("q")) / (F.sum("m") + WEIGHT)).alias("purity"))
    return spread_join(tree, "node", sums, "rows", total).drop("node", "q", "shut")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, depth: int = DEPTH, max_children: int = MAX_CHILDREN, z: float = Z) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages(page_id, url)``."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    found = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("found", found).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("given"))
    blocked = F.sum((F.col("given") == "block").cast("long"))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("given").alias("m"), F.coalesce(blocked, F.lit(0)).alias("k"))
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    paths = materialise(paths.withColumn("parts", F.when(F.col("path") != "", parts).otherwise(F.array().cast("array<string>"))), "url-paths")
    judged = template_verdicts(paths, depth, max_children, z).select(F.struct("host", "path").alias("place"), "n", "template", "purity")
    verdict = F.coalesce("given", F.when(F.col("purity") > 0.5 + EXACT, F.lit("block")).otherwise(F.lit("allow")))
    found = spread_join(rows.withColumn("place", F.struct("host", "path")), "place", judged, "n", pages.count())
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def _sql(rules: tuple[Rule, ...] = RULES, max_children: int = MAX_CHILDREN, z: float = Z) -> str:
    """The filter for DuckDB, on the rows themselves and to the last segment of every path."""
    by_length = sorted(rules, key=lambda r: (-len(r.text), r.text))
    case = lambda what: "case " + " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{getattr(r, what)}'" for r in by_length) + " end"
    return f"""with recursive cut as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
hp as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
r as (select *, {case("text")} as rule, {case("verdict")} as given, case when path = '' then [] else string_split(regexp_replace(path, '^/', ''), '/') end as parts from hp),
t(page_id, host, path, rule, given, parts, bad, q, template, level) as (
  select page_id, host, path, rule, given, parts, case given when 'block' then 1 when 'allow' then 0 end, {PRIOR}::double, '', 0 from r
  union all
  select page_id, host, path, rule, given, parts, bad, (coalesce(sum(case when mk > 0 then kk / mk / ck end) over w, 0) + {WEIGHT} * q) / (count(distinct case when mk > 0 then kind end) over w + {WEIGHT}), template || '/' ||
    case when kind = '*' or (m > 0 and nm - m > 0 and abs((k + 1) / (m + 2) - (nk - k + 1) / (nm - m + 2)) < {z} * sqrt((nk + 2) / (nm + 4) * (1 - (nk + 2) / (nm + 4)) * (1 / (m + 2) + 1 / (nm - m + 2)))) then '*' when m = 0 and kids > {max_children} then '{UNLABELLED}' else seg end, level + 1
  from (select *, count(bad) over b as m, coalesce(sum(bad) over b, 0) as k, count(bad) over w as nm, coalesce(sum(bad) over w, 0) as nk, count(distinct seg) over w as kids, count(bad) over g as mk, coalesce(sum(bad) over g, 0) as kk, count(*) over g as ck
    from (select *, parts[level + 1] as seg, case when regexp_matches(parts[level + 1], '^[0-9]+$') then '*' else parts[level + 1] end as kind from t where len(parts) > level)
    window w as (partition by host, template), b as (partition by host, template, seg), g as (partition by host, template, kind))
  window w as (partition by host, template)),
f as (select * from t where level = len(parts))
select page_id, host, path, rule, coalesce(given, case when (coalesce(sum(bad) over w, 0) + {WEIGHT} * q) / (count(bad) over w + {WEIGHT}) > {0.5 + EXACT} then 'block' else 'allow' end) as verdict
from f window w as (partition by host, template)"""


SQL = _sql()
