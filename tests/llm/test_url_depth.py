"""Verdicts of the url filter do not depend on how deep templates are told apart, and equal the SQL at every depth."""

import random

import duckdb
import pytest

from quaystone.llm import url_filter


def judged(spark, urls, rules, depth):
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules, depth).collect())


def by_sql(urls, rules):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [*enumerate(urls)])
    return sorted(con.execute(url_filter._sql(rules)).fetchall())


def rules_of(*lines):
    return tuple(map(url_filter.parse_rule, lines))


def test_purity_from_above_decides_at_every_depth(spark):
    """Eight blocked siblings block what lies below an allowed one's unlabelled part, too."""
    rules = rules_of(*(f"block h.com/a/b/x{i}/" for i in range(8)), "allow h.com/a/b/c/ok/")
    urls = [*(f"http://h.com/a/b/x{i}/p{k}" for i in range(8) for k in range(2)), "http://h.com/a/b/c/ok/1", "http://h.com/a/b/c/new", "http://h.com/a/b/c/new/deeper/still/9"]
    want = by_sql(urls, rules)
    assert [w[4] for w in want[-2:]] == ["block", "block"]
    for depth in (0, 3, 6):
        assert judged(spark, urls, rules, depth) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees_equal_sql(spark, seed):
    rng = random.Random(seed)
    part = lambda: rng.choice(["a", "b", "c", "new", "12", "7", "x"])
    urls = [f"http://{rng.choice(['h.com', 'i.org', 'j.net'])}/" + "/".join(part() for _ in range(rng.randint(0, 5))) for _ in range(300)] + [None, "://", "http://h.com"]
    rules = rules_of(*{f"{rng.choice(['block', 'block', 'allow'])} {rng.choice(['h.com', 'i.org'])}/" + "/".join(part() for _ in range(rng.randint(2, 4))) for _ in range(25)})
    rules = tuple({r.text: r for r in rules}.values())
    want = by_sql(urls, rules)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    for depth in (1, 9):
        assert judged(spark, urls, rules, depth) == want
