"""Token counts, conversation repair and ranked search: brute force, SQL, odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from quaystone.llm import conversations, ranked_search, token_counts
from quaystone.llm.shared import scratch_path

CLASHING = ("digest", "n", "n_tokens", "hot", "item", "row", "ids", "score", "rank", "hit", "copy", "kind", "letter", "audit", "head", "found_id", "every", "version")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASHING})


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# 11. Token counts


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_vocabulary())


def odd_texts():
    rng = random.Random(4)
    pool = ["a", "the ", " ", "  ", "▁", "é", "\n", "中", "　", "\0", "x y", ".", "<s>", "</s>", "\t", "ﬁ", "😀", "１"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    long = " ".join("".join(rng.choices("abcdeéf", k=rng.randint(1, 9))) for _ in range(60_000))
    return [None, "", " ", "▁", "a b", "a▁b", long, long.replace(" ", "  "), "z" * 70_000, *texts]


def test_counts_equal_the_library(spark, model, monkeypatch):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "a b"), (None, None)]
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows), key=str)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    for few in (token_counts.FEW, 5):
        monkeypatch.setattr(token_counts, "FEW", few)
        found = token_counts.count_tokens(docs, scratch_path(spark, "tokens"))
        assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert rows_of(found, *found.columns) == want
    assert token_counts.count_tokens(docs.limit(0), scratch_path(spark, "tokens")).count() == 0


def test_counts_of_hot_texts(spark, model, monkeypatch):
    monkeypatch.setattr(token_counts, "FEW", 1)
    monkeypatch.setattr(token_counts, "HOT_ROWS", 20)
    docs = spark.createDataFrame([(i, "the same words" if i % 3 == 0 else f"text {i % 90}") for i in range(600)], "doc_id long, text string").repartition(6)
    cache = scratch_path(spark, "tokens")
    found = token_counts.count_tokens(docs, cache)
    assert {r.n_tokens for r in found.where("doc_id % 3 = 0").collect()} == {len(model.encode("the same words"))}
    assert spark.read.parquet(cache).count() == 61  # each distinct text once


def test_cache_encodes_only_misses(spark, tmp_path):
    cache, version = f"file://{tmp_path}/cache", token_counts.counter_for(*token_counts._read(None)).version
    first = spark.createDataFrame([(1, "one two"), (2, "one▁two"), (3, "three")], "doc_id long, text string")
    token_counts.count_tokens(first, cache).collect()
    stored = {bytes(r.digest): r.n_tokens for r in token_counts.stored(spark, cache, version).collect()}
    assert set(stored) == {hashlib.sha256(t).digest() for t in (b"one two", b"three")}
    # What the cache says is taken, not encoded again; another version's rows are not.
    spark.createDataFrame([(hashlib.sha256(b"four").digest(), 77, version), (hashlib.sha256(b"five").digest(), 88, "0" * 64)], token_counts.CACHE).write.mode("append").partitionBy("version").parquet(cache)
    again = first.unionByName(spark.createDataFrame([(4, "four"), (5, "five")], "doc_id long, text string"))
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(again, cache).collect()}
    assert counts[4] == 77 and counts[5] == 1
    assert token_counts.stored(spark, cache, version).count() == 4
    files = spark.read.parquet(cache).count()
    token_counts.count_tokens(again, cache).collect()
    assert spark.read.parquet(cache).count() == files  # nothing was missing
    token_counts.compact(spark, cache, version, f"file://{tmp_path}/less")
    assert token_counts.stored(spark, f"file://{tmp_path}/less", version).count() == 4


def test_counts_with_the_other_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [t for t in odd_texts() if t is None or len(t) < 1000]
    found = token_counts.count_tokens(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), scratch_path(spark, "tokens"), path)
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


# 12. Conversation structure


def brute_align(codes):
    best = (math.inf, "")
    for target in [""] + [s + "ua" * k for s in ("", "s") for k in range(1, len(codes) + 2)]:

        @lru_cache(None)
        def least(i, j, target=target):
            found = [(0, "")] if i == len(codes) and j == len(target) else []
            step = lambda c, edit, rest: found.append((c + rest[0], edit + rest[1]))
            if i < len(codes):
                step(4, "D", least(i + 1, j))
            if j < len(target) and target[j] != "s":
                step(3, "I", least(i, j + 1))
            if i < len(codes) and j < len(target) and codes[i] != "x":
                more = 3 if codes[i].isupper() or codes[i] == "_" else 0
                if codes[i].lower() == target[j]:
                    step(more, "K", least(i + 1, j + 1))
                if target[j] != "s":
                    step(more + 3, "R", least(i + 1, j + 1))
            return min(found, default=(math.inf, ""))

        best = min(best, least(0, 0))
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(12)
    for _ in range(1500):
        codes = "".join(rng.choice("uauauaxs-UAS_") for _ in range(rng.randint(0, 8)))
        assert conversations.align(codes) == brute_align(codes) == conversations.align_by_states(codes), codes
    for n in (60, 300, 900):
        codes = "".join("ua"[i % 2] if rng.random() < 0.85 else rng.choice("uaxs-UAS_") for i in range(n))
        assert conversations.align(codes) == conversations.align_by_states(codes)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def odd_conversations():
    rng = random.Random(6)
    texts = ["Well.", "No", "  ", "", "What?  ", "x ", "é!", "a.b", "Same.", None]
    rows = []
    for c in range(120):
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn * rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]) if c % 3 else ("user", "assistant")[turn % 2], rng.choice(texts)))
    rows += [(None, 0, "user", "Who?"), (None, None, "assistant", "Me."), (500, None, "user", "One."), (500, None, "user", "Two."), (501, 1, "user", "w " * 200_000 + "."), rows[5], rows[5]]
    return rows


def test_conversations_equal_sql(spark):
    rows = odd_conversations()
    table = spark.createDataFrame(rows, CONVERSATIONS)
    con = duckdb.connect()
    con.register("conversations", table.toArrow())
    want = con.execute(conversations.SQL)
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall(), key=str)
    found = conversations.audit_damaged(clashing(table).repartition(4))
    assert [*found.columns] == names and rows_of(found, *names) == want
    assert conversations.audit_damaged(table.limit(0)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More."), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (2, 0, "system", "Be brief."), (2, 1, "user", " "), (3, 0, "tool", "cut off")]
    turns = [(r.conv_id, r.position, r.edit, r.role, r.text) for r in conversations.repair(spark.createDataFrame(rows, CONVERSATIONS)).orderBy("conv_id", "position").collect()]
    assert [t for t in turns if t[0] == 1] == [(1, 1, "K", "user", "Hi."), (1, 2, "I", "assistant", ""), (1, 3, "K", "user", "More."), (1, 4, "K", "assistant", "Yes.")]
    assert [t for t in turns if t[0] != 1] == []  # both are cheaper to delete: 8 against 4 + 6, 4 against 9
    audits = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in conversations.audit(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    assert audits[1] == (7, "KIKKD", hashlib.sha256(b"user:Hi.\nassistant:\nuser:More.\nassistant:Yes.").hexdigest())
    assert audits[3][:2] == (4, "D")


# 13. Ranked search


def brute_search(docs, items, k):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    counts = [(i, Counter(find((t or "").translate(low)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = Counter(find((text or "").translate(low)))
        scores = []
        for doc_id, c in counts:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        out += [(item, r, doc_id, -s) for r, (s, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def search_tables(n=400):
    rng = random.Random(8)
    words = ["Alpha", "beta", "GAMMA", "delta9", "été", "Über", "中文", "x", "y", "42", "rare1", "rare2", "rare3"]
    text = lambda k: rng.choice([" ", ", ", "\n", " "]).join(rng.choices(words, [9, 8, 7, 6, 5, 4, 3, 2, 2, 2, 1, 1, 1], k=k))
    docs = [(i, text(rng.randint(1, 60))) for i in range(n)]
    docs += [(i + n, docs[i % 7][1]) for i in range(60)]  # ties, many
    docs += [(None, docs[3][1]), (None, "rare1"), (900_000, None), (900_001, ""), (900_002, " .,"), docs[9], (900_003, text(100_000))]
    items = [(i, text(rng.randint(1, 30))) for i in range(40)] + [(None, "rare2 x"), (50, None), (51, ""), (52, "nowhere"), (3, "beta"), (3, "beta"), (53, "rare3 " * 400_000)]
    return docs, items


@pytest.mark.parametrize("block_terms", [ranked_search.BLOCK_TERMS, 25])
def test_search_equals_brute_force(spark, monkeypatch, block_terms):
    docs, items = search_tables()
    monkeypatch.setattr(ranked_search, "blocks", lambda q, f=ranked_search.blocks: f(q, block_terms))
    found = ranked_search.rank_documents(clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3), clashing(spark.createDataFrame(items, "item_id long, text string")))
    assert rows_of(found, "item_id", "rank", "doc_id", "score") == brute_search(docs, items, ranked_search.K)


def test_search_prunes_and_equals_sql(spark):
    rng = random.Random(9)
    topics = [[f"{t}{i}" for i in range(60)] for t in ("red", "green", "blue", "grey")]
    docs = [(i, " ".join(rng.choices(topics[i % 4], k=40))) for i in range(1200)]
    items = [(i, " ".join(rng.choices(topics[i % 4], k=12))) for i in range(48)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    con.register("benchmark", b.toArrow())
    assert rows_of(ranked_search.rank_documents(d, b), "item_id", "rank", "doc_id", "score") == sorted(con.execute(ranked_search.SQL).fetchall(), key=str)
    (block,) = ranked_search.blocks(ranked_search.item_terms(b))
    made = ranked_search.vectors(d, block)
    s = ranked_search.statistics(made, len(block.vocabulary))
    tree = ranked_search.Search(block, s, ranked_search.K, None)
    for part in ranked_search._documents(iter(made.where("row >= 0").toArrow().to_batches()), s, ranked_search.TREE):
        tree.add(part)
    assert tree.scored < tree.pairs / 3  # three of four topics share no term with an item


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.rank_documents(docs.limit(0), items).count() == 0
    assert ranked_search.rank_documents(docs, items.limit(0)).count() == 0
