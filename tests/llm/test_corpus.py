"""The corpus operators: brute force, round trips, held-out accuracy, odd inputs."""

import hashlib
import random
import textwrap
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaystone.llm import ann, bpe, license_scan, media, mixing, near_dup, quality, suffix_dedup, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["ablen", "corte", "dimma", "ferro", "gasto", "hilfe", "jarno", "kente", "lumen", "morra", "nexta", "pollo", "quint", "rasta", "sorte", "tando"]


def prose(rng, words=80):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words)).capitalize() + "."


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, odd texts, and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng) for _ in range(n)]
    passage = prose(rng, 60)
    for i in range(0, n, 9):
        texts[i] = prose(rng, 10) + "\n" + passage + "\n" + prose(rng, 10)
    for i in range(4, n, 10):
        texts[i] = texts[i - 1]  # exact copies
    for i in range(7, n, 10):
        w = texts[i - 1].split(" ")
        w[len(w) // 2] = "changed"
        texts[i] = " ".join(w)  # near copies
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "en", "src1", 0), (902, "", "en", "src1", 0), (903, "short one", "en", "src1", 9), (904, "nul\0 ퟿ é中 🎬", "en", "src2", 10), (905, prose(rng, 4000), "en", "src3", 0)]
    return rows + [rows[5], (None, prose(rng), "en", "src0", 1)]  # a repeated row and one without id


#: Names that operators use inside; inputs may have them too.
CLASHING = ("size", "u", "bucket", "unit", "g", "node", "score", "key", "copies", "edge", "blocks", "label_id", "c0", "ids", "media", "payload", "cut", "keep_id", "mix_id", "copy", "row", "d", "k", "p")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in CLASHING}).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ordered(rows):
    return sorted(rows, key=str)


# 1. Tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(docs, none, rows, library):
    got = [(r.doc_id, bytes(r.ids), r.text) for r in bpe.decode_documents(bpe.encode_documents(docs)).collect()]
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert ordered(got) == ordered(want)
    assert bpe.encode_documents(none).count() == 0


def test_bpe_streams_long_words_and_odd_characters(library):
    encoder = bpe.encoder_for(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(5)
    pools = ["\x1c\x1d\x85\xa0  \n\t", "Σσς", "éÀ×÷ßªº²½", "İIıſ", "中文", "😀👨‍👩", "áç", "0１٣Ⅷ", "'s't're'LL", "!?.,<|>", "<|endoftext|>"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(rng.choice("aeintrsho") for _ in range(6000)), "a" * 5000, "ha" * 4000, "x " * 70_000, "<|startoftext|>" * 3]
    assert encoder.transducer.lookahead < 1000 and len(texts[-5]) > encoder.transducer.room
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t), np.uint32).tolist() == ids
        assert bpe.decode(encoder, encoder.encode(t), portion=3) == library.decode(ids, skip_special_tokens=False)


def test_bpe_words_longer_than_a_piece(library, monkeypatch):
    """Texts without blanks are cut inside words, which changes nothing."""
    monkeypatch.setattr(bpe, "PIECE", 40)
    encoder = bpe.encoder_for(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(15)
    pools = ["abcdefgh", "éàüñ", "ea\u0301o\u0308", "中文字漢", "'s're'll'", "!?.,-", "\u1112\u1161\u11ab", "İIıΣσ", "01²", "<|endoftext|>", "x\u00a0", "\u0915\u093c\u09be"]
    for _ in range(400):
        some = rng.sample(pools, rng.randint(1, 4))
        t = "".join(rng.choice(some) if rng.random() < 0.1 else rng.choice(rng.choice(some)) for _ in range(rng.randint(100, 900)))
        assert np.frombuffer(encoder.encode(t), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)
    assert any(inside for _, inside in encoder.pieces("abcdefgh" * 100)) and any(inside for _, inside in encoder.pieces("!?" * 100))


def test_bpe_holds_a_piece_and_a_buffer():
    import tracemalloc

    encoder = bpe.encoder_for(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(16)
    peaks = []
    for n in (300_000, 1_500_000):
        text, made = "".join(rng.choices("aeintrsho", k=n)), 0
        tracemalloc.start()
        for portion in encoder.stream(text):
            made += len(portion)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert made > n / 4
    assert peaks[1] < 1.3 * peaks[0] and peaks[1] < 16 << 20


#: Texts in which no ASCII blank ends a piece.
UNBROKEN = {
    "digits": "0123456789", "letters and digits": "a1", "no-break spaces": "word\u00a0", "wide spaces": "中文\u3000", "apostrophes": "'", "contractions": "it's", "decomposed letters": "e\u0301o\u0308",
    "marks between letters": "a\u0315\u0300b\u05ae", "dotted capitals": "İ", "jamo": "\u1112\u1161\u11ab", "special tokens": "<|endoftext|>", "emoji": "👨‍👩", "thai": "\u0e17\u0e35\u0e48", "quotes": "'!'", "numbers": "Ⅷ²x",
}


@pytest.mark.parametrize("kind", UNBROKEN)
def test_bpe_pieces_are_bounded_for_any_text(library, monkeypatch, kind):
    import tracemalloc

    encoder = bpe.encoder_for(open(bpe.default_vocabulary(), encoding="utf-8").read())
    for size in (37, 64):
        monkeypatch.setattr(bpe, "PIECE", size)
        text = (UNBROKEN[kind] * 300)[:900]
        assert np.frombuffer(encoder.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
        assert max(len(p) for p, _ in encoder.pieces(text)) < size + 60
    monkeypatch.setattr(bpe, "PIECE", 1 << 12)
    peaks = []
    for n in (20_000, 80_000):
        text = (UNBROKEN[kind] * n)[:n]
        tracemalloc.start()
        for _ in encoder.stream(text):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] + (1 << 18) and peaks[1] < 4 << 20


def test_bpe_cuts_change_nothing(library, monkeypatch):
    encoder = bpe.encoder_for(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(21)
    pool = ["a", "B", "é", "e\u0301", "\u0301", "'", "'s", "'re", "'l", "l", "r", "1", "²", "\u00a0", "\u3000", "!", ".", "İ", "Σ", "\u1112\u1161", "\u11ab", "中", "<|endoftext|>", "<|end", "👨‍", "\u0e35", "s", "t", "\x1c", "\u0958", "\u212b"]
    for _ in range(800):
        monkeypatch.setattr(bpe, "PIECE", rng.randint(1, 30))
        some = rng.sample(pool, rng.randint(1, 6))
        t = "".join(rng.choice(some) if rng.random() < 0.8 else rng.choice(pool) for _ in range(rng.randint(20, 120)))
        assert np.frombuffer(encoder.encode(t), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, (bpe.PIECE, ascii(t))


def test_bpe_refuses_merges_out_of_order():
    with pytest.raises(ValueError):
        bpe.Transducer({c: i for i, c in enumerate(("a", "b", "c", "ab", "abc"))}, [("ab", "c"), ("a", "b")])


# 2. Quality


def labelled(spark, rng, n=300):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        lines = [prose(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 8))]
        if not good:
            lines = [" ".join(w + rng.choice(("###", "$$$", "%%%")) for w in line.split(" ")) for line in lines]
        rows.append((i, "\n".join(lines), "en", "s", 1))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(x[:2] for x in labels)


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark, random.Random(2))
    model = quality.fit(docs, labels)
    scored = quality.score_documents(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()
    out = [(r.score >= 0.5) == truth[r.doc_id] for r in scored if r.held_out]
    assert len(out) > 50 and np.mean(out) > 0.95
    assert all(0 <= r.score <= 1 for r in scored)
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {r.doc_id for r in scored if r.score >= 0.5}
    lines = quality.label_lines(docs.where("doc_id < 5"), model).collect()
    assert len(lines) == sum(len(r.text.split("\n")) for r in docs.where("doc_id < 5").collect())


def test_quality_odd_inputs(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, empty)
    assert {r.score for r in quality.score_documents(docs, model).collect()} == {0.5}
    odd = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, None, 0), (None, 1, 0), (3, 0, 0), (5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    scores = quality.score_documents(docs, quality.fit(docs, odd)).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.score_documents(none, model).count() == 0


def test_quality_with_one_id_for_many_texts(spark):
    docs, labels, _ = labelled(spark, random.Random(6), 40)
    hot = docs.withColumn("doc_id", F.lit(2).cast("long")).unionByName(docs)
    long = spark.createDataFrame([(999, "\n".join(["a fine line of prose"] * 9000), "en", "s", 1)], DOCS)
    rows = hot.unionByName(long)
    a, b = (quality.fit(rows.repartition(n), labels.unionByName(spark.createDataFrame([(2, 1, 0), (2, 0, 0), (999, 1, 0)], labels.schema)), sample=15, most_lines=50) for n in (1, 7))
    assert (a.weights == b.weights).all()
    assert quality.score_documents(rows, a).count() == rows.count()


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    score, moves, start = rng.normal(size=4), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, pair = quality.forward_backward(score, np.array([0, 4]), moves, start)
    total, node, edge = 0.0, np.zeros((4, 2)), np.zeros((4, 2, 2))
    for path in np.ndindex(2, 2, 2, 2):
        w = np.exp(start[path[0]] + sum(score[i] * path[i] for i in range(4)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for i in range(4):
            node[i, path[i]] += w
            if i < 3:
                edge[i, path[i], path[i + 1]] += w
    assert np.allclose(p, node / total) and np.allclose(pair, edge / total)


# 3. Repeats


@pytest.mark.parametrize("length", [5, 20, 60, 400])
def test_difference_cover(length):
    v, cover = suffix_dedup.difference_cover(length)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and v <= length


@pytest.mark.parametrize("length", [5, 20, 60, 400])
def test_repeats_equal_brute_force(docs, none, rows, length):
    got = [(r.doc_id, r.done.n_bytes, sum(x.end - x.begin for x in r.done.removed), len(r.done.removed), hashlib.sha256(r.done.kept).hexdigest()) for r in suffix_dedup.cut(docs, length, unit_bytes=4000, result="done").collect()]
    texts = [(r[1] or "").encode() for r in rows]
    want = [(r[0], len(t), *b) for r, t, b in zip(rows, texts, suffix_dedup.brute_force(texts, length), strict=True)]
    assert ordered(got) == ordered(want)
    assert suffix_dedup.cut(none, length).count() == 0


@pytest.mark.parametrize("words", [3, 12, 50])
def test_repeated_words_equal_brute_force(spark, docs, rows, words):
    rng = random.Random(9)
    shared = [prose(rng, 51), prose(rng, 49)]
    more = [(2000 + i, f"{prose(rng, 5)}{blank}{shared[i % 2]}{blank}{prose(rng, 7)}", "en", "s", 1) for i, blank in enumerate((" ", "\n", "\t\t", "  \r\n", "\x0b"))]
    more += [(2100, "\u00a0".join("w" * 300), "en", "s", 1), (2101, "w " * 300, "en", "s", 1), (2102, " \n ", "en", "s", 1), (2103, " ", "en", "s", 1), (2104, "é " * 120, "en", "s", 1)]
    every = [*rows, *more]
    got = [(r.doc_id, bytes(r.done.kept), b"".join((r.text or "").encode()[a:b] for a, b in zip([0, *(x.end for x in r.done.removed)], [*(x.begin for x in r.done.removed), r.done.n_bytes], strict=True))) for r in suffix_dedup.cut(spark.createDataFrame(every, DOCS).repartition(3), words, unit_bytes=4000, result="done", by_words=True).collect()]
    assert all(kept == spans for _, kept, spans in got)
    want = suffix_dedup.brute_force_words([(r[1] or "").encode() for r in every], words)
    assert ordered((i, kept) for i, kept, _ in got) == ordered(zip((r[0] for r in every), want, strict=True))
    if words == 50:
        text = {r[0]: k.decode() for r, k in zip(every, want, strict=True)}
        assert shared[0] not in text[2000] and shared[1] in text[2001]


# 4. Urls


def test_urls(spark):
    urls = ["http://A.example.NET/en/1", "http://x.net/", "http://x.net", "https://m.example.com/de/9?x#y", "http://b.org/fr/2", "http://notnet/x", "nothing", None, "ftp://h?q", "http://b.org/fr/2", "http://é.NET/ü\n/?", "://", "http://n.org/a/b/c/d/e"]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("h", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    rule = {i: got[i].rule for i in got}
    assert [rule[i] for i in range(len(urls))] == ["example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None, None, "org/fr/", "net/", None, None]
    assert got[3].host == "m.example.com" and got[3].path == "/de/9" and got[3].verdict == "block"
    assert (got[6].host, got[6].path, got[6].verdict) == ("", "", "allow") == (got[7].host, got[7].path, got[7].verdict)
    assert got[8].host == "h" and got[8].path == "" and got[12].template.endswith("/**")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_templates_learn_from_labels(spark):
    rules = tuple(map(url_filter.parse_rule, ("block h/shop/1", "block h/shop/2", "allow h/blog/1", "allow h/blog/2")))
    urls = [f"http://h/{kind}/{n}" for kind in ("shop", "blog") for n in range(100, 300)]
    pages = spark.createDataFrame([*enumerate([*urls, "http://h/shop/999", "http://h/blog/999"])], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert (got[400].rule, got[400].verdict, got[400].template) == (None, "block", "/shop/*")
    assert (got[401].rule, got[401].verdict) == (None, "allow")


def test_labels_reach_siblings(spark):
    """Two blocked branches block the unlabelled ones of their host, one does not, and an allowed one holds them back."""
    rules = tuple(map(url_filter.parse_rule, ("block two/a/", "block two/b/", "block one/a/", "block mixed/a/", "block mixed/b/", "allow mixed/c/", "block deep/x/a/", "block deep/x/b/")))
    urls = {"http://two/c/1": "block", "http://two/z": "block", "http://one/c/1": "allow", "http://mixed/d/1": "allow", "http://deep/x/c": "block", "http://deep/y/c": "allow", "http://none/a": "allow"}
    labelled = [f"http://{place}{i}" for place in ("two/a/", "two/b/", "one/a/", "mixed/a/", "mixed/b/", "mixed/c/", "deep/x/a/", "deep/x/b/") for i in range(4)]
    pages = spark.createDataFrame(list(enumerate([*urls, *labelled])), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert [got[i].verdict for i in range(len(urls))] == list(urls.values())
    assert abs(got[0].purity - 0.625) < 1e-9 and abs(got[2].purity - 0.5) < 1e-9 and got[6].purity == 0.25


def test_similar_branches_merge_and_hot_nodes_are_spread(spark, monkeypatch):
    monkeypatch.setattr("quaystone.llm.shared.HOT_ROWS", 3)
    monkeypatch.setattr("quaystone.llm.shared.HOT_KEYS", 10**9)
    rules = tuple(map(url_filter.parse_rule, ("block h/a/x", "block h/b/x", "allow h/c/x")))
    urls = [f"http://h/{kind}/{leaf}{i}" for kind in "abc" for i in range(30) for leaf in ("x", "y")]
    got = {r.path: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls * 2)), "page_id long, url string"), rules).collect()}
    assert len(got) == 180 and got["/a/x1"].template != got["/c/x1"].template
    assert {r.verdict for p, r in got.items() if p.startswith("/c/")} == {"allow"} and {r.verdict for p, r in got.items() if p[3] == "y" and p[1] in "ab"} == {"block"}


# 5. Licences


@pytest.mark.parametrize("sections", [16, 17, 40])
def test_urls_on_large_hosts(spark, sections):
    clean = [f"http://www.example.com/s{i}/x{i}.html" for i in range(sections - 1)]
    pages = spark.createDataFrame(list(enumerate(["http://www.example.com/de/a.html", *clean])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    assert got == {0: "block"} | dict.fromkeys(range(1, sections), "allow")


def test_urls_below_the_third_segment(spark):
    rules = tuple(map(url_filter.parse_rule, ("block h/a/b/c/bad/x/1", "allow h/a/b/c/good/x/1")))
    urls = [f"http://h/a/b/c/{kind}/x/{i}" for kind in ("bad", "good", "new") for i in range(10, 30)]
    got = [r.verdict for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()]
    assert got == ["block"] * 20 + ["allow"] * 40


def test_licences(spark):
    files = [
        ("a/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("a/b/x", "no notice here"), ("a/b/c/y", "text\nReleased under the MIT License.\nmore text that goes on for a while and says other things"),
        ("z/w", "nothing"), (None, "nothing"), ("q/n", None), ("top", ""), ("a/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("s/f", "# SPDX-License-Identifier: Apache-2.0"),
    ]
    frame = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "file_id long, path string, text string").withColumn("license", F.lit(1)).withColumn("dir", F.lit(1))
    got = {r.file_id: (r.license, r.origin, r.origin_path) for r in license_scan.scan(frame).collect()}
    gpl = ("GPL-3.0", "own", "a/LICENSE")
    assert got[0] == got[7] == gpl and got[1] == ("GPL-3.0", "inherited", "a/LICENSE") and got[2][:2] == ("MIT", "own") and got[8][0] == "Apache-2.0"
    assert [got[i] for i in (3, 4, 5, 6)] == [(None, None, None)] * 4
    assert license_scan.scan(frame.limit(0)).count() == 0


def test_licence_texts_and_headers():
    common = {t: 3000 for t in "the of to and a in or is that for this with by as any you not be are it from on".split()}
    m = license_scan.Matcher.fitted(common, 10000)
    rng = random.Random(4)
    for name, _ in license_scan.full_texts():
        text = (Path(license_scan.__file__).parent / "licenses" / f"{name}.txt").read_text("utf-8")
        assert m.scan(f"Copyright (c) 2021 Jane Doe and contributors\n\n{text}")[::2] == (name, True)
    for name, texts in license_scan.HEADERS.items():
        for block in texts:
            for width in (50, 76):
                head = "\n".join(f" * {line}" for line in textwrap.wrap(block, width))
                code = "\n".join(prose(rng, 9) for _ in range(60))
                assert m.scan(f"/*\n * Copyright (C) 2020 Jane Doe\n *\n{head}\n */\n{code}")[::2] == (name, False), (name, width)
    assert m.scan("the of to and a in or is that for this with by as any you not be are it\n" * 300)[0] is None
    assert {"BSD-2-Clause", "BSD-3-Clause", "ISC"} <= {name for name, _ in license_scan.full_texts()}


def test_full_licence_file_is_inherited(spark):
    mit = (Path(license_scan.__file__).parent / "licenses" / "MIT.txt").read_text("utf-8")
    files = [("p/LICENSE", mit), ("p/src/main.c", "int main"), ("q/other.c", "int main")]
    frame = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "file_id long, path string, text string")
    got = {r.path: (r.license, r.origin) for r in license_scan.scan(frame).collect()}
    assert got == {"p/LICENSE": ("MIT", "own"), "p/src/main.c": ("MIT", "inherited"), "q/other.c": (None, None)}


def test_inheritance_equals_brute_force(spark):
    """Own notices and inheritance against plain loops over all windows, templates and directories."""
    rng = random.Random(14)
    notes = [t for name in sorted(license_scan.NOTICES) for t in license_scan.NOTICES[name]]
    files = []
    for i in range(150):
        parts = [rng.choice("abc") for _ in range(rng.randint(0, 3))] + [f"f{i % 140}"]
        lines = [prose(rng, rng.randint(1, 12)) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), rng.choice(notes))
        if rng.random() < 0.2:
            lines = [rng.choice(notes)]
        files.append((i, "/".join(parts) if rng.random() < 0.95 else None, "\n".join(lines) if rng.random() < 0.95 else None))
    known = {t for _, c in [*license_scan.templates(), *license_scan.blocks(), *license_scan.full_texts()] for t in c}
    counts = Counter(t for _, _, text in files for t in set(license_scan.terms(text or "")) & known)
    m = license_scan.Matcher.fitted(counts, len(files))

    def cosine(a, b):
        w = lambda c: {t: k * m.idf.get(t, m.rare) for t, k in c.items()}
        a, b = w(a), w(b)
        size = lambda v: sum(x * x for x in v.values()) ** 0.5
        return sum(x * b.get(t, 0) for t, x in a.items()) / (size(a) * size(b)) if a and b else 0.0

    own, holders = {}, defaultdict(list)
    for i, path, text in files:
        lines = (text or "").split("\n")
        best = max((cosine(Counter(license_scan.terms("\n".join(lines[a : a + k]))), c), name) for a in range(len(lines)) for k in (1, 2, 3) for name, c in license_scan.templates())
        whole = max((cosine(Counter(license_scan.terms(text or "")), c), name) for name, c in license_scan.templates())
        own[i] = best[1] if best[0] >= license_scan.THRESHOLD else whole[1] if whole[0] >= license_scan.FILE_THRESHOLD else None
        if whole[0] >= license_scan.FILE_THRESHOLD and path is not None:
            holders["/".join(path.split("/")[:-1])].append((-max(best[0], 0), path, own[i]))
    frame = spark.createDataFrame(files, "file_id long, path string, text string").repartition(3)
    for r in license_scan.scan(frame).collect():
        if own[r.file_id] or r.path is None:
            assert r.license == own[r.file_id] and r.origin == ("own" if r.license else None)
            continue
        up = r.path.split("/")[:-1]
        near = next((holders["/".join(up[:k])] for k in range(len(up), -1, -1) if "/".join(up[:k]) in holders), None)
        assert (r.license, r.origin) == ((None, None) if near is None else (r.license, "inherited"))
        if near is not None:
            assert r.license in {name for s, _, name in near if abs(s - min(near)[0]) < 1e-9} and any(p == r.origin_path for _, p, _ in near)


def test_anchors_skip_nothing():
    m = license_scan.Matcher.fitted({"the": 90, "license": 3}, 100)
    loose = license_scan.Matcher(m.idf, m.rare, m.vectors, frozenset(t for _, v in m.vectors for t in v))
    rng = random.Random(3)
    known = sorted({t for _, v in m.vectors for t in v})
    for _ in range(300):
        text = "\n".join(" ".join(rng.choice(known if rng.random() < 0.7 else WORDS) for _ in range(rng.randint(0, 9))) for _ in range(3))
        assert m.scan(text)[::2] == loose.scan(text)[::2]


# 6. Neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, [1.0] * 3), (None, [1.0] * 16), (0, x[0].tolist())]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("id", F.lit("x"))
    got = defaultdict(list)
    for r in ann.search(frame, part_rows=64).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hits, full = 0, x.astype(np.float64)
    for q, found in got.items():
        s = np.zeros(900)
        for k in range(16):
            s += full[q, k] * full[:, k]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        assert [f[0] for f in sorted(found)] == list(range(1, 21)) and all(s[i] == score for _, i, score in found)
        assert sorted(found) == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({*best.tolist()} & {i for _, i, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    assert ann.search(frame.limit(0)).count() == 0
    few = ann.search(frame.where("vec_id in (0, 1, 2)")).collect()
    assert {(r.query_id, r.vec_id) for r in few} == {(0, 1), (0, 2)}


@pytest.mark.parametrize("n", [2, 21, 24, 30, 60])
def test_neighbours_are_always_k(spark, n):
    rng = np.random.default_rng(n)
    frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(n)], "vec_id long, embedding array<double>")
    got = Counter(r.query_id for r in ann.search(frame).collect())
    assert got == {q: min(20, n - 1) for q in range(0, n, 20)}


def test_probes_follow_the_data():
    rng = np.random.default_rng(2)
    centres = 20 * rng.normal(size=(40, 16))
    clustered = (centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16))).astype(np.float32)
    loose = rng.normal(size=(2000, 16)).astype(np.float32)
    few, many = (ann.needed_probes(ann.fit(x, 45), x, 20) for x in (clustered, loose))
    assert few <= 6 < many


# 7. Near duplicates


def near_classes(rows):
    """Class ids by comparing everything with everything."""
    sets = [(r[0], near_dup.document(r[1])) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, (ni, si)) in enumerate(sets):
        for j in range(i):
            nj, sj = sets[j][1]
            a, b = Counter(si.tolist()), Counter(sj.tolist())
            both = sum((a & b).values())
            if ni == nj or (both and both >= 0.8 * sum((a | b).values()) - 1e-9):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    return [(r[0], min((k for k in least[root(i)] if k is not None), default=None)) for i, r in enumerate(rows)]


def test_near_classes_equal_brute_force(docs, none, rows):
    got = [tuple(r) for r in near_dup.classes(docs).collect()]
    assert ordered([g[:2] for g in got]) == ordered(near_classes(rows))
    sizes = Counter(g[1] for g in got if g[1] is not None)
    assert all(g[2] == sizes[g[1]] for g in got if g[1] is not None)
    assert near_dup.classes(none).count() == 0
    kept = [r.doc_id for r in near_dup.keep_one(docs).collect()]
    assert ordered(kept) == ordered({c for _, c in near_classes(rows)})


def test_large_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BUCKET_ROWS", 8)
    monkeypatch.setattr(near_dup, "CLUSTER_ROWS", 8)
    rng = random.Random(8)
    base = prose(rng, 120).split(" ")
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(len(w))] = f"changed{i}"
        rows.append((i, " ".join(w), "en", "s", 1))
    got = {tuple(r) for r in near_dup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert {g[:2] for g in got} == set(near_classes(rows)) == {(i, 0) for i in range(40)} and {g[2] for g in got} == {40}


def drifting(rng, families, steps, n, words=100):
    """Families of texts, each text a changed copy of an earlier one: links form chains, and many are near the limit."""
    rows = []
    for f in range(families):
        texts = [[rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words)]]
        while len(texts) < n:
            w = list(rng.choice(texts[-6:]))
            for _ in range(rng.randint(0, steps)):
                w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            texts.append(w)
        rows += [(f * n + i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize(("bucket_rows", "cluster_rows"), [(3, 3), (1000, 5)])
def test_members_far_from_the_pivot_lose_no_link(spark, monkeypatch, bucket_rows, cluster_rows):
    monkeypatch.setattr(near_dup, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(near_dup, "CLUSTER_ROWS", cluster_rows)
    rows = drifting(random.Random(bucket_rows), 2, 3, 45)
    want = near_classes(rows)
    assert len({c for _, c in want}) > 4  # chains, some of them broken
    assert ordered([tuple(r)[:2] for r in near_dup.classes(spark.createDataFrame(rows, DOCS)).collect()]) == ordered(want)


def test_one_large_cluster_costs_a_row_a_member(spark, monkeypatch):
    """Rows that are compared, counted: in proportion to the members of a group of near copies."""
    rng, n = random.Random(10), 1200
    base = prose(rng, 60).split(" ")
    rows = [(i, " ".join([*base[: i % 60], f"changed{i}", *base[i % 60 + 1 :]]), "en", "s", 1) for i in range(n)]
    monkeypatch.setattr(near_dup, "BUCKET_ROWS", 64)
    monkeypatch.setattr(near_dup, "CLUSTER_ROWS", 64)
    compared, dealt = [], near_dup.dealt
    monkeypatch.setattr(near_dup, "dealt", lambda df, key: compared.append(df.count()) or dealt(df, key))
    got = near_dup.classes(spark.createDataFrame(rows, DOCS))
    assert {tuple(r)[1:] for r in got.collect()} == {(0, n)}
    assert sum(compared) < 2 * n * (near_dup.BANDS + 1), compared


def test_signatures_are_unbiased_and_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 2**63, 400).astype(np.uint64)
    a = rng.integers(1, 9, 400)
    b = a.copy()
    b[:120] = rng.integers(1, 9, 120)
    sig = near_dup.signatures(np.concatenate([h, h]), np.concatenate([a, b]), np.repeat([0, 1], 400), 2, m=8000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02
    assert (near_dup.signatures(h, a, np.zeros(400, int), 1, m=8000)[0] == sig[0]).all()


# 8. Media


def test_media_round_trip(docs, none, rows):
    films = media.encode(docs)
    got = {(r.doc_id, r.n_bytes, r.payload_sha256, r.problem) for r in media.read_back(films).collect()}
    assert got == {(r[0], len((r[1] or "").encode()), hashlib.sha256(media.payload_of(r[1])).hexdigest(), None) for r in rows}
    clips = media.clips(films).collect()
    frames = Counter()
    for c in clips:
        frames[c.doc_id] += c.frames
    assert frames[905] == len(media.payload_of([r for r in rows if r[0] == 905][0][1])) // media.UNIT
    assert media.read_back(media.encode(none)).count() == 0


def test_media_other_tables_shots_and_damage():
    rng = np.random.default_rng(1)
    frames = rng.integers(0, 256, (3, 24, 24)).astype(np.uint8)
    jpegs = media.pack_frames(frames)
    assert (media.unpack_frames(jpegs) == frames).all()
    head, data = media._scan(jpegs[0])
    slow = media._by_bits(data, 576, media._tables(head)[2])
    assert slow[0] == int(frames[0, 0, 0]) - 128 and (slow[1:24] == np.diff(frames[0, 0].astype(int))).all()
    film = np.concatenate([np.full((10, 24, 24), 20), np.full((10, 24, 24), 200)]).astype(np.uint8)
    assert media.cuts(film)[0].tolist() == [0, 10]
    good = media.write_avi(film.tobytes())
    assert media.describe(good)["payload_bytes"] == film.size
    assert "problem" in media.describe(good[:500]) and "problem" in media.describe(None) and "problem" in media.describe(b"RIFF")


# 9. Mixing


def test_mixing(spark, docs, none, rows, monkeypatch):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and mixing.mix(none).count() == 0
    sources = defaultdict(list)
    by_id = {r[0]: r for r in rows}
    for r in got:
        assert r.size == len((by_id[r.doc_id][1] or "").split()) and r.taken == r.copies * r.size <= 3 * r.size
        sources[by_id[r.doc_id][3]].append(r)
    for found in sources.values():
        largest = max(r.size for r in found)
        assert sum(r.size for r in found) == found[0].source_size
        assert abs(sum(r.taken for r in found) - found[0].target) <= largest
    total = sum(r.size for r in got)
    assert abs(sum(f[0].target for f in sources.values()) - total) < 1e-6 * total
    assert ordered(mixing.mix(docs.repartition(3)).collect()) == ordered(got)
    monkeypatch.setattr(mixing, "RANK_PARTS", 1)
    monkeypatch.setattr(mixing, "SENT_ROWS", 0)
    assert ordered(mixing.mix(docs).collect()) == ordered(got)
    monkeypatch.setattr(mixing, "RANK_PARTS", 2)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 3)  # the part in which the words run out is split several times
    assert ordered(mixing.mix(docs).collect()) == ordered(got)


def test_a_long_document_does_not_end_the_ranking(spark):
    sources = {f"long{i}": [(1000 * i + j, 10) for j in range(100)] + [(1000 * i + 999, 300)] for i in range(12)}
    rows = [(k, " ".join(["w"] * n), s) for s, found in sources.items() for k, n in found]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs, weights=(2, 1)).collect()}
    assert max(abs(sum(got[k].taken for k, _ in found) - got[found[0][0]].target) for found in sources.values()) <= 10


def test_inclusion_grows_with_size(spark):
    """Chances are in proportion to sizes, and the largest documents are certain."""
    rng = random.Random(3)
    rows = [(i, "w " * (5 if i % 2 else 20), "a") for i in range(3000)] + [(9000, "w " * 9000, "a")] + [(10_000 + i, "w " * rng.randint(1, 40), "b") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 4)).collect()
    size = {r.size: [x.copies for x in got if x.doc_id < 9001 and x.size == r.size] for r in got if r.doc_id < 9001}
    target, total = next((r.target, r.source_size) for r in got if r.doc_id == 0)
    assert target < total and size[9000] == [1]
    c = (target - 9000) / sum(n * n for n in (5, 20) for _ in range(1500))
    for n in (5, 20):
        assert abs(np.mean(size[n]) - c * n) < 0.05


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 400), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights 5, 2, 1, 5: a and the null source stop at 30 and 270, the rest goes 2 : 1
    assert got == {"a": 30.0, None: 270.0, "b": 800.0, "c": 400.0}


def test_stages_keep_columns_of_any_name(docs, none):
    for stage in (near_dup.keep_one, suffix_dedup.remove_repeats, mixing.mixed_documents):
        assert stage(docs).schema.names == docs.columns and stage(none).count() == 0
    copies = sorted((str(r.doc_id), r.copies) for r in mixing.mix(docs).collect() if r.copies)
    got = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    want = Counter()
    for i, n in copies:
        want[i] += n
    assert {str(k): n for k, n in got.items()} == want


def test_ids_that_repeat_or_lack(spark):
    """One id with two texts, many rows without id: rows are told apart."""
    rng = random.Random(21)
    base = prose(rng, 100)
    near = base.replace(base.split(" ")[50], "changed")
    rows = [(3, base, "a"), (5, near, "b"), (5, prose(rng, 100), "c"), *((None, prose(rng, 90), f"s{i % 3}") for i in range(20)), *((None, near, "a") for _ in range(20)), *((40, prose(rng, 30 + i), f"s{i % 4}") for i in range(40))]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS)
    kept = near_dup.keep_one(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter({3: 1, 5: 1, None: 20, 40: 40}) and near not in {r.text for r in kept}
    plan = mixing.mix(docs).collect()
    mixed = mixing.mixed_documents(docs).collect()
    assert len(mixed) == sum(r.copies for r in plan) and sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in plan)
    assert max(Counter(mixed).values()) <= 3 * 20


# 10. Archives


def test_archives(spark):
    long = "<p>" + "x" * 200
    pages = [(1, "http://a/1\r\nX: y", long), (2, "http://a/2", long), (3, None, None), (4, "u", ""), (5, "u", "é" * 49), (6, "u", "é" * 49), (7, "u", "é" * 50), (8, "u", "é" * 50), (1, "http://a/1", long), (None, "u", long)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first_id", F.lit(1))
    archives = warc.write_archives(frame, archive_bytes=500)
    got = warc.read_archives(archives).collect()
    assert all(r.problem is None for r in got) and len(got) == len(pages)
    for r in got:
        html = next((p[2] or "") for p in pages if p[0] == r.page_id).encode()
        assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha256(html).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(2, 1), (8, 7)}
    assert warc.read_archives(warc.write_archives(frame.limit(0))).count() == 0


def test_archive_damage_is_reported(spark):
    import struct

    import zstandard

    lead = struct.pack("<II", warc.SKIPPABLE, 3) + b"abc"
    pack = zstandard.ZstdCompressor(dict_data=warc.as_dictionary(b"abc")).compress
    good = warc.record_bytes(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    content = lead + pack(good) + pack(good.replace(b"hello", b"jello")) + pack(good + b"x") + pack(b"junk") + pack(good)[:-3]
    rows = warc.read_archives(spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(b"\1\2")), ("c", None)], "archive string, content binary")).orderBy("archive", "record").collect()
    assert [r.problem for r in rows[:4]] == [None, "payload does not fit its length or digest", "Content-Length does not fit the block", "no WARC version line"]
    assert rows[4].problem.startswith("bad frame") and rows[5].problem.startswith("bad frame") and len(rows) == 6


# The pipeline


def test_pipeline_equals_brute_force(spark, tmp_path, library):
    rng = random.Random(11)
    rows = [*corpus(12, 50), *((None, prose(rng), "en", "src1", 1) for _ in range(3)), (7, prose(rng), "en", "src2", 1), (7, prose(rng), "en", "src3", 1)]
    rows += [(1000 + i, " ".join(prose(rng, 3) + "#" * 12 + "$%&" for _ in range(20)), "en", f"src{i % 4}", 1) for i in range(20)]
    passage = prose(rng, 51)
    rows += [(1100 + i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", "en", f"src{i % 4}", 1) for i in range(4)]
    frame = spark.createDataFrame(rows, DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], int(not 1000 <= r[0] < 1100), 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(frame, labels)
    good = Counter(tuple(r) for r in quality.keep_good(frame, model).collect())
    kept = [r for r in rows if good[r]]
    assert len(kept) >= 40 and not any(1000 <= (r[0] or 0) < 1100 for r in kept)
    keyless = [(k, *r[1:]) for k, r in enumerate(kept)]  # classes of rows, by their place
    first: dict = {}
    for k, c in near_classes(keyless):
        best = first.get(c)
        if best is None or (kept[k][0] is None, kept[k][0] or 0) < (kept[best][0] is None, kept[best][0] or 0):
            first[c] = k
    kept = [kept[k] for k in first.values()]
    texts = suffix_dedup.brute_force_words([(r[1] or "").encode() for r in kept], 50)
    cut = [(r[0], None if r[1] is None else t.decode(), *r[2:]) for r, t in zip(kept, texts, strict=True)]
    assert not any(passage in (r[1] or "") for r in cut)
    want = []
    for r in mixing.mixed_documents(spark.createDataFrame(cut, DOCS)).collect():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert ordered(got) == ordered(want)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
