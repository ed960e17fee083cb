"""URL rules, quality scores, benchmark leaks, licences and exact search on small tables."""

import math
import random

import numpy as np
import pytest

from tabulon.llm import decontaminate, licenses, quality_ftrl, topk, url_filter
from tabulon.llm.queries import RULES
from tabulon.llm.texthash import mix
from tests.llm import helpers


def judged(spark, urls, links=None):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    links = url_filter.page_links(pages) if links is None else spark.createDataFrame(links, "source string, target string")
    return {r["page_id"]: tuple(r)[1:5] for r in url_filter.filter_urls(pages, RULES, links).collect()}


def test_longest_rule_wins_on_hosts_and_subdomains(spark):
    got = judged(spark, ["http://WWW.Example.ORG/es/1?x#y", "https://example.org/en/12", "http://anexample.org/es/", "http://a.com/de/x",
                         "http://a.com/fr", "http://com/fr/", "no scheme", None, "x://h?q=1"])
    assert got == {
        0: ("www.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"),
        2: ("anexample.org", "/es/", "org/", "allow"), 3: ("a.com", "/de/x", "com/de/", "block"), 4: ("a.com", "/fr", None, "allow"),
        5: ("com", "/fr/", "com/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("h", "", None, "allow"),
    }


def test_blocks_reach_aliases_but_not_explicit_allows(spark):
    urls = ["http://a.net/1", "http://b.net/2", "http://c.net/3", "http://d.org/x", "http://e.net/5"]
    links = [(urls[0], urls[1]), (urls[2], urls[1]), (urls[2], "http://z.com/de/hidden"), (urls[3], urls[0]), (None, urls[4]), (urls[4], urls[4])]
    got = judged(spark, urls, links)
    assert [got[i][3] for i in range(5)] == ["block", "block", "block", "allow", "allow"]
    assert judged(spark, [], links) == {}


def test_links_declared_by_pages(spark):
    html = '<head><link href="/canon" rel="canonical"><meta http-equiv=refresh content="0; URL=http://o.net/t"></head>'
    pages = spark.createDataFrame([(1, "http://s.net/p?q", html), (2, None, html)], "page_id long, url string, html string")
    got = {(r["source"], r["target"]) for r in url_filter.page_links(pages).collect()}
    assert got == {("http://s.net/p?q", t) for t in ("http://s.net/canon", "http://o.net/t", "canonical:s.net/p")}


def test_relative_links_are_resolved_against_the_page(spark):
    link = lambda href: f'<link rel="canonical" href="{href}">'
    cases = [("http://a.net/x/p", "index.html", "http://a.net/x/index.html"), ("http://b.net/x/p", "index.html", "http://b.net/x/index.html"),
             ("http://c.net/x/p?q", "?p=1&amp;r=2", "http://c.net/x/p?p=1&r=2"), ("https://d.net/1", "//e.net/2", "https://e.net/2"),
             ("http://f.net", "a/./b?c=../d", "http://f.net/a/b?c=../d"), ("http://g.net/a/b/c", "../../../d/..", "http://g.net/"),
             ("http://h.net/a", "http://i.net/&#233;&#x2F;&lt", "http://i.net/\u00e9/&lt"), ("http://j.net/a#x", "/k&#x110000;", "http://j.net/k&#x110000;")]
    pages = spark.createDataFrame([(i, u, link(h)) for i, (u, h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {(r["source"], r["target"]) for r in url_filter.page_links(pages).collect() if not r["target"].startswith("canonical:")}
    assert got == {(u, t) for u, _, t in cases}
    rows = [(0, "http://a.com/de/p", link("index.html")), (1, "http://b.net/p", link("index.html"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, RULES, url_filter.page_links(pages)).collect()}
    assert verdicts == {0: "block", 1: "allow"}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=6)], "extra") for i in range(600)]
    vectors[10] = (10, None, "x")
    vectors[20] = (20, [1.0, float("nan")] + [0.0] * 4, "x")
    vectors[30] = (30, [1.0, None] + [0.0] * 4, "x")
    vectors[0] = (0, [0.0] * 6, "zeros")
    vectors += [(i, vectors[50][1], "same") for i in (700, 701, 702)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string").repartition(3)
    got = {}
    for r in topk.top_k(df.filter("vec_id % 50 = 0"), df, "vec_id", "embedding", k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ok = {i: [math.floor(1024 * x) for x in v] for i, v, _ in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in [i for i in ok if i % 50 == 0]:
        scores = [(-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q]
        want[q] = [(i, -s) for s, i in sorted(scores)[:10]]
    assert got == want
    few = spark.createDataFrame(vectors[100:104], df.schema)
    assert topk.top_k(few.limit(1), few, "vec_id", "embedding").count() == 3
    assert topk.top_k(df.limit(0), df, "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("query", [[3, 1], [0, 0]])
def test_top_k_with_repeated_rows_of_the_query(query):
    """Several rows with the query's own id take no places of its neighbours."""
    ids = np.array([0] * 5 + list(range(1, 13)))
    rows = np.array([[9, 9]] * 5 + [[i % 7, 1] for i in range(1, 13)])
    got = topk.SortedLists(ids, rows).top(0, np.array(query), 4, [])
    assert got == sorted((-int(np.dot(query, r)), int(i)) for i, r in zip(ids, rows) if i != 0)[:4]


def test_quality_learns_from_training_rows_only(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        words = helpers.word_list(rng, 40)
        docs.append((i, " ".join(words) if good else " | ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good) if i % 90 else None))
    docs += [(5000, None), (5001, ""), (5002, "x " * 50_000), (None, "a b")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'s' as score", "1 as predicted")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality_ftrl.fit_on_labels(d, lab)
    rows = quality_ftrl.classify(d, weights, keep=["doc_id"]).withColumn("out", quality_ftrl.held_out(d["doc_id"])).collect() if False else \
        quality_ftrl.classify(d, weights, keep=["doc_id"]).collect()
    truth = dict(labels)
    held = {r["doc_id"]: r["predicted"] for r in rows if r["doc_id"] is not None and __import__("zlib").crc32(str(r["doc_id"]).encode()) % 4 == 2}
    known = [i for i in held if truth.get(i) is not None]
    assert len(rows) == len(docs) and np.mean([held[i] == truth[i] for i in known]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (5000, 5001)}) == 1
    flipped = lab.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    assert np.array_equal(weights, quality_ftrl.fit_on_labels(d, flipped))
    none = quality_ftrl.fit_on_labels(d, lab.limit(0))
    assert not none.any() and quality_ftrl.score(d.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(9)
    words = [w for w in {"".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)}]
    items = [(i, " ".join(rng.sample(words, 30)) + ". The answer is " + " ".join(rng.sample(words, 6)) + ".") for i in range(40)]
    items += [(100, None), (101, ""), (102, "two words")]
    docs = [(i, " ".join(rng.choices(words, k=300))) for i in range(200)]
    planted = {}
    for i, (item, text) in enumerate(items[:12]):
        part = text.split(" ")
        if i % 3 == 1:  # a paraphrase: every sixth word replaced
            part = [w if n % 6 else rng.choice(words) for n, w in enumerate(part)]
        if i % 3 == 2:  # words put in between, other punctuation
            part = [x for n, w in enumerate(part) for x in ((w.replace(".", ";"),) if n % 8 else (w, rng.choice(words)))]
        planted[i] = item
        docs[i] = (i, docs[i][1] + "\n" + " ".join(part).upper() + " " + docs[i][1])
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    return docs, items, planted


def test_leaks_are_found_and_clean_documents_left_alone(spark, leaks):
    docs, items, planted = leaks
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as cosine").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.build_indexes(d, b, decontaminate.Settings())
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, index).collect()]
    assert sorted(got) == sorted([*planted.items(), (0, planted[0])])
    kept = decontaminate.clean(d, index)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - set(planted)
    assert decontaminate.contaminated(d, decontaminate.build_indexes(d, b.limit(0), decontaminate.Settings())).count() == 0
    assert decontaminate.contaminated(d.limit(0), index).count() == 0


def test_latent_candidates_recall(spark, leaks):
    """The latent cosine finds nearly all windows that the full TF-IDF cosine finds."""
    docs, items, _ = leaks
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.build_indexes(d, b, decontaminate.Settings())[0]
    texts = [t for _, t in docs if t]
    windows = [" ".join(t.split()[i : i + 32]) for t in texts for i in range(0, len(t.split()), 32)]
    idf = index.idf.astype(float)
    near, latent = 0, 0
    query = [dict(zip(s.tolist(), w)) for s, w in decontaminate._rows([t for i, t in items if i < 100], idf)]
    for slot, weight in decontaminate._rows(windows, idf):
        row = index.row_of[slot]
        mapped = (weight[row >= 0] @ index.latent[row[row >= 0]]) @ index.item_latent
        exact = np.array([sum(w * q.get(s, 0.0) for s, w in zip(slot.tolist(), weight)) for q in query])
        near += int((exact >= 0.45).sum())
        latent += int(((exact >= 0.45) & (mapped >= 0.44)).sum())
    assert near > 5 and latent >= 0.9 * near


def test_every_item_finds_itself_among_many(spark):
    """More distinct items than the rank: the latent space still holds each of them, and whole copies are found."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    items = [(i, " ".join(rng.sample(words, rng.randint(15, 59)))) for i in range(1000)]
    planted = {i: 25 * i for i in range(40)}
    docs = [(i, " ".join(rng.choices(words, k=80)) + "\n" + (items[planted[i]][1] if i in planted else "") + " " + " ".join(rng.choices(words, k=80))) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.build_indexes(d, b, decontaminate.Settings())
    assert min(np.linalg.norm(x.item_latent, axis=0).min() for x in index) > 0.98
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, index).collect()) == sorted(planted.items())


def test_long_and_short_items_are_found(spark):
    """Copies of items of any length, whole and with a fifth of the words replaced, and of fewer than five words."""
    rng = random.Random(22)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    sizes = [1, 2, 4, 5, 6, 8, 9, 12, 16, 17, 33, 49, 64, 120, 300, 1000, 3000]
    items = [(i, " ".join(f"only{i}" if n == 1 else w for w in rng.sample(words, n))) for i, n in enumerate(sizes)]
    fill = lambda: " ".join(rng.choices(words, k=90))
    docs, planted = [(0, fill()), (1, fill())], []
    for i, (item, text) in enumerate(items):
        changed = [rng.choice(words) if n % 5 == 2 else w for n, w in enumerate(text.split())]
        docs += [(10 + i, f"{fill()} {text} {fill()}"), (100 + i, f"{fill()} {' '.join(changed)} {fill()}"), (200 + i, f"{fill()} {' gap '.join(text.split())} {fill()}")]
        kept = np.mean([x == y for x, y in zip(changed, text.split())])
        planted += [(10 + i, item)] + ([(100 + i, item)] if kept >= (0.8 if sizes[i] >= 5 else 1) else []) + ([(200 + i, item)] if sizes[i] == 1 else [])
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items + [(500, "..."), (501, None)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, decontaminate.build_indexes(d, b, decontaminate.Settings())).collect())
    spread = {(200 + i, i) for i in range(len(sizes)) if sizes[i] >= 5}  # every second word is another: may or may not be near enough
    assert sorted(set(got) - spread) == sorted(planted)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def test_licences_and_inheritance(spark):
    files = [
        ("r/LICENSE", "Released under the MIT License.", 1), ("r/a/x.txt", "some text\nno notice", 2), ("r/a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0.", 3),
        ("r/a/b/c/y.txt", None, 4), ("r/a/b/c/y.txt", None, 4), ("r/z.txt", "words. This work is licensed under the GNU General Public License, version 3. words", 5),
        ("other/q.txt", "", 6), (None, "Released under the MIT License.", 7), (None, None, 8), ("top.txt", "licence of another kind entirely and so on", 9),
    ]
    df = spark.createDataFrame(files, "path string, text string, cosine int")
    got = sorted({(r["path"], r["license"], r["origin"], r["license_dir"]) for r in licenses.scan_licenses(df).collect()}, key=str)
    want = {
        ("r/LICENSE", "MIT", "notice", None), ("r/a/x.txt", "MIT", "inherited", "r"), ("r/a/b/LICENSE.md", "Apache-2.0", "notice", None),
        ("r/a/b/c/y.txt", "Apache-2.0", "inherited", "r/a/b"), ("r/z.txt", "GPL-3.0", "notice", None), ("other/q.txt", None, None, None),
        (None, "MIT", "notice", None), ("top.txt", None, None, None), (None, None, None, None),
    }
    assert licenses.scan_licenses(df).count() == len(files)
    assert set(got) - {(None, None, None, None), (None, "MIT", "notice", None)} == want - {(None, None, None, None), (None, "MIT", "notice", None)}
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_weights_equal_plain_updates_on_one_shard(spark):
    s = quality_ftrl.Settings(shards=1, rounds=1, passes=2, bits=10)
    rows = [(i, f"word{i % 7} plain text{i % 5} {'Good' if i % 3 else 'BAD!!'} end", int(i % 3 > 0)) for i in range(40)]
    got = quality_ftrl.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), s)
    z, n = [0.0] * 1024, [0.0] * 1024

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    order = np.argsort(mix(np.arange(40, dtype=np.uint64)), kind="stable")
    for _ in range(s.passes):
        for i in order:
            x = {}
            for slot, value in zip(*(v.tolist() for v in quality_ftrl.features([rows[i][1]], s.bits)[1:])):
                x[slot] = x.get(slot, 0.0) + value
            w = {slot: weight(slot) for slot in x}
            p = 1 / (1 + math.exp(-sum(w[slot] * v for slot, v in x.items())))
            for slot, v in x.items():
                g = (p - rows[i][2]) * v
                z[slot] += g - (math.sqrt(n[slot] + g * g) - math.sqrt(n[slot])) / s.alpha * w[slot]
                n[slot] += g * g
    assert np.count_nonzero(got) > 10
    assert np.allclose(got, [weight(i) for i in range(1024)], atol=1e-9)
