"""Centroid clustering, spelling variants and repeated word windows against brute force, with nulls, ties, copies and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabulon.llm import centroids, spelling, word_windows
from tests.llm import helpers


def lloyd(rows, k, rounds, scale, seed):
    """Plain Lloyd rounds over (id, vector) rows, every vector against every centroid."""
    x = np.array([[int(np.floor(np.float64(c) * scale)) for c in v] for _, v in rows], np.int64)
    key = lambda i: (rows[i][0] is None, hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest(), x[i].tolist())
    c = x[sorted(range(len(rows)), key=key)[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if r < rounds:
            for j in set(own.tolist()):
                c[j] = x[own == j].sum(axis=0) // (own == j).sum()
    return sorted(((rows[i][0], int(own[i]), int(d[i, own[i]])) for i in range(len(rows))), key=str), c


def vectors(n, seed, groups=6, width=8):
    rng = random.Random(seed)
    middles = [[rng.uniform(-3, 3) for _ in range(width)] for _ in range(groups)]
    return [(i, [float(np.float32(m + rng.gauss(0, 0.2))) for m in middles[i % groups]]) for i in range(n)]


@pytest.mark.parametrize(("k", "rounds", "rows"), [(6, 8, vectors(400, 1)), (1, 3, vectors(30, 2)), (9, 5, vectors(5, 3)), (3, 0, vectors(20, 4))])
def test_clusters_equal_plain_rounds(spark, k, rounds, rows):
    df = spark.createDataFrame(rows, "vec_id long, v array<float>").repartition(3)
    done = centroids.cluster_vectors(df, "vec_id", "v", k=k, rounds=rounds, width=8, block_rows=32)
    want, c = lloyd(rows, k, rounds, 256, 2)
    assert sorted((tuple(r) for r in done.rows.collect()), key=str) == want
    assert (done.centroids == c).all()


def test_held_leads_are_not_scanned(spark):
    rows = vectors(600, 5)
    done = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, v array<float>"), "vec_id", "v", k=8, rounds=12, width=8, block_rows=64)
    assert done.scanned[0] == 600 and min(done.scanned[1:]) < 300
    assert sorted((tuple(r) for r in done.rows.collect()), key=str) == lloyd(rows, 8, 12, 256, 2)[0]


def test_clusters_of_odd_tables(spark):
    a, b = [0.5] * 4, [-0.5, 2.0, 0.0, 1.0]
    rows = [(1, a, 9), (1, a, 9), (2, b, 9), (None, b, 9), (3, [0.0] * 3, 9), (4, None, 9), (5, [0.0, None, 0.0, 0.0], 9), (6, [float("nan")] * 4, 9),
            (7, [float("inf")] * 4, 9)] + [(8, a, 9)] * 40
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, cluster int").withColumnsRenamed({"cluster": "block"})
    done = centroids.cluster_vectors(df, "vec_id", "v", k=5, rounds=3, width=4)
    kept = [(i, v) for i, v, _ in rows if i in (1, 2, 8, None)]
    assert sorted((tuple(r) for r in done.rows.collect()), key=str) == lloyd(kept, 5, 3, 256, 2)[0]
    facts = centroids.with_inertia(done).collect()
    assert {r["inertia"] for r in facts} == {sum(r["distance"] for r in facts)} and len(facts) == len(kept)
    none = centroids.cluster_vectors(df.filter("vec_id = 3"), "vec_id", "v", k=5, rounds=3, width=4)
    assert none.rows.count() == 0 and centroids.with_inertia(none).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9])], "i long, v array<float>"), "i", "v", width=1)


def test_wide_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-(2**27), 2**27)) for _ in range(3)]) for i in range(50)]
    done = centroids.cluster_vectors(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v", k=4, rounds=4, width=3, scale=1)
    assert sorted((tuple(r) for r in done.rows.collect()), key=str) == lloyd(rows, 4, 4, 1, 2)[0]


def variants(docs, length, ratio, drop):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % drop == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= length and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(found[w]), n.get(form[w]))
    return out


def spelled(spark, docs, **settings):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as form")
    rows = spelling.spelling_variants(df, **settings).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("symbols", [2, 5, 8])
def test_variants_equal_brute_force(spark, symbols):
    rng = random.Random(symbols)
    docs = []
    for i in range(60):
        words = []
        for _ in range(40):
            w = list(rng.choice(["abcabca", "bcabcabc", "ÀÈabcÿ×÷", "aaaaaaa", "abababab", "ßöüabca"]))
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "B", "c", "é", "È"])
            words.append("".join(w))
        docs.append((i, rng.choice([" ", "\n", "3", "Ā", "_"]).join(words)))
    docs += [(None, "abcabca abcabca"), (7, None), (8, ""), (8, "aaaaaaa " * 3000), (8, "aaaaaaa " * 3000), (9, "\U0001f600" * 50)]
    got = spelled(spark, docs, symbols=symbols, drop_one_in=5)
    assert got == variants(docs, 7, 10, 5)


def test_chains_of_forms_end_at_the_last(spark):
    counts = {"abcdefgh": 20000, "abcdefgx": 1500, "abcdefyx": 120, "abcdezyx": 10, "abcdezyq": 2, "abcdezyy": 10}
    docs = [(1, " ".join(w for w, n in counts.items() for _ in range(n)))]
    got = spelled(spark, docs, drop_one_in=10**12)
    assert got == variants(docs, 7, 10, 10**12)
    assert got["abcdezyx"][1] == "abcdefgh" and got["abcdezyq"] == (None, "abcdezyq", 2, 2, None)
    assert spelled(spark, [(1, "no long ones")]) == {} and spelled(spark, []) == {}
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), ratio=1)


def windows(docs, size):
    """What remove_repeated_windows must return, by a dictionary of all windows."""
    key = lambda d: (d is None, d or 0)
    split = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, key(d)), key(d))
    out = []
    for d, w in split:
        gone, seen = [False] * len(w), set()
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if first[k] < key(d) or k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, kept.decode(), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cleaned(spark, docs, size, **settings):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as chunk", "2 as n").repartition(3)
    return sorted((tuple(r) for r in word_windows.remove_repeated_windows(df, size, **settings).collect()), key=str)


@pytest.mark.parametrize(("size", "chunk"), [(20, 4_000_000), (5, 300), (1, 2000)])
def test_removed_words_equal_brute_force(spark, size, chunk):
    docs = helpers.copies(size)
    assert cleaned(spark, docs, size, chunk=chunk) == windows(docs, size)


def test_removed_words_with_small_slices(spark, monkeypatch):
    docs = helpers.copies(11)
    monkeypatch.setattr(word_windows, "SLICE_ENTRIES", 50)
    assert cleaned(spark, docs, 4, chunk=500) == windows(docs, 4)


def test_windows_of_odd_tables(spark):
    long = " ".join(f"w{i % 700}" for i in range(5000))
    docs = [(None, long), (None, "a b c d e"), (2**53 + 1, long), (2**53, "a b \x1c c\x0bd e"), (5, None), (6, ""), (6, "a b c d e"), (6, "a b c d e"),
            (-3, "x x x x x x x x"), (2**62, " ".join(["word"] * 3000))]
    for chunk in (100, 10**6):
        got = cleaned(spark, docs, 3, chunk=chunk)
        assert got == windows(docs, 3)
    assert cleaned(spark, [], 3) == []
    assert cleaned(spark, [(1, None)], 3) == [(1, "", 0, 0, hashlib.sha256(b"").hexdigest())]
