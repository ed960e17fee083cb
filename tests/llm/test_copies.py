"""Repeated passages and similar documents against brute force."""

import random

import pandas as pd
import pytest
import zstandard

from tabulon.llm import ngram_join, repeats
from tabulon.llm.common import pack_strings
from tabulon.llm.components import connected_components
from tests.llm import helpers

import numpy as np


@pytest.mark.parametrize("sizes", [repeats.Sizes(1500, 1, 4), repeats.Sizes(2_000_000, 4, 64)])
def test_removed_bytes_equal_brute_force(spark, sizes):
    docs = helpers.copies()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = repeats.remove_repeats(df, 50, sizes=sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == helpers.repeats(docs, 50)


def test_documents_without_id_and_repeated_rows(spark):
    text = "a passage that is certainly longer than fifty bytes, and then some more of it"
    docs = [(None, text), (4, text), (4, text), (9, "before " + text + " after"), (None, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = repeats.remove_repeats(df, 50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == helpers.repeats(docs, 50)


def test_very_long_text_and_carried_columns(spark):
    docs = [(1, "word %d " * 1 % 7 * 60_000, None, 5), (2, "word 7 " * 30, 'a "quoted"\nvalue', None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, chunk long")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df, 50, carry=["source", "chunk"]).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 210 and bytes(got[2]["kept"]) == b""
    assert (got[1]["source"], got[1]["chunk"], got[2]["source"], got[2]["chunk"]) == (None, 5, 'a "quoted"\nvalue', None)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty, 50).count() == 0
    assert ngram_join.similar_components(empty).count() == 0


def test_anchor_entries_are_dealt_evenly():
    rng = random.Random(7)
    docs = pd.DataFrame({"doc_id": range(40), "text": ["".join(rng.choices("abcdefghij ", k=2000)) for _ in range(40)]})
    data, ends = pack_strings(docs.text)
    places = repeats.anchor_places(np.frombuffer(data, np.uint8), ends, 50)
    row = (1, docs.doc_id.to_numpy(np.int64).tobytes(), ends.tobytes(), zstandard.compress(data), repeats._pack_places(*places))
    chunk = pd.DataFrame([row], columns=["chunk", "ids", "ends", "data", "places"])
    sent = next(repeats._send_entries(iter([chunk]), 50, 16, repeats.Sizes()))
    counts = [len(repeats.expand(g, np.uint64)) for g in sent.gram]
    assert len(counts) == 16 and max(counts) < 1.5 * sum(counts) / 16


def test_suffix_array_and_maximal_repeats():
    data = np.frombuffer(b"xabcabcyabcd", np.uint8)
    group, start, stop = np.zeros(12, int), np.arange(12), np.full(12, 12)
    order, common = repeats.suffix_array(data, group, start, stop)
    suffixes = [bytes(data[i:]) for i in order]
    assert suffixes == sorted(suffixes)
    assert common.tolist()[1:] == [len(__import__("os").path.commonprefix([a, b])) for a, b in zip(suffixes, suffixes[1:])]
    found = {(n, tuple(sorted(at.tolist()))) for n, _, at in repeats.repeats(np.zeros(1, int), data, np.array([0]), np.array([12]), 2)}
    # "bc" occurs at the same places as "abc" one further, so it is not maximal
    assert found == {(3, (1, 4, 8))}


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    docs = helpers.copies(seed=5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(df, width, percent).collect()}
    assert got == helpers.components(docs, width, percent)
    assert len({c for _, c in got.values()}) < len(got)


def test_near_copies_of_one_text_are_not_compared_in_pairs(spark, monkeypatch):
    base = [f"w{i}" for i in range(300)]
    docs = []
    for d in range(80):  # the common origin is neither the smallest nor the largest, and no two copies are similar
        changed = {} if d == 40 else {(i * 75 + d * 7) % 295: f"d{d}x{i}" for i in range(4)}
        docs.append((d, " ".join(changed.get(i, w) for i, w in enumerate(base))))
    pairs, verify = [], ngram_join._verify

    def counting(rows, about, found, width, percent):
        pairs.append(found.count())
        return verify(rows, about, found, width, percent)

    monkeypatch.setattr(ngram_join, "_verify", counting)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(df, 5, 80).collect()}
    assert got == helpers.components(docs, 5, 80)
    assert pairs[1] <= len(docs)


def test_candidates_across_components_pass_at_their_first_common_token(spark):
    located = [(1, r, 20, 0, r) for r in (1, 2, 3)] + [(2, r, 20, 3, r) for r in (1, 2, 4)] + [(3, 5, 20, 2, 5), (3, 6, 24, 0, 5), (3, 7, 23, 3, 7)]
    one = spark.createDataFrame([(r, 20, 0, 0, 0, 0) for r in range(1, 8)], "doc_id long, n long, p0 long, p1 long, p2 long, p3 long")
    df = spark.createDataFrame(located, "token long, rep long, n int, pos int, component long")
    got = sorted(tuple(r) for r in ngram_join._across(df, one, 80).collect())
    # similar sets of 20 and 20 share 18, so not from place 3 on; of 23 and 20 they share 20, which neither holds; of 24 and 23, 21
    assert got == [(1, 2), (1, 3), (2, 3)]


def test_late_links_merge_components(spark):
    parts = spark.createDataFrame([(i, i // 2 * 2) for i in range(10)], "node long, component long")
    late = spark.createDataFrame([(9, 5), (5, 2), (6, 7)], "a long, b long")
    expected = {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6, 7: 6, 8: 2, 9: 2}
    assert {r["node"]: r["component"] for r in ngram_join._merged(parts, late).collect()} == expected
    assert {r["node"]: r["component"] for r in ngram_join._merged(parts, late.limit(0)).collect()} == {i: i // 2 * 2 for i in range(10)}


def test_components_edge_cases(spark):
    words = "one two three four five six seven eight nine ten"
    docs = [(7, words), (7, words), (3, words.upper()), (None, words), (5, ""), (6, None), (8, " \t\n"), (1, "two"), (2, "two"), (4, "Two  ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as token", "1 as n", "2 as component_id")
    got = sorted((tuple(r) for r in ngram_join.similar_components(df, 4, 85).collect()), key=str)
    assert got == sorted([(7, 7, 3), (7, 7, 3), (3, 7, 3), (None, 0, None), (5, 0, 5), (6, 0, 6), (8, 0, 8), (1, 1, 1), (2, 1, 1), (4, 1, 1)], key=str)


def test_connected_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
