"""Exact Jaccard self-join on word n-grams: rare-first prefixes, length, positional and suffix filters, verified once per pair."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Deal, in_pieces, in_python, pack_strings, per_group, per_pair, slices, sum_pieces, texts, written
from tabulon.llm.components import connected_components
from tabulon.llm.repeats import expand, key_cuts, squeeze
from tabulon.llm.texthash import distinct_per_text, lower_ascii, mix, prefix_hash, shingles, span_hash, words

SLICE = 1_000_000
SUFFIX_PARTS = 64
PARITY = ["p0", "p1", "p2", "p3"]  # 256 bits: whether a hash range holds an odd number of n-grams
FILTER_BITS = 21  # size of the filter of documents whose sets are wanted; a fuller filter only sends more sets


def _sets(raw: bytes, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of some texts and the text number of each, in order of text and hash."""
    data = lower_ascii(np.frombuffer(raw, dtype=np.uint8))
    start, end, text = words(data, ends)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, owner, _ = shingles(span_hash(prefix_hash(data), start, end), text, len(ends) - 1, width)
    return distinct_per_text(hashes, owner)


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of consecutive runs."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[cuts[1:]] - total[cuts[:-1]]


def describe_sets(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts, two written tables.

    First ``doc_id, n, hi, lo, parts, p0 .. p3`` per document: ``hi, lo`` identify the set, ``parts`` counts its hashes
    in 64 ranges, ``p0 .. p3`` are the parities of the counts in 256 ranges.  Every n-gram that only one of two sets has
    changes one parity, so sets differ at least as much as their parities.  Second ``chunk, ids, ends, data, n_bytes``:
    the compressed texts, some per row; of equal sets only the first of a task is among them, and no empty ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[tuple[int, int, int]] = set()
        for part in slices(batches, "text", SLICE):
            values = texts(part.text)
            h, owner = _sets(*pack_strings(values), width)
            n = np.bincount(owner, minlength=len(part))
            cuts = np.concatenate([[0], np.cumsum(n)])
            with np.errstate(over="ignore"):
                hi, lo = (_sums(x, cuts).view(np.int64) for x in (mix(h + np.uint64(11)), mix(h ^ np.uint64(0x5BD1E995))))
            ranges = np.bincount(owner * SUFFIX_PARTS + (h & np.uint64(SUFFIX_PARTS - 1)).astype(np.int64), minlength=len(part) * SUFFIX_PARTS)
            ranges = np.minimum(ranges, 255).astype(np.uint8).reshape(len(part), SUFFIX_PARTS)
            odd = np.bincount(owner * 256 + (h >> np.uint64(6) & np.uint64(255)).astype(np.int64), minlength=len(part) * 256).reshape(len(part), 256) & 1
            parity = np.packbits(odd.astype(np.uint8), axis=1).view("<i8")
            ids = part.doc_id.to_numpy(np.int64)
            yield pd.DataFrame({
                "doc_id": ids, "n": n, "hi": hi, "lo": lo, "parts": [r.tobytes() for r in ranges],
                **{c: parity[:, i] for i, c in enumerate(PARITY)}, **dict.fromkeys(["chunk", "ids", "ends", "data", "n_bytes"]),
            })
            fresh = []
            for i, same in enumerate(zip(n.tolist(), hi.tolist(), lo.tolist())):
                if same[0] and same not in known:
                    known.add(same)
                    fresh.append(i)
            if fresh:
                data, ends = pack_strings(values[i] for i in fresh)
                yield pd.DataFrame({
                    **dict.fromkeys(["doc_id", "n", "hi", "lo", "parts", *PARITY]), "chunk": [uuid.uuid4().int >> 65],
                    "ids": [ids[fresh].tobytes()], "ends": [ends.tobytes()], "data": [zstandard.compress(data, 3)], "n_bytes": [len(data)],
                })

    made = written(in_python(docs, run, "doc_id long, n long, hi long, lo long, parts binary, p0 long, p1 long, p2 long, p3 long, "
                             "chunk long, ids binary, ends binary, data binary, n_bytes long"), "ngram_sets")
    return (made.filter("chunk is null").select("doc_id", "n", "hi", "lo", "parts", *PARITY),
            made.filter("chunk is not null").select("chunk", "ids", "ends", "data", "n_bytes"))


def _chunk_keys(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (the first 48 bits of the hashes) of a chunk's sets and the text number of each."""
    h, owner = _sets(zstandard.decompress(row.data), np.frombuffer(row.ends, np.int64), width)
    return h >> np.uint64(16) << np.uint64(16), owner


def _send_keys(batches: Iterator[pd.DataFrame], width: int, buckets: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            key, times = np.unique(_chunk_keys(row, width)[0], return_counts=True)
            cut, out = key_cuts(key, buckets), []
            for b in np.flatnonzero(np.diff(cut)):
                s = slice(cut[b], cut[b + 1])
                out.append((int(b), row.chunk, squeeze(np.diff(key[s], prepend=np.uint64(0))), squeeze(times[s].astype(np.uint32))))
            yield pd.DataFrame(out, columns=["bucket", "chunk", "key", "times"])


def _answer_keys(group: pd.DataFrame) -> pd.DataFrame:
    """For each key sent, in how many of all sets it is."""
    parts = [expand(k, np.uint64).cumsum(dtype=np.uint64) for k in group.key]
    _, number = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(number, weights=np.concatenate([expand(t, np.uint32) for t in group.times]))
    back = np.minimum(total[number], np.iinfo(np.uint32).max).astype(np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    return pd.DataFrame({"chunk": group.chunk.to_numpy(), "bucket": group.bucket.to_numpy(),
                         "reply": [squeeze(back[e - len(p) : e]) for e, p in zip(ends, parts)]})


def _chunk_prefixes(left: pd.DataFrame, right: pd.DataFrame, width: int, percent: int) -> pd.DataFrame:
    out = [pd.DataFrame({"token": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int32), "pos": np.zeros(0, np.int32)})]
    counts = np.concatenate([np.zeros(0, np.uint32), *(expand(r, np.uint32) for r in right.sort_values("bucket").reply)])
    for row in left.itertuples(index=False):
        key, owner = _chunk_keys(row, width)
        _, number = np.unique(key, return_inverse=True)
        if len(key) and number.max() + 1 != len(counts):
            raise RuntimeError("answers do not fit the chunk")
        sets = counts[number]
        order = np.lexsort((key, sets, owner))
        key, owner, sets = key[order], owner[order], sets[order]
        ids = np.frombuffer(row.ids, np.int64)
        n = np.bincount(owner, minlength=len(ids))
        pos = np.arange(len(key)) - (np.cumsum(n) - n)[owner]
        taken = (pos < (n - -(-percent * n // 100) + 1)[owner]) & (sets > 1)
        out.append(pd.DataFrame({"token": key[taken].view(np.int64), "doc_id": ids[owner[taken]],
                                 "n": n[owner[taken]].astype(np.int32), "pos": pos[taken].astype(np.int32)}))
    return pd.concat(out)


def prefixes(chunks: DataFrame, width: int, percent: int) -> DataFrame:
    """Written table ``token, doc_id, n, pos``: each set's first n - ceil(percent * n / 100) + 1 keys in the global order.

    The order is by the exact number of sets that hold a key, then by key.  Two sets that are similar enough share one
    of the keys; keys of one set only are counted in ``pos``, but not sent.  Chunks ask buckets of keys for the numbers,
    each key once, so a frequent n-gram costs its bucket one entry per chunk.
    """
    deal = Deal.of(chunks.sparkSession, chunks.agg(F.sum("n_bytes")).first()[0] or 0)
    asked = in_python(chunks.select("chunk", "ends", "data"), lambda batches: _send_keys(batches, width, deal.buckets),
                      "bucket int, chunk long, key binary, times binary")
    counted = written(deal.by(asked, "bucket").groupBy("bucket").applyInPandas(per_group(_answer_keys), "chunk long, bucket int, reply binary"), "ngram_counts")
    by_chunk = lambda df: deal.by(df, "chunk").groupBy("chunk")
    made = by_chunk(chunks.drop("n_bytes")).cogroup(by_chunk(counted)).applyInPandas(
        per_pair(lambda left, right: _chunk_prefixes(left, right, width, percent)), "token long, doc_id long, n int, pos int")
    return written(made, "ngram_keys")


def _length_fits(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verify(docs: DataFrame, about: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct ``a, b`` the pairs whose sets are similar enough, as edges ``a, b``.

    The length filter and the suffix filter come first: the difference of the counts per hash range cannot
    exceed what two similar sets may differ by.  Then the sets of the documents that are left are made again
    from their texts, and every pair is counted once.
    """
    side = lambda c: about.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("parts").alias(f"parts{c}"))

    def suffix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, SUFFIX_PARTS).astype(np.int64) for c in ("partsa", "partsb"))
                both = (batch.na + batch.nb).to_numpy(np.int64)
                least = -(-percent * both // (100 + percent))  # smallest intersection of similar sets
                yield batch[np.abs(x - y).sum(axis=1) <= both - 2 * least][["a", "b"]]

    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(_length_fits("na", "nb", percent))
    left = written(in_python(sized, suffix, "a long, b long"), "ngram_pairs")
    wanted = left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().select(
        "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).cast("int").alias("slot"))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.zeros(1 << FILTER_BITS, dtype=np.uint8)
        for batch in batches:
            marks[batch.slot.to_numpy()] = 1
        yield in_pieces(marks)

    wanted_marks = sum_pieces(in_python(wanted.select("slot"), mark, "piece int, counts binary"), 1 << FILTER_BITS) > 0
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted_marks))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in slices(iter([batch[marks[batch.slot.to_numpy()]]]), "text", SLICE):
                h, owner = _sets(*pack_strings(texts(part.text)), width)
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                yield pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "set": [h[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(part))]})

    slotted = docs.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).cast("int"))
    made = in_python(slotted, sets, "doc_id long, set binary")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch.seta, batch.setb):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[np.array(good, dtype=bool), ["a", "b"]]

    of = lambda c: made.select(F.col("doc_id").alias(c), F.col("set").alias(f"set{c}"))
    return written(in_python(left.join(of("b"), "b").join(of("a"), "a"), count, "a long, b long"), "ngram_edges")


def _across(located: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """Distinct ``a, b`` of different components that share a token (``located``: token, rep, n, pos, component) and pass all filters.

    Similar sets are found at the first token of the global order that both have: nothing before it is common, so from there
    on each must hold as many n-grams as similar sets share.  A pair that passes at no token is not similar.  One of the
    two is outside of the component that most of the token's group belongs to, so a group in which nearly all are
    linked costs comparisons in proportion to its members.
    """
    sizes = located.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("most"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    open_groups = located.join(mixed.select("token", F.col("most.component").alias("main")), "token").join(
        one.select(F.col("doc_id").alias("rep"), *PARITY), "rep")
    x, y = (open_groups.select("token", "main", F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("pos").alias(f"pos{c}"),
                               F.col("component").alias(f"component{c}"), *[F.col(p).alias(f"{p}{c}") for p in PARITY]) for c in "ab")
    both = F.col("na") + F.col("nb")
    least = F.ceil(percent * both / (100 + percent) - F.lit(1e-9))  # smallest intersection of similar sets
    room = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    differ = sum((F.bit_count(F.col(f"{p}a").bitwiseXOR(F.col(f"{p}b"))) for p in PARITY), F.lit(0))
    once = (F.col("componentb") == F.col("main")) | (F.col("componenta") < F.col("componentb"))
    return (
        x.filter("componenta <> main").join(y.drop("main"), "token")
        .filter((F.col("componenta") != F.col("componentb")) & once & _length_fits("na", "nb", percent) & (room >= least) & (differ <= both - 2 * least))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )


def _merged(parts: DataFrame, late: DataFrame) -> DataFrame:
    """``node, component`` after edges ``a, b`` between nodes were added to the components ``parts``."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"component{c}"))
    joined = late.join(of("a"), "a").join(of("b"), "b").filter("componenta <> componentb")
    moved = connected_components(joined.select(F.col("componenta").alias("a"), F.col("componentb").alias("b")))
    return parts.join(moved.select(F.col("node").alias("component"), F.col("component").alias("smallest")), "component", "left").select(
        "node", F.coalesce("smallest", "component").alias("component"))


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``).

    Words are runs of other than ASCII white space, ASCII letters in lower case; a set holds the distinct runs of
    ``width`` words, or the whole sequence if there are fewer.  Two documents link when 100 * intersection >=
    percent * union; an empty set links with nothing.  ``component_id`` is the smallest doc_id reachable by links.
    Rows without doc_id take no part and get a null component; rows that repeat a doc_id are one document (they
    share a component).  An empty table gives no rows.

    Equal sets are found by a 128-bit hash of the set.  For the others, documents whose prefixes share a token are
    candidates.  First each is compared with three documents of the token's group, the smallest, the largest and the one
    with the fewest rarer n-grams, so a large group costs as many pairs as it has members; then, in the groups that still
    hold more than one component, the pairs across components.  No candidate is left out: a pair within a component needs no comparison.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    about, chunks = describe_sets(rows, width)
    described = about.filter("n > 0")
    first = described.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep"))
    equal = written(described.select("doc_id", "n", "hi", "lo").join(first, ["n", "hi", "lo"]).select("doc_id", "rep"), "ngram_classes")
    entry = prefixes(chunks, width, percent)
    groups = entry.groupBy("token").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min_by("doc_id", F.struct("pos", "doc_id")).alias("core"))
    shared = written(entry.join(groups.filter("low < high"), "token"), "ngram_prefixes")
    rep = lambda c: equal.select(F.col("doc_id").alias(c), F.col("rep").alias(f"rep{c}"))

    def between_classes(pairs: DataFrame) -> DataFrame:
        """Pairs of documents as distinct pairs of class representatives."""
        found = pairs.distinct().join(rep("a"), "a").join(rep("b"), "b")
        return found.filter("repa <> repb").select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b")).distinct()

    stars = shared.select(F.col("doc_id").alias("a"), F.explode(F.array("low", "high", "core")).alias("b")).filter("a <> b")
    star_pairs = written(between_classes(stars), "ngram_stars")
    one = about.join(equal.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n", "parts", *PARITY).dropDuplicates(["doc_id"])
    one = written(one, "ngram_representatives")
    edges = _verify(rows, one, star_pairs, width, percent)
    same = equal.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    parts = written(connected_components(edges.union(same)), "ngram_parts")
    located = shared.select("token", "doc_id", "n", "pos").join(
        parts.select(F.col("node").alias("doc_id"), "component"), "doc_id").join(equal, "doc_id")
    located = written(located.groupBy("token", "rep", "n", "pos").agg(F.min("component").alias("component")), "ngram_located")
    across = _across(located, one, percent)
    late = _verify(rows, one, across.join(star_pairs, ["a", "b"], "left_anti"), width, percent)
    final = _merged(parts, late)
    lonely = docs.filter("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    per_doc = about.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return per_doc.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).union(lonely)
