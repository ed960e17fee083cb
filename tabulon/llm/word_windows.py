"""Repeated word passages: a count-min sketch over all windows, then exact grouping of the windows that it shows repeated.

The sketch has two rows of counters whose width follows the number of windows, so it filters as well at every size.  It is
never whole in one place: each chunk of text counts its own windows per cell, the counts travel to the slice of the sketch
that the cells belong to and are added there, and each chunk is told which of its cells reached two.  A window is repeated
at most if both of its cells did, which loses none.  Those windows alone (and the few that only share cells) are grouped by
their 128-bit fingerprints, again in slices that answer the chunks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import BucketedTables, in_python, pack_strings, per_group, per_pair, prepare_workers, slices, texts, written
from tabulon.llm.texthash import mix

SPACES = [b" ", b"\t", b"\n", b"\v", b"\f", b"\r"]
NO_ID = np.iinfo(np.int64).max  # a document without id comes after all others
CHUNK = 4_000_000  # characters of text that are looked at together
CELLS_PER_WINDOW = 4  # in each of the two rows: about 5 % of the single windows pass
SLICE_CELLS = 1 << 22  # counters of the sketch that are added up together
SLICE_ENTRIES = 1 << 20  # windows of the second pass that are grouped together


def _packed(values: np.ndarray) -> bytes:
    """Ascending numbers as compressed steps."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    flat = np.ascontiguousarray(steps).view(np.uint8).reshape(-1, values.dtype.itemsize)
    return zstandard.compress(np.ascontiguousarray(flat.T).tobytes(), 1)


def _unpacked(raw: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).reshape(-1).cumsum(dtype=kind)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def text_chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """``chunk, ids, ends, data, most``: documents in rows of about ``chunk`` characters, with a bound on the number of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text", chunk):
            data, ends = pack_strings(texts(part.text))
            yield pd.DataFrame({
                "chunk": [uuid.uuid4().int >> 65], "ids": [part.doc_id.to_numpy(np.int64).tobytes()], "ends": [ends.tobytes()],
                "data": [zstandard.compress(data, 3)], "most": [sum(data.count(space) for space in SPACES) + len(part)],
            })

    # the id has to survive as a number, so null is replaced before Arrow makes it a double
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), "text")
    return in_python(rows, run, "chunk long, ids binary, ends binary, data binary, most long")


class Chunk:
    """Words and windows of a chunk; documents in order of their ids."""

    def __init__(self, row):
        data, ends, ids = zstandard.decompress(row.data), np.frombuffer(row.ends, np.int64).tolist(), np.frombuffer(row.ids, np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        # bytes are divided at ASCII white space only: [^\x20\x09-\x0D]+
        self.words = [data[ends[i] : ends[i + 1]].split() for i in self.order]
        self.counts = np.array([len(w) for w in self.words], np.int64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of every window, and its start, counted over all words of the chunk."""
        starts = np.concatenate([[0], np.cumsum(self.counts)])
        flat = [w for words in self.words for w in words]
        place = np.concatenate([np.arange(s, s + max(0, n - size + 1)) for s, n in zip(starts, self.counts)]) if len(self.counts) else np.zeros(0, np.int64)
        if not len(place):
            none = np.zeros(0, np.uint64)
            return none, none, place.astype(np.int64)
        kinds = list(set(flat))
        number = dict(zip(kinds, range(len(kinds))))
        code = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, kinds)), "<u8").reshape(-1, 2)
        weight = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        out = []
        with np.errstate(over="ignore"):
            for half in range(2):
                word = np.ascontiguousarray(digest[:, half])[code]
                n = len(word) - size + 1
                total = np.zeros(n, np.uint64)
                for i in range(size):
                    total += word[i : i + n] * weight[half * size + i]
                out.append(mix(total[place]))
        return out[0], out[1], place


def _cells(half: np.ndarray, width: int) -> np.ndarray:
    return half % np.uint64(width)


def _count(batches: Iterator[pd.DataFrame], size: int, width: int, parts: int) -> Iterator[pd.DataFrame]:
    """What a chunk adds to each slice of the sketch: its cells, and which of them it hits more than once itself."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            high, low, _ = Chunk(row).windows(size)
            out = []
            for line, half in enumerate((high, low)):
                cells, hits = np.unique(_cells(half, width), return_counts=True)
                edges = np.searchsorted(cells, np.arange(parts + 1, dtype=np.uint64) * np.uint64(SLICE_CELLS))
                for p in np.flatnonzero(np.diff(edges)):
                    s = slice(edges[p], edges[p + 1])
                    inside = (cells[s] - np.uint64(p * SLICE_CELLS)).astype(np.uint32)
                    out.append((line * parts + int(p), row.chunk, len(inside), _packed(inside), _bits(hits[s] > 1)))
            yield pd.DataFrame(out, columns=["part", "chunk", "n", "cells", "twice"])


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Add up one slice of the sketch and tell each chunk which of its cells reached two."""
    counts = np.zeros(SLICE_CELLS, np.uint8)  # 0, 1, or 2 for more
    for n, raw, twice in zip(group.n, group.cells, group.twice):
        cells = _unpacked(raw, np.uint32)
        counts[cells] = np.minimum(counts[cells] + 1 + _flags(twice, n), 2)
    replies = [_bits(counts[_unpacked(raw, np.uint32)] > 1) for raw in group.cells]
    return pd.DataFrame({"chunk": group.chunk.to_numpy(), "part": group.part.to_numpy(), "reply": replies})


def _suspects(high: np.ndarray, low: np.ndarray, replies: pd.DataFrame, width: int, parts: int) -> np.ndarray:
    """Windows whose cells both reached two; replies come per slice, in the order of a chunk's distinct cells."""
    keep = np.ones(len(high), bool)
    reply = dict(zip(replies.part, replies.reply))
    for line, half in enumerate((high, low)):
        cells, of = np.unique(_cells(half, width), return_inverse=True)
        edges = np.searchsorted(cells, np.arange(parts + 1, dtype=np.uint64) * np.uint64(SLICE_CELLS))
        full = [_flags(reply[line * parts + p], edges[p + 1] - edges[p]) for p in np.flatnonzero(np.diff(edges)).tolist()]
        if full:
            keep &= np.concatenate(full)[of]
    return keep


def _ask(left: pd.DataFrame, right: pd.DataFrame, size: int, width: int, parts: int, groups: int) -> pd.DataFrame:
    """Second pass over a chunk: its distinct suspects with the smallest document of each, by slice of the fingerprint.

    A row of group -1 keeps for the end where the suspects stand.
    """
    out = []
    for row in left.itertuples(index=False):
        chunk = Chunk(row)
        high, low, place = chunk.windows(size)
        at = np.flatnonzero(_suspects(high, low, right, width, parts)) if len(place) else place
        high, low, place = high[at], low[at].astype(np.uint32), place[at]
        order = np.lexsort((place, low, high))  # places ascend with the document's id
        h, w, p = high[order], low[order], place[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        number = np.empty(len(order), np.uint32)
        number[order] = np.cumsum(fresh) - 1
        out.append((-1, row.chunk, len(at), zstandard.compress(number.tobytes(), 1), _packed(place.astype(np.uint32)), b""))
        h, w, p = h[fresh], w[fresh], p[fresh]
        doc = chunk.ids[np.searchsorted(np.cumsum(chunk.counts), p, side="right")]
        edges = np.concatenate([np.searchsorted(h, _range_starts(groups)), [len(h)]])
        for g in np.flatnonzero(np.diff(edges)):
            s = slice(edges[g], edges[g + 1])
            out.append((int(g), row.chunk, int(edges[g + 1] - edges[g]), _packed(h[s]), w[s].tobytes(), zstandard.compress(doc[s].tobytes(), 1)))
    return pd.DataFrame(out, columns=["grp", "chunk", "n", "high", "low", "doc"])


def _range_starts(groups: int) -> np.ndarray:
    return (np.arange(groups, dtype=object) * (1 << 64) // groups).astype(np.uint64)


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """For each window asked about: whether a smaller document has it."""
    high = np.concatenate([_unpacked(raw, np.uint64) for raw in group.high])
    low = np.concatenate([np.frombuffer(raw, np.uint32) for raw in group.low])
    doc = np.concatenate([np.frombuffer(zstandard.decompress(raw), np.int64) for raw in group.doc])
    order = np.lexsort((doc, low, high))
    h, w, d = high[order], low[order], doc[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    smaller = np.empty(len(order), bool)
    smaller[order] = d > d[fresh][np.cumsum(fresh) - 1]
    ends = np.cumsum(group.n.to_numpy())
    replies = [_bits(smaller[e - n : e]) for e, n in zip(ends, group.n)]
    return pd.DataFrame({"chunk": group.chunk.to_numpy(), "grp": group.grp.to_numpy(), "n": group.n.to_numpy(), "reply": replies})


def _remove(left: pd.DataFrame, right: pd.DataFrame, size: int) -> pd.DataFrame:
    out = []
    answers = right[right.grp >= 0].sort_values("grp")
    known = [_flags(raw, n) for raw, n in zip(answers.reply, answers.n)]
    smaller = np.concatenate(known) if known else np.zeros(0, bool)
    for row in left.itertuples(index=False):
        chunk = Chunk(row)
        ends = np.cumsum(chunk.counts)
        steps = np.zeros(int(chunk.counts.sum()) + 1, np.int64)
        for own in right[right.grp < 0].itertuples(index=False):
            number = np.frombuffer(zstandard.decompress(own.number), np.uint32)
            place = _unpacked(own.place, np.uint32).astype(np.int64)
            document = np.searchsorted(ends, place, side="right")
            # places ascend, so the first one of a window in the chunk lies in the smallest of its documents here
            _, head, of = np.unique(number, return_index=True, return_inverse=True)
            earlier = smaller[number] | (chunk.ids[document] > chunk.ids[document[head]][of])
            # within a document every place but the first repeats an earlier start
            by = np.lexsort((place, document, number))
            again = np.zeros(len(place), bool)
            again[by[1:]] = (number[by[1:]] == number[by[:-1]]) & (document[by[1:]] == document[by[:-1]])
            gone = place[earlier | again]
            np.add.at(steps, gone, 1)
            np.add.at(steps, gone + size, -1)
        removed = np.cumsum(steps[:-1]) > 0
        for i, words in enumerate(chunk.words):
            flags = removed[ends[i] - len(words) : ends[i]]
            kept = b" ".join([w for w, x in zip(words, flags.tolist()) if not x]) if flags.any() else b" ".join(words)
            out.append((int(chunk.ids[i]), kept.decode("utf-8", "replace"), len(words), int(flags.sum()), hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "kept", "n_words", "n_removed", "kept_sha256"])


def remove_repeated_windows(docs: DataFrame, size: int = 20, chunk: int = CHUNK) -> DataFrame:
    """Remove words that an earlier passage already says: ``doc_id, kept, n_words, n_removed, kept_sha256`` per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged, of whole texts (``doc_id, text``; null text: none).  A word is removed if a
    window of ``size`` consecutive words of its document covers it whose words also stand earlier: in a document with a
    smaller doc_id, or further ahead in the same one.  Windows are judged on the given texts and overlap freely.  ``kept`` is
    the other words joined by one space.  A document without doc_id comes after all others; rows of one doc_id are documents
    each, neither smaller than the other.  Shorter texts lose nothing; an empty table gives no rows.  A very long text is a
    chunk of its own.  Windows count as equal when 96 bits of hash agree.

    Chunks are written once, bucketed, so that the texts themselves are never shuffled: only cells, suspects and answers are.
    A chunk sends each distinct cell and each distinct suspect once, so a passage that stands in a third of all documents
    costs its slice one entry per chunk.  Slices are ranges of hash values whose number follows the number of windows.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    tables = BucketedTables(spark, "chunk")
    chunks = tables.write(text_chunks(docs, chunk), "window_chunks")
    total = chunks.agg(F.coalesce(F.sum("most"), F.lit(0))).first()[0]
    parts = max(1, -(-CELLS_PER_WINDOW * total // SLICE_CELLS))
    width, groups = parts * SLICE_CELLS, max(1, total // SLICE_ENTRIES)

    counted = in_python(chunks, lambda batches: _count(batches, size, width, parts), "part int, chunk long, n int, cells binary, twice binary")
    merged = counted.groupBy("part").applyInPandas(per_group(_merge), "chunk long, part int, reply binary")
    text = chunks.select("chunk", "ids", "ends", "data").groupBy("chunk")
    asked = written(text.cogroup(merged.groupBy("chunk")).applyInPandas(
        per_pair(lambda left, right: _ask(left, right, size, width, parts, groups)),
        "grp int, chunk long, n int, high binary, low binary, doc binary"), "window_suspects")
    answered = asked.filter("grp >= 0").groupBy("grp").applyInPandas(per_group(_answer), "chunk long, grp int, n int, reply binary")
    nothing = F.lit(None).cast("binary")
    own = asked.filter("grp < 0").select("chunk", "grp", "n", nothing.alias("reply"), F.col("high").alias("number"), F.col("low").alias("place"))
    both = answered.select("chunk", "grp", "n", "reply", nothing.alias("number"), nothing.alias("place")).union(own)
    done = text.cogroup(both.groupBy("chunk")).applyInPandas(
        per_pair(lambda left, right: _remove(left, right, size)), "doc_id long, kept string, n_words long, n_removed long, kept_sha256 string")
    tables.forget()
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(int(NO_ID))))
