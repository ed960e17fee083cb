"""Repeated passages across documents: anchored suffix groups, enhanced suffix arrays and maximal repeats.

A suffix array over all suffixes of a large corpus does not fit anywhere, and sorting all of them moves the corpus many
times.  So suffixes are first grouped by an anchor: of all substrings of ``GRAM`` bytes in a window of ``size`` bytes the
one with the smallest hash.  Equal windows have the same anchor at the same place, hence every repeat of ``size`` bytes
lies within the groups of its anchors.  A group in which all occurrences agree on the whole anchored block is one repeat
without diversity to either side and needs no sorting.  Where contexts differ, the contexts' suffixes are sorted, their
common prefixes computed, and a stack scan over the common-prefix interval tree gives the maximal repeats with all
their occurrences.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Deal, in_python, pack_strings, per_group, per_pair, prepare_workers, slices, texts, written
from tabulon.llm.texthash import mix, prefix_hash, span_hash

GRAM = 20  # longer ones mean more anchors, shorter ones more chance agreement that has to be looked into
NO_ID = np.iinfo(np.int64).max  # a document without id comes after all others


@dataclass(frozen=True)
class Sizes:
    """``chunk``: bytes of text that are looked at together.  The other two decide which way the windows of an anchor are
    compared, not what is found: an anchor with more distinct blocks in a chunk, or in all, is split by window."""

    chunk: int = 1_000_000
    blocks_here: int = 4
    blocks: int = 64


# --- chunks -----------------------------------------------------------------------------------------------------------


def text_chunks(docs: DataFrame, sizes: Sizes, size: int) -> DataFrame:
    """Written table ``chunk, ids, ends, data, places, n_bytes, rest``: the UTF-8 bytes of about ``sizes.chunk`` bytes of documents
    per row, compressed, and where their anchors are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text", sizes.chunk):
            data, ends = pack_strings(texts(part.text))
            ids = part.doc_id.fillna(NO_ID).to_numpy(np.int64)
            places = anchor_places(np.frombuffer(data, np.uint8), ends, size)
            yield pd.DataFrame({
                "chunk": [uuid.uuid4().int >> 65], "ids": [ids.tobytes()], "ends": [ends.tobytes()], "data": [zstandard.compress(data, 3)],
                "places": [_pack_places(*places)], "n_bytes": [len(data)], "rest": ["\n".join(part._rest)],
            })

    # the id has to survive as a number, so null is replaced before Arrow makes it a double
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), "text", "_rest")
    return written(in_python(rows, run, "chunk long, ids binary, ends binary, data binary, places binary, n_bytes long, rest string"), "text_chunks")


@dataclass
class Chunk:
    data: np.ndarray
    ids: np.ndarray
    ends: np.ndarray
    places: tuple[np.ndarray, np.ndarray, np.ndarray]

    @staticmethod
    def of(row) -> Chunk:
        data = np.frombuffer(zstandard.decompress(row.data), np.uint8)
        return Chunk(data, np.frombuffer(row.ids, np.int64), np.frombuffer(row.ends, np.int64), _unpack_places(row.places))


@dataclass
class Anchors:
    """Per anchor occurrence: its key, the hash of its block, the first and last window start, and the document's id.

    Anchors are the smallest hashes of their windows, so the key is another mix: buckets are equal ranges of keys.
    """

    gram: np.ndarray
    block: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    doc: np.ndarray


def anchor_places(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor occurrence the first and last window start and the anchor's place, in order."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < size:
        return none, none, none
    running = prefix_hash(data)
    place = np.arange(len(data) - GRAM + 1)
    best = span_hash(running, place, place + GRAM)
    best >>= np.uint64(32)
    best <<= np.uint64(32)
    best |= place.astype(np.uint64)
    width, step = size - GRAM + 1, 1
    while 2 * step <= width:
        best = np.minimum(best[: len(best) - step], best[step:])
        step *= 2
    if width > step:
        best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    spans = np.maximum(np.diff(ends) - size + 1, 0)  # windows of each text
    start = np.repeat(ends[:-1], spans) + _within(spans)
    if not len(start):
        return none, none, none
    at = (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = at[1:] != at[:-1]
    fresh[np.cumsum(spans)[:-1][np.cumsum(spans)[:-1] < len(start)]] = True
    head = np.flatnonzero(fresh)
    tail = np.concatenate([head[1:], [len(start)]]) - 1
    return start[head], start[tail], at[head]


def _pack_places(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> bytes:
    steps = [np.diff(first, prepend=0), last - first, at - first]
    return squeeze(np.concatenate(steps).astype(np.int32)) if len(first) else b""


def _unpack_places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not raw:
        return (np.zeros(0, dtype=np.int64),) * 3
    step, last, at = expand(raw, np.int32).astype(np.int64).reshape(3, -1)
    first = np.cumsum(step)
    return first, first + last, first + at


def anchors(chunk: Chunk, size: int) -> Anchors:
    first, last, at = chunk.places
    running = prefix_hash(chunk.data)
    block = mix(span_hash(running, first, last + size) + (at - first).astype(np.uint64)).astype(np.uint32)
    text = np.searchsorted(chunk.ends, first, side="right") - 1
    return Anchors(mix(span_hash(running, at, at + GRAM)), block, first, last, at, chunk.ids[text])


@dataclass
class Entries:
    """Distinct (anchor, block) of a chunk in order, with the smallest document that holds each.

    An anchor with many blocks in the chunk has one entry for all of them (``many``).  ``of`` is the entry of
    each anchor occurrence, ``sample`` an occurrence per entry that lies in the smallest document.
    """

    gram: np.ndarray
    block: np.ndarray
    doc: np.ndarray
    many: np.ndarray
    of: np.ndarray
    sample: np.ndarray


def entries(a: Anchors, sizes: Sizes) -> Entries:
    order = np.lexsort((a.block, a.gram))
    gram, block = a.gram[order], a.block[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = gram[1:] != gram[:-1]
    group = np.cumsum(new) - 1
    distinct = new.copy()
    distinct[1:] |= block[1:] != block[:-1]
    kinds = np.bincount(group[distinct], minlength=group[-1] + 1 if len(group) else 0)
    many = kinds[group] > sizes.blocks_here if len(group) else np.zeros(0, bool)
    start = np.where(many, new, distinct)
    entry = np.cumsum(start) - 1
    of = np.empty(len(order), dtype=np.int64)
    of[order] = entry
    low = np.lexsort((a.doc, of))
    first = np.ones(len(low), dtype=bool)
    first[1:] = of[low][1:] != of[low][:-1]
    sample = low[first]
    head = np.flatnonzero(start)
    return Entries(gram[head], np.where(many[head], 0, block[head]).astype(np.uint32), a.doc[sample], many[head], of, sample)


# --- sending arrays ------------------------------------------------------------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of numbers, equal bytes of all numbers together."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return zstandard.compress(np.ascontiguousarray(flat.T).tobytes(), 1)


def expand(raw: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).reshape(-1)


def key_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted 64-bit keys change from one bucket (an equal range of keys) to the next."""
    edges = (np.arange(buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])


COVERED, MIXED, HOT = 1, 2, 4


def _send_entries(batches: Iterator[pd.DataFrame], size: int, buckets: int, sizes: Sizes) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            e = entries(anchors(Chunk.of(row), size), sizes)
            cut, out = key_cuts(e.gram, buckets), []
            for b in np.flatnonzero(np.diff(cut)):
                s = slice(cut[b], cut[b + 1])
                step = np.diff(e.gram[s], prepend=np.uint64(0))
                out.append((int(b), row.chunk, squeeze(step), squeeze(e.block[s]), squeeze(e.doc[s]), np.packbits(e.many[s]).tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "chunk", "gram", "block", "doc", "many"])


def _answer_entries(group: pd.DataFrame, sizes: Sizes) -> pd.DataFrame:
    """For each entry sent: whether a smaller document holds the same block, whether the anchor has other blocks, whether it has very many."""
    parts = [expand(g, np.uint64).cumsum(dtype=np.uint64) for g in group.gram]
    counts = [len(p) for p in parts]
    gram = np.concatenate(parts)
    block = np.concatenate([expand(b, np.uint32) for b in group.block])
    doc = np.concatenate([expand(d, np.int64) for d in group.doc])
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(group.many, counts)]).astype(bool)
    order = np.lexsort((doc, block, gram))
    g, b, d = gram[order], block[order], doc[order]
    new_gram = np.ones(len(g), dtype=bool)
    new_gram[1:] = g[1:] != g[:-1]
    new_block = new_gram.copy()
    new_block[1:] |= b[1:] != b[:-1]
    by_gram, by_block = np.cumsum(new_gram) - 1, np.cumsum(new_block) - 1
    kinds = np.bincount(by_gram[new_block])
    split = np.bincount(by_gram, weights=many[order]) > 0
    hot = split | (kinds > sizes.blocks)
    mixed = split | (kinds > 1)
    lowest = d[new_block][by_block]
    flags = np.where((d > lowest) & ~split[by_gram], COVERED, 0) | np.where(mixed[by_gram], MIXED, 0) | np.where(hot[by_gram], HOT, 0)
    back = np.empty(len(g), dtype=np.uint8)
    back[order] = flags
    ends = np.cumsum(counts)
    return pd.DataFrame({
        "chunk": group.chunk.to_numpy(), "bucket": group.bucket.to_numpy(), "reply": [zstandard.compress(back[e - n : e].tobytes(), 1) for e, n in zip(ends, counts)],
    })


def _flags(answers: pd.DataFrame, n: int) -> np.ndarray:
    if not len(answers):
        return np.zeros(n, dtype=np.uint8)
    out = np.frombuffer(b"".join(zstandard.decompress(f) for f in answers.sort_values("bucket").reply), np.uint8)
    if len(out) != n:
        raise RuntimeError("answers do not fit the chunk")
    return out


# --- the enhanced suffix array of contexts --------------------------------------------------------------------------------


@dataclass
class Contexts:
    """What is to be compared, in order of key: pieces of text, or single windows (``length`` 0) of which two hashes are enough."""

    key: np.ndarray
    check: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray

    def windows(self, size: int) -> np.ndarray:
        return _windows(self.length, size)


def _windows(length: np.ndarray, size: int) -> np.ndarray:
    return np.where(length > 0, length - size + 1, 1)


def open_contexts(chunk: Chunk, a: Anchors, e: Entries, flags: np.ndarray, size: int) -> tuple[Contexts, np.ndarray, np.ndarray]:
    """What a chunk still has to compare after the first answer, and how its windows relate to that.

    The block of each entry with other blocks beside it goes under its anchor's key; windows of an anchor with very
    many blocks go one by one under their own keys, once per distinct window.  Second and third result: for each
    window of each undecided occurrence the window's start and the number of the (context, window) that answers for it.
    """
    undecided = (flags & MIXED > 0) & (flags & COVERED == 0)
    hot = undecided & (flags & HOT > 0)
    whole = np.flatnonzero(undecided & ~hot)
    o = e.sample[whole]
    key, start, length, doc = e.gram[whole], a.first[o], a.last[o] - a.first[o] + size, a.doc[o]
    picked = np.flatnonzero(hot[e.of])
    spans = a.last[picked] - a.first[picked] + 1
    w_start = np.repeat(a.first[picked], spans) + _within(spans)
    w_doc = np.repeat(a.doc[picked], spans)
    w_key = span_hash(prefix_hash(chunk.data), w_start, w_start + size)
    w_check = span_hash(prefix_hash(chunk.data[::-1]), len(chunk.data) - w_start - size, len(chunk.data) - w_start).astype(np.uint32)
    order = np.lexsort((w_doc, w_check, w_key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (w_key[order][1:] != w_key[order][:-1]) | (w_check[order][1:] != w_check[order][:-1])
    lead = order[new]
    keys = np.concatenate([key, w_key[lead]])
    starts = np.concatenate([start, w_start[lead]])
    checks = np.concatenate([np.zeros(len(key), np.uint32), w_check[lead]])
    lengths = np.concatenate([length, np.zeros(len(lead), np.int64)])
    docs = np.concatenate([doc, w_doc[lead]])
    sent = np.lexsort((docs, checks, keys))
    contexts = Contexts(keys[sent], checks[sent], starts[sent], lengths[sent], docs[sent])
    base = np.empty(len(sent), dtype=np.int64)  # number of the first window of each context, as sent
    base[sent] = np.concatenate([[0], np.cumsum(contexts.windows(size))[:-1]])
    # windows of undecided occurrences in the entry's smallest document
    number = np.full(len(e.gram), -1)
    number[whole] = np.arange(len(whole))
    own = np.flatnonzero((number[e.of] >= 0) & (a.doc == e.doc[e.of]))
    own_spans = a.last[own] - a.first[own] + 1
    p_start = np.repeat(a.first[own], own_spans) + _within(own_spans)
    p_answer = np.repeat(base[number[e.of[own]]], own_spans) + _within(own_spans)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    smallest = w_doc == w_doc[lead][back] if len(lead) else np.zeros(0, bool)
    q_answer = np.where(smallest, base[len(whole) + back] if len(lead) else 0, -1)
    return contexts, np.concatenate([p_start, w_start]), np.concatenate([p_answer, q_answer])


def _within(spans: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of several runs."""
    total = np.concatenate([[0], np.cumsum(spans)])
    return np.arange(total[-1]) - np.repeat(total[:-1], spans)


@dataclass
class Interval:
    """A maximal repeat: ``length`` bytes at the suffixes ``low .. high`` (inclusive) of the suffix array."""

    length: int
    low: int
    high: int


def suffix_array(data: np.ndarray, group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``data[start:stop]`` by group and bytes, and the common prefix of each with the one before.

    A suffix that is a beginning of another comes first; suffixes of different groups have no common prefix.
    """
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = stop - start
    longest = int(size.max())
    padded = np.concatenate([data, np.zeros(longest, dtype=np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, longest)[start]
    rows[np.arange(longest)[None, :] >= size[:, None]] = 0
    order = np.lexsort((size, rows.view(f"S{longest}").reshape(-1), group))
    rows, size, group = rows[order], size[order], group[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
    common = np.where(group[1:] == group[:-1], np.minimum(common, np.minimum(size[1:], size[:-1])), 0)
    return order, np.concatenate([[0], common])


def maximal_intervals(common: np.ndarray, left: np.ndarray, size: int) -> list[Interval]:
    """Stack scan over common prefixes of at least ``size``: the intervals whose occurrences differ (or end) to the left.

    ``left`` is the byte before each suffix in order, or -1 where its context begins, which differs from every other.
    """
    changes = np.ones(len(left), dtype=np.int64)
    changes[1:] = (left[1:] != left[:-1]) | (left[1:] < 0)
    changes = np.cumsum(changes).tolist()
    starts = (left < 0).tolist()
    deep = common >= size
    # only suffixes with a close neighbour, and the end of each such run, matter to the scan
    wanted = np.flatnonzero(deep | np.concatenate([[False], deep[:-1]]))
    if len(wanted) and deep[-1]:
        wanted = np.concatenate([wanted, [len(common)]])
    depth = np.concatenate([np.where(deep, common, 0), [0]])[wanted].tolist()
    found: list[Interval] = []
    stack: list[tuple[int, int]] = []  # common prefix, first suffix
    for i, now in zip(wanted.tolist(), depth):
        low = i - 1
        while stack and stack[-1][0] > now:
            length, low = stack.pop()
            if changes[i - 1] != changes[low] or starts[low]:
                found.append(Interval(length, low, i - 1))
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, low))
    return found


SUFFIXES = 40_000  # suffixes that are sorted at once (whole groups)


def repeats(group: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, size: int):
    """Maximal repeats of at least ``size`` bytes within each group of contexts.

    Yields the length, the contexts and the places in them of all occurrences.  Groups are sorted some at a time.
    """
    order = np.argsort(group, kind="stable")
    windows = length - size + 1
    done = np.concatenate([[0], np.cumsum(windows[order])])
    edges = np.concatenate([np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])), [len(order)]])
    low = 0
    while low < len(edges) - 1:
        high = max(low + 1, int(np.searchsorted(done[edges], done[edges[low]] + SUFFIXES, side="right")) - 1)
        mine = order[edges[low] : edges[high]]
        low = high
        context = np.repeat(mine, windows[mine])
        offset = _within(windows[mine])
        at = start[context] + offset
        sorted_, common = suffix_array(data, group[context], at, (start + length)[context])
        left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1)[sorted_]
        for found in maximal_intervals(common, left, size):
            members = sorted_[found.low : found.high + 1]
            yield found.length, context[members], offset[members]


def _send_contexts(left: pd.DataFrame, right: pd.DataFrame, size: int, buckets: int, sizes: Sizes) -> pd.DataFrame:
    out = []
    for row in left.itertuples(index=False):
        chunk = Chunk.of(row)
        a = anchors(chunk, size)
        e = entries(a, sizes)
        c, _, _ = open_contexts(chunk, a, e, _flags(right, len(e.gram)), size)
        cut = key_cuts(c.key, buckets)
        for b in np.flatnonzero(np.diff(cut)):
            s = slice(cut[b], cut[b + 1])
            data = chunk.data[np.repeat(c.start[s], c.length[s]) + _within(c.length[s])]
            out.append((int(b), row.chunk, squeeze(c.key[s]), squeeze(c.check[s]), squeeze(c.length[s].astype(np.uint32)), squeeze(c.doc[s]),
                        zstandard.compress(data.tobytes(), 1)))
    return pd.DataFrame(out, columns=["bucket", "chunk", "key", "check", "length", "doc", "data"])


def _answer_contexts(group: pd.DataFrame, size: int) -> pd.DataFrame:
    """For each window sent: whether it lies within a repeat that a smaller document holds too."""
    keys = [expand(k, np.uint64) for k in group.key]
    key = np.concatenate(keys)
    length = np.concatenate([expand(n, np.uint32) for n in group.length]).astype(np.int64)
    doc = np.concatenate([expand(d, np.int64) for d in group.doc])
    data = np.frombuffer(b"".join(zstandard.decompress(d) for d in group.data), np.uint8)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    check = np.concatenate([expand(c, np.uint32) for c in group.check])
    base = np.concatenate([[0], np.cumsum(_windows(length, size))])
    steps = np.zeros(base[-1] + 1, dtype=np.int64)  # +1 where a covered run of windows begins, -1 after it
    single = np.flatnonzero(length == 0)
    order = single[np.lexsort((doc[single], check[single], key[single]))]
    if len(order):
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        late = order[doc[order] > doc[order][new][np.cumsum(new) - 1]]
        steps[base[late]] += 1
        steps[base[late] + 1] -= 1
    number = np.full(len(key), -1)
    whole = np.flatnonzero(length > 0)
    _, number[whole], several = np.unique(key[whole], return_inverse=True, return_counts=True)
    multi = whole[several[number[whole]] > 1]
    for n, context, offset in repeats(number[multi], data, start[multi], length[multi], size):
        context = multi[context]
        late = doc[context] > doc[context].min()
        begin = base[context[late]] + offset[late]
        np.add.at(steps, begin, 1)
        np.add.at(steps, begin + n - size + 1, -1)
    covered = (np.cumsum(steps[:-1]) > 0).astype(np.uint8)
    ends = base[np.cumsum([0] + [len(k) for k in keys])]
    return pd.DataFrame({
        "chunk": group.chunk.to_numpy(), "bucket": group.bucket.to_numpy(),
        "reply": [zstandard.compress(covered[low:high].tobytes(), 1) for low, high in zip(ends[:-1], ends[1:])],
    })


def _finish(left: pd.DataFrame, right: pd.DataFrame, size: int, sizes: Sizes) -> pd.DataFrame:
    out = []
    for row in left.itertuples(index=False):
        chunk = Chunk.of(row)
        a = anchors(chunk, size)
        e = entries(a, sizes)
        first = _flags(right[right.step == 1], len(e.gram))
        contexts, w_start, w_answer = open_contexts(chunk, a, e, first, size)
        second = _flags(right[right.step == 2], int(contexts.windows(size).sum()))
        whole = (first[e.of] & COVERED > 0) | ((a.doc > e.doc[e.of]) & ~e.many[e.of])
        gone = w_answer < 0
        gone[~gone] = second[w_answer[~gone]] > 0
        steps = np.zeros(len(chunk.data) + 1, dtype=np.int64)
        np.add.at(steps, a.first[whole], 1)
        np.add.at(steps, a.last[whole] + size, -1)
        np.add.at(steps, w_start[gone], 1)
        np.add.at(steps, w_start[gone] + size, -1)
        removed = np.cumsum(steps[:-1]) > 0
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        heads = chunk.ends[:-1][chunk.ends[:-1] < chunk.ends[1:]]
        opens[heads] = removed[heads]
        total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (removed, opens))
        rest = row.rest.split("\n") if len(chunk.ids) else []
        for i, doc in enumerate(chunk.ids):
            low, high = chunk.ends[i], chunk.ends[i + 1]
            kept = chunk.data[low:high][~removed[low:high]].tobytes()
            out.append((int(doc), kept, int(high - low), int(total[high] - total[low]), int(spans[high] - spans[low]), hashlib.sha256(kept).hexdigest(), rest[i]))
    return pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"])


def remove_repeats(docs: DataFrame, size: int = 50, carry: list[str] | None = None, sizes: Sizes = Sizes()) -> DataFrame:
    """Remove what smaller documents already say: ``doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``.

    A byte is removed if a string of ``size`` bytes that covers it also starts in a document with a smaller doc_id,
    judged on the given texts (``doc_id, text``; null text counts as empty).  ``kept`` holds the other bytes, ``n_spans``
    the number of maximal removed runs.  Matches never cross documents; a string that only its own document repeats
    stays.  A document without doc_id comes after all others; rows of one doc_id are not smaller than each other.
    Texts shorter than ``size`` lose nothing; an empty table gives no rows.  ``carry`` names more columns to hand through.

    Two questions go from the chunks of text to buckets of keys and back: which anchored blocks a smaller document
    holds, and, where contexts differ, which of their windows do (by the suffix array of the contexts).  A chunk asks
    once about equal things, so a passage of very many documents costs a bucket one entry per chunk; an anchor with
    very many contexts is asked about window by window, which spreads it over all buckets.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    carry = carry or []
    rest = F.to_json(F.struct(*carry), {"ignoreNullFields": "false"}) if carry else F.lit("{}")
    chunks = text_chunks(docs.withColumn("_rest", rest), sizes, size)
    deal = Deal.of(spark, chunks.agg(F.sum("n_bytes")).first()[0] or 0)
    buckets = deal.buckets
    answer = "chunk long, bucket int, reply binary"

    asked = in_python(chunks.select("chunk", "ids", "ends", "data", "places"), lambda batches: _send_entries(batches, size, buckets, sizes),
                      "bucket int, chunk long, gram binary, block binary, doc binary, many binary")
    first = written(deal.by(asked, "bucket").groupBy("bucket").applyInPandas(per_group(lambda g: _answer_entries(g, sizes)), answer), "repeat_blocks")
    by_chunk = lambda df: deal.by(df, "chunk").groupBy("chunk")
    contexts = by_chunk(chunks.drop("rest", "n_bytes")).cogroup(by_chunk(first)).applyInPandas(
        per_pair(lambda left, right: _send_contexts(left, right, size, buckets, sizes)),
        "bucket int, chunk long, key binary, check binary, length binary, doc binary, data binary")
    second = written(deal.by(contexts, "bucket").groupBy("bucket").applyInPandas(per_group(lambda g: _answer_contexts(g, size)), answer), "repeat_windows")
    both = first.withColumn("step", F.lit(1)).union(second.withColumn("step", F.lit(2)))
    done = by_chunk(chunks.drop("n_bytes")).cogroup(by_chunk(both)).applyInPandas(
        per_pair(lambda left, right: _finish(left, right, size, sizes)),
        "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, rest string")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else "none string"
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(int(NO_ID)))).withColumn("rest", F.from_json("rest", fields)).select(
        "doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", *[F.col("rest")[c].alias(c) for c in carry])
