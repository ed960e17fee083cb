"""Benchmark decontamination: latent semantic candidate search, then common subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut, in_pieces, in_python, pack_strings, slices, sum_pieces, texts, whole_numbers
from tabulon.llm.texthash import lower_ascii, prefix_hash, span_hash, words

SLICE = 1_000_000
SLOTS = 1 << 18  # term slots of the frequency table; words share a slot only by chance
SEED = 11


@dataclass(frozen=True)
class Settings:
    """Parameters of the search.

    ``passage``: words per passage for document frequencies; ``window, stride``: the windows of a document that are
    searched (a half and a quarter of both for items that are no longer); ``min_words``: shorter items are searched as
    exact sequences; ``rank, extra, powers``: of the randomised SVD (a block with more items has their number as rank); ``cosine``: least similarity of a candidate; ``share``:
    least part of an item's words that must follow in order; ``with_answer``: least part if the answer is there too;
    ``block``: items per block (each block has its own index, so the tasks' share of the benchmark is bounded).
    """

    passage: int = 64
    window: int = 32
    stride: int = 8
    rank: int = 256
    extra: int = 16
    powers: int = 1
    cosine: float = 0.45
    share: float = 0.8
    with_answer: float = 0.65
    block: int = 256
    min_words: int = 5


def term_hashes(column: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word (runs of letters and digits, ASCII lower case)."""
    raw, ends = pack_strings(column)
    data = lower_ascii(np.frombuffer(raw, dtype=np.uint8))
    start, end, text = words(data, ends, marks_divide=True)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return span_hash(prefix_hash(data), start, end), text


def window_words(count: int, s: Settings) -> int:
    """Words of the windows in which a text of ``count`` words is searched: the least of a quarter, half and whole window that holds it."""
    return next((w for w in (s.window // 4, s.window // 2) if w >= count), s.window)


def parts_of(text: str, s: Settings) -> list[tuple[int, str]]:
    """(window, text) of the parts by which an item is searched: itself up to one and a half windows, else passages of a window each.

    In a window of w words, an item of n > w words has a cosine of about sqrt(w / n) at most, so long ones are divided.
    The last passage ends with the item.  Items with fewer than ``min_words`` words have none.
    """
    raw, ends = pack_strings([text])
    start, end, _ = words(lower_ascii(np.frombuffer(raw, dtype=np.uint8)), ends, marks_divide=True)
    if len(start) < s.min_words:
        return []
    if len(start) <= s.window * 3 // 2:
        return [(window_words(len(start), s), text)]
    begins = [*range(0, len(start) - s.window, s.window), len(start) - s.window]
    return [(s.window, raw[start[b] : end[b + s.window - 1]].decode("utf-8", "surrogatepass")) for b in begins]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, s: Settings) -> np.ndarray:
    """log(passages / (1 + passages with the term)) per slot, over all passages of all documents, never below zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS + 64, dtype=np.int64)  # the last part holds the number of passages
        for part in slices(batches, "text", SLICE):
            h, text = term_hashes(texts(part.text))
            if len(h):
                first = np.searchsorted(text, text)
                passage = (np.arange(len(h)) - first) // s.passage
                new = np.ones(len(h), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (passage[1:] != passage[:-1])
                number = np.cumsum(new) - 1
                both = np.unique(number * SLOTS + _slot(h))
                total[:SLOTS] += np.bincount(both & (SLOTS - 1), minlength=SLOTS)
                total[SLOTS] += number[-1] + 1
        yield in_pieces(total)

    counts = sum_pieces(in_python(docs.select("text"), run, "piece int, counts binary"), SLOTS + 64)
    return np.maximum(0.0, np.log((1.0 + counts[SLOTS]) / (1.0 + counts[:SLOTS])))


def _rows(column: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """TF-IDF rows of unit length: slots and weights."""
    h, text = term_hashes(column)
    out = []
    for i in range(len(column)):
        slot, count = np.unique(_slot(h[text == i]), return_counts=True)
        weight = count * idf[slot]
        norm = np.sqrt((weight**2).sum())
        out.append((slot, weight / norm if norm else weight))
    return out


def randomised_svd(items: DataFrame, idf: np.ndarray, s: Settings, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """``rank`` right singular vectors of the TF-IDF matrix of ``items`` (``text``): used slots, and one row of weights per slot.

    The range of the matrix is found with a random test matrix and ``powers`` power steps.  Tasks hold the rows;
    between steps only products of the size slots-in-use x rank are added up.
    """
    spark = items.sparkSession
    column = items.select("text")
    width = rank + s.extra
    idf_shared = spark.sparkContext.broadcast(idf)

    def slots_used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: set[int] = set()
        for batch in batches:
            used.update(_slot(term_hashes(texts(batch.text))[0]).tolist())
        yield pd.DataFrame({"slot": sorted(used)}, dtype="int64")

    used = np.array(sorted(r[0] for r in in_python(column, slots_used, "slot long").distinct().collect()), dtype=np.int64)
    if not len(used):
        return used, np.zeros((0, 1))
    width = min(width, len(used))
    basis = np.random.default_rng(SEED).standard_normal((len(used), width))

    def times(matrix: np.ndarray) -> np.ndarray:
        """(A^T A) matrix, added up over the tasks' rows."""
        shared = spark.sparkContext.broadcast(matrix)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(shared.value)
            for batch in batches:
                for slot, weight in _rows(texts(batch.text), idf_shared.value):
                    at = np.searchsorted(used, slot)
                    total[at] += np.outer(weight, weight @ shared.value[at])
            for column in range(0, total.shape[1], 16):
                yield pd.DataFrame({"at": [column], "part": [np.ascontiguousarray(total[:, column : column + 16]).tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, part in zip(batch["at"], batch.part):
                    value = np.frombuffer(part)
                    sums[at] = sums[at] + value if at in sums else value
            yield pd.DataFrame({"at": list(sums), "part": [v.tobytes() for v in sums.values()]}).astype({"at": "int32"})

        parts = in_python(in_python(column, run, "at int, part binary").repartition("at"), add, "at int, part binary").collect()
        return np.concatenate([np.frombuffer(r["part"]).reshape(len(used), -1) for r in sorted(parts, key=lambda r: r["at"])], axis=1)

    for _ in range(s.powers + 1):
        basis, _ = np.linalg.qr(times(basis))
    inner = basis.T @ times(basis)  # Q^T A^T A Q: its eigenvectors turn Q into singular vectors
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    keep = np.argsort(value)[::-1][:rank]
    keep = keep[value[keep] > 1e-9 * max(value.max(), 1e-300)]
    return used, basis @ vector[:, keep]


@dataclass
class Items:
    """Whole items, in the order of their keys."""

    keys: list[int]
    ids: list
    copies: list[int]  # equal rows of the benchmark
    words: list[list[int]]  # word hashes of each item
    sorted_words: list[np.ndarray]  # the same without repeats, in order
    answers: list[int]  # where the answer's words begin


@dataclass
class Index:
    """What tasks need of one block of parts of items; without latent arrays it is searched for exact sequences."""

    window: int
    items: Items  # those that have parts in the block
    part_of: np.ndarray  # item of each part
    idf: np.ndarray | None = None
    row_of: np.ndarray | None = None  # slot -> row of the arrays below, or -1
    latent: np.ndarray | None = None  # singular vectors by row
    item_latent: np.ndarray | None = None  # rank x parts
    most: np.ndarray | None = None  # per row, the most it can add to any part's similarity


def _answer_start(text: str, answer: str | None) -> int:
    """Number of words before the answer: the given one where it ends the text, otherwise the last sentence."""
    if answer and text.rstrip().endswith(answer.strip()):
        head = text.rstrip()[: -len(answer.strip())]
    else:
        sentences = [m.end() for m in re.finditer(r"[.!?:\n]+\s+", text.rstrip())]
        head = text[: sentences[-1]] if sentences else ""
    return len(term_hashes([head])[0])


def _whole(rows: list, s: Settings) -> Items:
    rows = sorted(rows, key=lambda r: r["key"])
    hashes = [term_hashes([r["text"]])[0] for r in rows]
    return Items([r["key"] for r in rows], [r["item_id"] for r in rows], [r["copies"] for r in rows], [h.tolist() for h in hashes],
                 [np.unique(h) for h in hashes], [_answer_start(r["text"], r["answer"]) for r in rows])


def build_indexes(docs: DataFrame, benchmark: DataFrame, s: Settings) -> list[Index]:
    """Frequencies over all documents, then an index for each block of items (``item_id, text`` and optionally ``answer``).

    Long items are indexed as passages of a window, which are dealt to the blocks one by one; items that a quarter or half
    of a window holds have blocks of their own, whose windows are that short.  Items of up to a quarter of a window are
    also searched as exact sequences, and those with fewer than ``min_words`` words only so.  Items without words (null
    and empty ones too) identify nothing and are left out.
    A block's rank is never below its number of parts: with fewer dimensions than parts even an item's own copy has a
    cosine of about sqrt(rank / parts) in the latent space.
    """
    extra = [F.col("answer")] if "answer" in benchmark.columns else [F.lit(None).cast("string").alias("answer")]
    items = benchmark.select("item_id", "text", *extra).filter("text is not null")
    items = cut(items.groupBy("item_id", "text", "answer").agg(F.count(F.lit(1)).alias("copies"))
                .select(F.xxhash64("item_id", "text", "answer").alias("key"), "item_id", "text", "answer", "copies"))
    idf = inverse_frequencies(docs, s)
    short = s.window // 4

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, item, text in zip(batch["key"], batch.item_id, batch.text):
                rows += [(key, item, n, window, part) for n, (window, part) in enumerate(parts_of(text, s))]
                if 0 < len(term_hashes([text])[0]) <= max(short, s.min_words - 1):
                    rows.append((key, item, 0, 0, text))
            yield pd.DataFrame(rows, columns=["key", "item_id", "number", "window", "text"]).astype({"key": "int64", "number": "int32", "window": "int32"})

    kind = items.schema["item_id"].dataType.simpleString()
    parts = cut(in_python(items.select("key", "item_id", "text"), divide, f"key long, item_id {kind}, number int, window int, text string"))
    sizes = {r["window"]: r["count"] for r in parts.groupBy("window").count().collect()}
    out = []
    for window in sorted(sizes, reverse=True):
        blocks = -(-sizes[window] // s.block)
        for number in range(blocks):
            block = parts.filter((F.col("window") == window) & (F.pmod(F.xxhash64("key", "number"), F.lit(blocks)) == number))
            rows = sorted(block.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["key"], r["number"]))  # about `block` parts
            if not rows:
                continue
            whole = _whole(items.join(F.broadcast(block.select("key").distinct()), "key", "left_semi").collect(), s)
            place = {key: i for i, key in enumerate(whole.keys)}
            part_of = np.array([place[r["key"]] for r in rows], dtype=np.int64)
            if not window:
                out.append(Index(0, whole, part_of))
                continue
            used, vectors = randomised_svd(block, idf, s, max(s.rank, len(rows)))
            row_of = np.full(SLOTS, -1, dtype=np.int32)
            row_of[used] = np.arange(len(used))
            latent = vectors.astype(np.float32)
            tfidf = _rows([r["text"] for r in rows], idf)
            item_latent = np.stack([weight.astype(np.float32) @ latent[row_of[slot]] for slot, weight in tfidf], axis=1)
            most = np.concatenate([np.abs(latent[i : i + 256] @ item_latent).max(axis=1) for i in range(0, len(latent), 256)])
            out.append(Index(window, whole, part_of, idf.astype(np.float32), row_of, latent, item_latent, most))
    return out


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel over ``a``)."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        match = row & places.get(y, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def _latent_candidates(h: np.ndarray, low: np.ndarray, high: np.ndarray, index: Index, s: Settings) -> Iterator[tuple[int, int, int, float]]:
    """(text number, item of the index, begin of the window, cosine) of windows that are near enough to a part."""
    window, stride = index.window, max(1, s.stride * index.window // s.window)
    slot = _slot(h)
    idf = index.idf[slot].astype(np.float64)
    row = index.row_of[slot]
    gain = np.where(row >= 0, idf * index.most[row], 0.0)
    count = np.maximum(1, -(-(high - low - window) // stride) + 1) * (high > low)
    owner = np.repeat(np.arange(len(low)), count)
    begin = low[owner] + stride * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(begin + window, high[owner])
    energy, bound = (np.concatenate([[0.0], np.cumsum(x)]) for x in (idf * idf, gain))
    norm = np.sqrt(np.maximum(energy[end] - energy[begin], 1e-12))
    # no part can be more similar than the sum of the most that each word adds
    alive = np.flatnonzero((bound[end] - bound[begin]) >= s.cosine * norm * (1 - 1e-6))
    for at in range(0, len(alive), 512):
        part = alive[at : at + 512]
        place = begin[part][:, None] + np.arange(window)[None, :]
        inside = place < end[part][:, None]
        place = np.minimum(place, len(h) - 1)
        weight = np.where(inside & (row[place] >= 0), idf[place], 0.0).astype(np.float32)
        mapped = np.einsum("nw,nwr->nr", weight, index.latent[np.maximum(row[place], 0)], optimize=True)
        cosine = (mapped @ index.item_latent) / norm[part][:, None]
        for i, j in zip(*np.nonzero(cosine >= s.cosine)):
            yield int(owner[part[i]]), int(index.part_of[j]), int(begin[part[i]]), float(cosine[i, j])


def _sequence_keys(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return out


def _exact_candidates(h: np.ndarray, text: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, float]]:
    """The same for items that stand in a text word by word."""
    by_size: dict[int, dict[int, list[int]]] = {}
    for item in index.part_of.tolist():
        wanted = np.array(index.items.words[item], dtype=np.uint64)
        by_size.setdefault(len(wanted), {}).setdefault(int(_sequence_keys(wanted, len(wanted))[0]), []).append(item)
    for size, known in by_size.items():
        keys = _sequence_keys(h, size)
        for at in np.flatnonzero(np.isin(keys, np.array(list(known), dtype=np.uint64))).tolist():
            if text[at] == text[at + size - 1]:
                for item in known[int(keys[at])]:
                    if h[at : at + size].tolist() == index.items.words[item]:
                        yield int(text[at]), item, at, 1.0


def find(column: list[str], indexes: list[Index], s: Settings) -> list[tuple[int, int, float, float, bool]]:
    """(text number, item id, cosine, share of the item's words in order, answer found) of contaminated texts.

    Candidates of all indexes are put together first, because the passages of an item may lie in several.
    """
    h, text = term_hashes(column)
    if not len(h):
        return []
    low = np.searchsorted(text, np.arange(len(column)))
    high = np.searchsorted(text, np.arange(len(column)), side="right")
    candidates: dict[tuple[int, int], list] = {}  # (text, key of the item) -> cosine, items, item, {begin: end}
    for index in indexes:
        near = _latent_candidates(h, low, high, index, s) if index.window else _exact_candidates(h, text, index)
        for doc, item, begin, cosine in near:
            known = candidates.setdefault((doc, index.items.keys[item]), [0.0, index.items, item, {}])
            known[0] = max(known[0], cosine)
            end = begin + (index.window or len(index.items.words[item]))
            known[3][begin] = max(known[3].get(begin, 0), end)
    found = []
    for (doc, _), (cosine, items, item, windows) in candidates.items():
        wanted, known = items.words[item], items.sorted_words[item]
        answer = wanted[items.answers[item] :]
        reach = len(wanted) + len(wanted) // 4 + s.stride
        best, answered, covered = 0.0, False, low[doc] - 1
        for start, end in sorted(windows.items()):
            if end + reach <= covered:
                continue
            covered = min(high[doc], end + 2 * reach)
            region = h[max(low[doc], start - reach) : covered]
            place = np.minimum(np.searchsorted(known, region), len(known) - 1)
            region = region[known[place] == region].tolist()  # other words cannot follow in order
            if len(region) < min(s.share, s.with_answer) * len(wanted):
                continue
            share = common_subsequence(wanted, region) / len(wanted)
            has = bool(answer) and common_subsequence(answer, region) == len(answer)
            if share > best or (share == best and has):
                best, answered = share, has
        if len(wanted) < s.min_words and best < 1:
            continue
        if best >= s.share or (best >= s.with_answer and answered):
            found += [(doc, items.ids[item], cosine, best, answered)] * items.copies[item]
    return found


def contaminated(docs: DataFrame, indexes: list[Index], s: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, cosine, share, has_answer``: every document and the benchmark items it repeats or paraphrases.

    Whole texts are searched in windows.  A window is a candidate for an item if the cosine to one of its parts in the
    latent space is high enough, or if a short item stands there word by word; then the item's words must follow in order around the window up to ``share``, or up to
    ``with_answer`` where the whole answer (by default the last sentence) is there in order as well.  Null and empty
    texts match nothing; repeated rows give repeated results; without items or documents there are no rows.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(i) for i in indexes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text", SLICE):
            column, ids = texts(part.text), part.doc_id.tolist()
            rows = [(ids[d], i, c, share, has) for d, i, c, share, has in find(column, [x.value for x in shared], s)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "share", "has_answer"], dtype=object)

    return in_python(docs.select("doc_id", "text"), run, "doc_id long, item_id long, cosine double, share double, has_answer boolean", exact=["doc_id"])


def clean(docs: DataFrame, indexes: list[Index], s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` (all columns) that repeat no benchmark item, by the same search."""
    shared = [docs.sparkSession.sparkContext.broadcast(i) for i in indexes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text", SLICE):
            column = texts(part.text)
            keep = np.ones(len(part), dtype=bool)
            keep[[d for d, *_ in find(column, [x.value for x in shared], s)]] = False
            yield part[keep]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return in_python(docs, run, fields, exact=whole_numbers(docs))
