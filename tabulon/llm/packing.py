"""Best-fit packing of token pieces into sequences: linear grouping, few-size configurations, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import in_python, shuffle_tasks, texts, whole_numbers, written

CACHED_WORDS = 120_000
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of the public word-level BPE (lower case, white space dropped), word by word with a memory.

    Nothing in such a tokenizer reaches across a space, tab or line break, so a text's ids are its words' ids
    one after the other.  A word of Latin letters, with or without closing marks, needs no normalisation but
    lower case and goes straight to the tokenizer's BPE model; any other goes through the whole tokenizer.
    """

    MARKS = ".,;:!?#%&*$|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # how byte-level BPE writes bytes: printable Latin-1 characters as they are, others from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = {b: (b if b in printable else next(rest)) for b in range(256)}
        self.most = CACHED_WORDS
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        for text in ("a b", " a  B\tc\n", "don't <|x|> it's\n\n9 9", "Étre, ÄÖß!! of.&&& ªº"):
            if np.frombuffer(self.encode(text), "<u4").tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError("this tokenizer is not a word-level one that drops white space")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            return b"".join([self.young[w] for w in words])
        except KeyError:
            return b"".join([self.young[w] if w in self.young else self._learn(w) for w in words])

    def _learn(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._encode_word(word)
        if len(self.young) >= self.most:
            self.young, self.old = {"": b""}, self.young
        self.young[word] = ids
        return ids

    def _encode_word(self, word: str) -> bytes:
        core = word.rstrip(self.MARKS)
        if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
            core = core.lower()
            written = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(written)], dtype="<u4").tobytes()
            if len(core) == len(word):
                return ids
            marks = word[len(core) :]
            return ids + (self.young[marks] if marks in self.young else self._learn(marks))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encoder(path: str, words: int = CACHED_WORDS) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].most = words
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, last_id: int = 1, words: int = CACHED_WORDS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids followed by ``last_id``.

    Only documents longer than ``capacity`` are cut, into pieces of that many ids; null text counts as empty.  A worker
    remembers the ids of ``words`` words, and of as many that it met before those.
    """
    end = np.array([last_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer, words).encode
        for batch in batches:
            out = []
            for doc, text in zip(batch.doc_id, texts(batch.text)):
                ids = encode(text) + end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, number, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_python(docs.select("doc_id", "text"), pieces, "doc_id long, piece int, start long, length long, ids_crc32 long", exact=["doc_id"])


@dataclass
class Open:
    """A run of sequences with equal contents so far: ``count`` of them from number ``first``."""

    first: int
    count: int


class Plan:
    """Where the items of each length go, as runs: items ``item ..`` of a length, ``per`` to a sequence, from ``first`` at ``offset``."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.open: dict[int, list[Open]] = {}  # free space -> runs
        self.free: list[int] = []
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, item, count, first, per, offset
        self.used: dict[int, int] = {}

    def add(self, space: int, run: Open) -> None:
        if run.count:
            if space not in self.open:
                self.open[space] = []
                insort(self.free, space)
            self.open[space].append(run)

    def take(self, space: int, most: int) -> Open:
        """Up to ``most`` sequences with this much free space."""
        runs = self.open[space]
        run = runs.pop()
        if run.count > most:
            runs.append(Open(run.first + most, run.count - most))
            run = Open(run.first, most)
        if not runs:
            del self.open[space]
            self.free.remove(space)
        return run

    def new(self, count: int) -> Open:
        self.sequences += count
        return Open(self.sequences - count, count)

    def put(self, length: int, run: Open, per: int, space: int) -> None:
        """``per`` items of ``length`` into each sequence of the run."""
        item = self.used.get(length, 0)
        self.runs.append((length, item, per * run.count, run.first, per, self.capacity - space))
        self.used[length] = item + per * run.count

    def best_fit(self, length: int, count: int) -> None:
        """Place ``count`` items of one length, each where the least space is left (all of a run alike)."""
        while count:
            at = bisect_left(self.free, length)
            if at < len(self.free):
                space = self.free[at]
                per = min(space // length, count)
                run = self.take(space, count // per)
            else:
                space = self.capacity
                per = min(space // length, count)
                run = self.new(count // per)
            self.put(length, run, per, space)
            count -= per * run.count
            self.add(space - per * length, run)


def group_lengths(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut (length, count) in descending order into groups of equal cardinality, each a list of (length, count).

    A length whose items straddle a border is divided.
    """
    total = sum(n for _, n in large)
    out: list[list[tuple[int, int]]] = []
    made = 0
    for length, n in large:
        while n:
            if not out or made >= total * len(out) / groups:
                out.append([])
            part = min(n, max(1, int(np.ceil(total * len(out) / groups)) - made))
            out[-1].append((length, part))
            made, n = made + part, n - part
    return out


def best_configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many items of each rounded size fill a sequence best (bounded knapsack over at most ``capacity`` weights)."""
    reach = np.full((len(sizes) + 1, capacity + 1), -1, dtype=np.int64)  # copies of the last size used, or -1
    reach[0, 0] = 0
    ok = reach[0] >= 0
    for i, (size, n) in enumerate(zip(sizes, left)):
        row = np.where(ok, 0, -1)
        for copies in range(1, min(n, capacity // size) + 1):
            moved = np.zeros(capacity + 1, dtype=bool)
            moved[copies * size :] = ok[: capacity + 1 - copies * size]
            row[moved & (row < 0)] = copies
        reach[i + 1] = row
        ok = row >= 0
    at, chosen = int(np.flatnonzero(ok)[-1]), [0] * len(sizes)
    for i in range(len(sizes), 0, -1):
        chosen[i - 1] = int(reach[i, at])
        at -= chosen[i - 1] * sizes[i - 1]
    return chosen


# shares above which an item is large, and numbers of groups, that are tried; the plan with the fewest sequences is taken
TRIALS = [(1 / 8, 48), (1 / 4, 48), (1 / 4, 192), (1 / 2, 192)]


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """The best of the plans of ``TRIALS``; all work on the counts of lengths, so trying costs little."""
    best = None
    enough = -(-sum(n * c for n, c in counts.items()) // capacity)
    for share, groups in TRIALS:
        plan = plan_with_groups(counts, capacity, share, groups)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= enough:
            break
    return best


def plan_with_groups(counts: dict[int, int], capacity: int, large_share: float, groups: int) -> Plan:
    """Assign all items, given how many there are of each length (at most ``capacity`` numbers).

    1. Items longer than ``large_share`` of a sequence are put in order and cut into ``groups`` groups of equal
       cardinality; every length of a group is rounded up to its longest.
    2. Over these few sizes the fullest configuration that holds the longest size left is sought and used as often as its
       sizes last, again and again (starting from the longest leaves the ones that fit anywhere for later).
    3. Actual items take the places of their group, longest first, so what rounding cost is free again.
    4. Small items follow in descending order, each where it leaves the least space.
    """
    plan = Plan(capacity)
    full = counts.get(capacity, 0)
    if full:
        run = plan.new(full)
        plan.put(capacity, run, 1, capacity)
    lengths = sorted(((n, c) for n, c in counts.items() if c and n < capacity), reverse=True)
    large = [(n, c) for n, c in lengths if n > capacity * large_share]
    grouped = group_lengths(large, groups)
    sizes = [g[0][0] for g in grouped]
    left = [sum(c for _, c in g) for g in grouped]
    queues = [list(reversed(g)) for g in grouped]
    while sum(left):
        alive = [i for i, n in enumerate(left) if n]
        room = [left[i] - (i == alive[0]) for i in alive]
        chosen = best_configuration([sizes[i] for i in alive], room, capacity - sizes[alive[0]])
        chosen[0] += 1
        times = min(left[i] // c for i, c in zip(alive, chosen) if c)
        runs = [(capacity, plan.new(times))]
        for i, copies in zip(alive, chosen):
            left[i] -= copies * times
            for _ in range(copies):
                filled = []
                for space, run in runs:
                    while run.count:
                        length, n = queues[i].pop()
                        here = min(n, run.count)
                        if n > here:
                            queues[i].append((length, n - here))
                        part = Open(run.first, here)
                        plan.put(length, part, 1, space)
                        filled.append((space - length, part))
                        run = Open(run.first + here, run.count - here)
                runs = filled
        for space, run in runs:
            plan.add(space, run)
    for length, n in lengths:
        if length <= capacity * large_share:
            plan.best_fit(length, n)
    return plan


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id, offset`` to a table with ``length`` (1 to ``capacity``) and the keys ``doc_id, piece``.

    The plan is made from the number of pieces of each length (at most ``capacity`` numbers, whatever the
    table's size) and sent to all tasks; its size is bounded by lengths and groups as well.  Pieces of one length
    are alike to the plan, so each only needs its number among them: counted by (length, hash bucket), so that a
    length that very many pieces share is numbered in many tasks.  Repeated rows are packed each; an empty table
    gives no rows.
    """
    spark = pieces.sparkSession
    buckets = 16 * shuffle_tasks(spark)
    fixed = written(pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")), "pieces")
    sizes = written(fixed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    table = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 6)
    runs = spark.sparkContext.broadcast((table, table[:, 0] << 48 | table[:, 1]))
    shift = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("length", "_b", shift.alias("_shift"))
    local = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1
    numbered = fixed.withColumn("_i", local).join(shifts, ["length", "_b"]).withColumn("_i", F.col("_i") + F.col("_shift")).drop("_shift", "_b")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, key = runs.value  # a run is found by length and number of its first item
        for batch in batches:
            length, item = batch["length"].to_numpy(np.int64), batch["_i"].to_numpy(np.int64)
            at = np.searchsorted(key, length << 48 | item, side="right") - 1
            _, first_item, _, first, per, offset = table[at].T
            within = item - first_item
            yield batch.drop(columns="_i").assign(sequence_id=first + within // per, offset=offset + (within % per) * length)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("_i").schema)
    return in_python(numbered, place, fields + ", sequence_id long, offset long", exact=whole_numbers(numbered, ["length", "_i"]))
