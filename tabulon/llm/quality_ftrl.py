"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import in_python, pack_strings, per_group, prepare_workers, slices, texts, whole_numbers, written
from tabulon.llm.texthash import lower_ascii, mix, prefix_hash, span_hash, words

BITS = 18
BIAS = 0
SLICE = 1_000_000


def _class_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, member: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(member[data])])
    return running[end] - running[start]


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    for low, high in ranges:
        out[low : high + 1] = 1
    return out


_UPPER, _LOWER, _DIGIT = _table((65, 90)), _table((97, 122)), _table((48, 57))
_OTHER = _table((33, 47), (58, 64), (91, 96), (123, 126))
_BEYOND = _table((128, 255))


def word_forms(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number below 256 per word for how it is written: letter case, digits, marks, length."""
    size = end - start
    upper, lower = _class_counts(data, start, end, _UPPER), _class_counts(data, start, end, _LOWER)
    digit, mark = _class_counts(data, start, end, _DIGIT), _class_counts(data, start, end, _OTHER)
    letters = upper + lower + _class_counts(data, start, end, _BEYOND)
    first_upper = _UPPER[data[start]] == 1
    case = np.select([letters == 0, (upper >= 2) & (lower == 0), first_upper, upper > 0], [0, 1, 2, 3], 4)
    last = data[end - 1]
    ending = np.select([_OTHER[last] == 0, last == 44, last == 46], [0, 1, 2], 3)
    marks = np.minimum(mark, 2)
    length = np.select([size <= 3, size <= 8], [0, 1], 2)
    return (((case * 4 + ending) * 3 + marks) * 3 + length) + np.where(digit > 0, 180, 0) * (case == 0)


def features(column: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (text number, slot, value) in order of text: hashed word n-grams of whole texts.

    N-grams are single lower-case words, pairs of them, and runs of one to three word forms, where a form is how a word is
    written (case, marks, length, and whether it repeats the word before or the one two before).  The value
    of an n-gram is the square root of its share among its kind, so long and short texts weigh alike; every
    text has the bias slot.
    """
    raw, ends = pack_strings(column)
    data = np.frombuffer(raw, dtype=np.uint8)
    start, end, text = words(data, ends)
    n = len(column)
    keys, kinds = [], []
    if len(start):
        name = span_hash(prefix_hash(lower_ascii(data)), start, end)
        form = word_forms(data, start, end).astype(np.uint64)
        same = lambda k: np.concatenate([np.zeros(min(k, len(name)), bool), (name[k:] == name[:-k]) & (text[k:] == text[:-k])])
        form = form + np.uint64(512) * same(1).astype(np.uint64) + np.uint64(1024) * same(2).astype(np.uint64)
        with np.errstate(over="ignore"):
            keys.append((text, mix(name + np.uint64(1))))
            whole = text[:-1] == text[1:]
            pair = name[:-1] * np.uint64(0x9E3779B97F4A7C15) + name[1:]
            keys.append((text[:-1][whole], mix(pair[whole] + np.uint64(2))))
            run = form
            keys.append((text, mix(run + np.uint64(1 << 40))))
            for width in (2, 3):
                run = run[:-1] * np.uint64(2048) + form[width - 1 :]
                whole = text[: len(run)] == text[width - 1 :]
                keys.append((text[: len(run)][whole], mix(run[whole] + np.uint64(width << 40))))
        kinds = [np.bincount(t, minlength=n) for t, _ in keys]
    rows, slots, values = [np.arange(n)], [np.full(n, BIAS)], [np.ones(n)]
    for (t, h), total in zip(keys, kinds):
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        both, count = np.unique(t.astype(np.int64) << bits | slot, return_counts=True)
        rows.append(both >> bits)
        slots.append(both & ((1 << bits) - 1))
        values.append(np.sqrt(count / total[rows[-1]]))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(slots)[order], np.concatenate(values)[order]


@dataclass(frozen=True)
class Settings:
    """Learning rates and penalties of the updates, and how the bounded training sample is used."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    max_rows: int = 24_000  # bound of the labelled rows that are fitted
    shards: int = 8
    rounds: int = 2
    passes: int = 2
    bits: int = BITS


@dataclass
class State:
    """Per slot: sum of adjusted gradients and of squared gradients; weights follow from them."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, s: Settings, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: float, s: Settings) -> None:
        slots, at = np.unique(slots, return_inverse=True)
        values = np.bincount(at, weights=values)
        w = self.weights(s, slots)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha * w
        self.n[slots] = n + g * g


PIECES = 16  # parts of the state that are averaged side by side


def _mean_states(group: pd.DataFrame) -> pd.DataFrame:
    """The mean of one piece of all shards' states, added up in order of shard."""
    group = group.sort_values("shard")
    z, n = (sum(np.frombuffer(zstandard.decompress(x)) for x in group[c]) / len(group) for c in ("z", "n"))
    return pd.DataFrame({"piece": group.piece.iloc[:1].to_numpy(), "z": [z.tobytes()], "n": [n.tobytes()]})


def fit(labelled: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights from ``doc_id, text, label`` (0 or 1; other labels take no part).

    At most about ``max_rows`` rows are fitted, chosen by a hash of doc_id.  Every shard runs the updates over its
    rows in an order by hash, then the shards' states are averaged and the next round starts from the average.
    What reaches the driver is one state a round, bounded by the number of slots.  Without rows all weights are zero.
    """
    s = settings
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("label").isin(0, 1)).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    total = rows.count()
    share = min(1.0, s.max_rows / max(1, total))
    spread = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20))
    sample = written(
        rows.filter(spread < int(share * (1 << 20))).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(s.shards)).cast("int")), "quality_sample"
    )
    prepare_workers(spark)
    size = 1 << s.bits
    state = State(np.zeros(size), np.zeros(size))
    for _ in range(s.rounds):
        begin = spark.sparkContext.broadcast((state.z, state.n))

        def train(group: pd.DataFrame) -> pd.DataFrame:
            mine = State(*(x.copy() for x in begin.value))  # noqa: B023
            order = np.argsort(mix(group.doc_id.fillna(-1).to_numpy(np.int64).view(np.uint64)), kind="stable")
            group = group.iloc[order]
            labels = group.label.to_numpy(float)
            parts = [features(texts(part.text), s.bits) for part in slices(iter([group]), "text", SLICE)]  # whole texts, some at a time
            sizes = np.concatenate([np.bincount(row) for row, _, _ in parts])  # every text has the bias, so none is empty
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            slot, value = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            del parts
            for _ in range(s.passes):
                for i in range(len(group)):
                    mine.learn(slot[cuts[i] : cuts[i + 1]], value[cuts[i] : cuts[i + 1]], labels[i], s)
            packed = [[zstandard.compress(part.tobytes(), 1) for part in x.reshape(PIECES, -1)] for x in (mine.z, mine.n)]
            return pd.DataFrame({"piece": np.arange(PIECES, dtype=np.int32), "shard": group.shard.iloc[0], "z": packed[0], "n": packed[1]})

        trained = sample.groupBy("shard").applyInPandas(per_group(train), "piece int, shard int, z binary, n binary")
        z, n = np.zeros((PIECES, size // PIECES)), np.zeros((PIECES, size // PIECES))
        for r in trained.groupBy("piece").applyInPandas(per_group(_mean_states), "piece int, z binary, n binary").collect():
            z[r["piece"]], n[r["piece"]] = np.frombuffer(r["z"]), np.frombuffer(r["n"])
        state = State(z.reshape(-1), n.reshape(-1))
        begin.destroy()
    return state.weights(s)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) to ``docs`` with a ``text``; null counts as empty.

    Whole texts are read; empty ones get the score of the bias.  Columns other than ``text`` stay as they are
    (those named in ``keep``, or all); an existing ``score`` column is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for part in slices(batches, "text", SLICE):
            row, slot, value = features(texts(part.text), bits)
            logit = np.bincount(row, weights=w[slot] * value, minlength=len(part))
            yield part[keep].assign(score=1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))))

    wanted = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return in_python(wanted, run, schema + ", score double", exact=whole_numbers(docs.select(*keep)))


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves remainder 2 by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_on_labels(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Fit on the documents that ``labels`` (``doc_id, quality``) marks, leaving the held-out ids alone."""
    marks = labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out(F.col("doc_id")))
    known = docs.select("doc_id", "text").join(marks.filter("label in (0, 1)"), "doc_id")
    return fit(known, settings)


def classify(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """``score`` with ``predicted`` (1 at or above the threshold)."""
    return score(docs, weights, keep=keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
