"""Brute-force versions and small inputs of the training-data operators."""

import hashlib
import random


def repeats(docs, size):
    """What remove_repeats must return: per document bytes, removed bytes, runs, digest of the rest."""
    key = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < key(d):
                gone[p : p + size] = [True] * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shingle_set(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def components(docs, width, percent):
    sets = {d: shingle_set(t, width) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def word_list(rng, n, letters="abcdeé"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def copies(seed=1, n=240):
    """Documents with exact and near copies, a very common line, chains of small changes, empty and repetitive texts."""
    rng = random.Random(seed)
    bases = [" ".join(word_list(rng, 60)) for _ in range(5)]
    line = "the very common line that stands in a great many documents of the table, always alike."
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            words = bases[rng.randrange(5)].split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = f"X{i}"
            text = " ".join(words)
        elif kind < 0.6:
            text = " ".join(word_list(rng, rng.randint(0, 30))) + "\n" + line + "\n" + " ".join(word_list(rng, rng.randint(0, 30)))
        elif kind < 0.7:
            text = bases[0]
        elif kind < 0.8:
            start = rng.randrange(len(bases[1]) - 60)
            text = " ".join(word_list(rng, 10)) + bases[1][start : start + rng.randint(45, 70)] + " ".join(word_list(rng, 10))
        else:
            text = " ".join(word_list(rng, rng.randint(0, 50)))
        docs.append((3 * i + 1, text))
    docs[5], docs[6], docs[7], docs[8] = (16, "aaaa" * 50), (19, "aaaa" * 40), (22, ""), (25, None)
    rng.shuffle(docs)
    return docs
