"""Brute-force versions and a small table of documents with every awkward case."""

import math
import random
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text, low=False):
    return WORD.findall(lower(text or "") if low else text or "")


def texts(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(4)]
    found = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 25, 60, 200]))]
        if rng.random() < 0.4:
            at = rng.randrange(len(base) + 1)
            cut = rng.randrange(15)
            base[at:at] = rng.choice(passages)[cut:]
        if i and rng.random() < 0.4:
            base = words(found[rng.randrange(i)])
            for _ in range(rng.choice([0, 0, 1, 3])):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
        seps = [" ", " ", " ", "\n", "  ", "\t"]
        found.append("".join(w + rng.choice(seps) for w in base))
    found += [None, "", " \n\t ", "one", "Two words", "TWO WORDS", "x" * 3000, "spam " * 500, "line a\nline b\nline a\n\n\nline a #*| <b>", "É é\u00a0É", "a b c " * 30]
    return found


def near_duplicates(docs, width, percent):
    sets, parent = {}, {}
    for i, t in docs:
        w = words(t, True)
        sets[i] = set(zip(*(w[j:] for j in range(width)), strict=False)) if len(w) >= width else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def repeats(docs, window):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def statistics(text):
    text = text or ""
    w = words(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    threes = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if threes[tuple(w[i : i + 3])] > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, sum(hit)


def unigrams(docs):
    counts = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [*words(t, True), None] for i, t in docs}
    for i in tokens:
        if not held[i]:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) for i, t in tokens.items()}
