"""Small tables for the tests of the corpus operators, and plain Python versions of their results."""

import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _row string, component_id long"

BASE = [f"w{k % 97}x{k * k % 89}" for k in range(400)]


def edge_rows():
    """Nulls in every column, empty and blank texts, one word, a very long text, copies, near copies, ties, repeated rows."""
    text = " ".join(BASE)
    near = " ".join(BASE[:395])
    texts = [
        (1, text, "en", "web", 3, 7, "r", 5),
        (2, text, "en", "web", 3, 7, "r", 5),
        (3, near, "en", "books", 3, 7, None, None),
        (4, None, None, None, None, None, None, None),
        (5, "", "en", "web", 0, 1, "x", 1),
        (6, " \t\n ", "de", "code", 4, 1, "x", 1),
        (7, "Word", "de", "code", 4, 1, "x", 1),
        (8, "word", "de", None, 4, 1, "x", 1),
        (9, " ".join(f"long{k * 7919 % 50021}" for k in range(60_000)), "fr", "web", 9, 1, "x", 1),
        (10, "Ünïcode   line sep\x0bfeed 中文 😀 " * 9, "zh", "web", 9, 1, "x", 1),
        (11, "the same line\nthe same line\nThis work is under the MIT License now.", "en", "notes", 9, 1, "x", 1),
        (11, "the same line\nthe same line\nThis work is under the MIT License now.", "en", "notes", 9, 1, "x", 1),
        (12, "x y x y x y x y x y x y x y x y x y", "en", "notes", 9, 1, "x", 1),
        (-3, "head " + " ".join(BASE[100:160]) + " tail", "en", "books", 9, 1, "x", 1),
    ]
    return texts


def edge_docs(spark, more=()):
    return spark.createDataFrame([*edge_rows(), *more], SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, size="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{size}/documents.parquet")


def words(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = data.lower()
    return WORD.findall(data)


def shingle_set(text, n):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def brute_components(rows, n, percent=80):
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    lead = {i: i for i in sets}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    shared = Counter()
    for ids in by.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[a], ids[b]] += 1
    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            lead[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def brute_removed(rows, n=13):
    """doc_id, words and the words left of each row."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), [x for x, g in zip(w, gone) if not g]))
    return out


def brute_targets(totals, cap=3):
    """Words that each source of {source: words} shall give: 5, 2, 1 by code point, null last, at most ``cap`` times its own."""
    order = sorted([s for s in totals if s is not None]) + [None] * (None in totals)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, live, left = dict.fromkeys(order, 0.0), {s for s in order if totals[s]}, float(sum(totals.values()))
    while live:
        share = left / sum(weight[s] for s in live)
        over = {s for s in live if share * weight[s] > cap * totals[s]}
        for s in over or live:
            target[s] = float(cap * totals[s]) if over else share * weight[s]
            left -= target[s]
        live = live - over if over else set()
    return target


def shape(word):
    """Letters by case, digits and marks as they are, runs of a kind made one."""
    kinds = [65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in word]
    return bytes(k for at, k in enumerate(kinds) if not at or kinds[at - 1] != k)


def plain_features(text, kinds, presence):
    """(kind, word or shape or whether it repeats the word before) -> value."""
    data, out = (text or "").encode(), {}
    for kind in kinds:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if kind == "tokens" else WORD, data if kind == "shapes" else data.lower())
        found = [shape(x) for x in w] if kind == "shapes" else [k > 0 and w[k - 1] == x for k, x in enumerate(w)] if kind == "repeats" else w
        for x, n in Counter(found).items():
            out[kind, x] = 1.0 if presence else (n / len(w)) ** 0.5
    return out


def plain_tails(rows, grades, kinds, presence):
    """P(grade > k) of each (doc_id, text), where ``grades`` are the rated ones: features as strings, all in this process."""
    import numpy as np

    from tessera.llm import ordinal

    held = [plain_features(t, kinds, presence) for _, t in rows]
    rated = [k for k, (i, t) in enumerate(rows) if i in grades and t is not None]
    g = np.array([grades[rows[k][0]] for k in rated])
    seen = {}
    for k, grade in zip(rated, g):
        for x in held[k]:
            seen.setdefault(x, []).append(grade)
    n, mean, spread = len(g), g.mean(), (g**2).mean() - g.mean() ** 2
    strength = {x: abs(sum(v) - len(v) * mean) / (len(v) * max(1 - len(v) / n, 1 / n) * spread) ** 0.5 for x, v in seen.items() if len(v) >= min(3, max(2, n // 50))}
    picked = [x for x, z in strength.items() if z >= 4]
    assert len(picked) <= ordinal.FEATURES
    matrix = np.array([[f.get(x, 0.0) for x in picked] for f in held]).reshape(len(rows), len(picked))
    doc, column = np.nonzero(matrix[rated])
    weights, thresholds = ordinal.fit(doc, column, matrix[rated][doc, column], g, len(picked), int(g.max()) + 1)
    return 1 / (1 + np.exp(-(matrix @ weights)[:, None] + thresholds[None, :]))
