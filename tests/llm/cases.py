"""Small inputs that hold every awkward case, and brute-force results in plain Python."""

import re
from collections import Counter, defaultdict

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def text_of(k: int, n: int) -> str:
    """Prose of ``n`` words that differs by ``k``."""
    return " ".join(f"w{(k * 7919 + i * i * 31) % 9973}" for i in range(n))


LONG = text_of(5, 9000)
COPY = text_of(1, 300)
ROWS = [
    (1, COPY, "en"), (2, COPY, "en"), (3, COPY.replace("w3", "x3", 1), "en"), (4, None, "en"), (5, "", "en"), (6, " \n\t ", None),
    (7, "two words", "en"), (8, "Two WORDS", "en"), (9, LONG, "en"), (10, "prefix " + LONG[:4000] + " suffix", "en"),
    (11, "!!! 123 ???", "en"), (12, "été déjà öß 日本 🎉", "fr"), (13, text_of(2, 40) + " " + text_of(1, 60), "en"),
    (14, ("a" * 900), "en"), (15, "b " * 700, "en"), (None, COPY, "en"), (None, None, None), (16, text_of(3, 20), "en"), (16, text_of(3, 20), "en"),
    (17, text_of(4, 30), "en"), (17, text_of(6, 30), "en"),
]
SCHEMA = "doc_id long, text string, lang string, source string, key int, kind string, n_chars long"


def documents(spark, rows=ROWS):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, g, "s", 7, "k", len(t) if t else None) for d, t, g in rows], SCHEMA)


def raw(text):
    return (text or "").encode()


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in raw(text))


def shingles(text, width):
    w = WORDS.findall(lowered(text))
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def jaccard_components(rows, width, percent):
    """Sorted (doc_id, shingles, least id of the component)."""
    sets = [shingles(t, width) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((r[0], len(sets[i]), ids[root(i)]) for i, r in enumerate(rows)), key=str)


def without_repeated_words(rows, width):
    last = (1 << 63) - 1
    least = {}
    docs = [(last if d is None else d, WORDS.findall(raw(t))) for d, t, _ in rows]
    for d, w in docs:
        for i in range(len(w) - width + 1):
            g = tuple(w[i:i + width])
            least[g] = min(least.get(g, d), d)
    out = []
    for (d, w), (own, _, _) in zip(docs, rows):
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        out.append((own, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def without_repeated_bytes(rows, width):
    seen = Counter(raw(t)[i:i + width] for _, t, _ in rows for i in range(len(raw(t)) - width + 1))
    out = []
    for d, t, _ in rows:
        b = raw(t)
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)
