"""Brute-force versions, in plain Python, of what the operators compute."""

from __future__ import annotations

import random
import re

import numpy as np

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, schema="doc_id long, text string"):
    rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def simhash(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in WORDS.findall((text or "").encode())]
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows):
    """rows (doc_id, text): list of (doc_id, fingerprint, component_id)."""
    fps = [simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    root = components(len(rows), links)
    least = {}
    for (doc, _), r in zip(rows, root, strict=True):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [(doc, f"{fp:016x}", least.get(r)) for (doc, _), fp, r in zip(rows, fps, root, strict=True)]


def without_repeats(texts, window=35):
    """(number of words, words kept) of each text."""
    split = [WORDS.findall((t or "").encode()) for t in texts]
    seen: dict = {}
    for w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), [x for k, x in enumerate(w) if k not in gone]))
    return out


def without_repeated_chunks(rows):
    """rows (doc_id, text), ids distinct: (number of lines, lines kept) of each. A line goes if it is in two neighbouring lines, not both of white space, that came before."""
    found: dict = {}
    split = [(t or "").encode().split(b"\n") if t else [] for _, t in rows]
    for k, ((doc, _), ls) in enumerate(zip(rows, split, strict=True)):
        for i in range(len(ls) - 1):
            if (ls[i] + ls[i + 1]).strip():
                found.setdefault((ls[i], ls[i + 1]), []).append((doc is None, doc or 0, i, k))
    gone: dict = {}
    for places in found.values():
        for *_, i, k in sorted(places)[1:]:
            gone.setdefault(k, set()).update((i, i + 1))
    return [(len(ls), [x for i, x in enumerate(ls) if i not in gone.get(k, ())]) for k, ls in enumerate(split)]


def near_copies(rows, width=5):
    """rows (doc_id, text), ids distinct: the least id of those that pairs of similar texts connect, of each row. Similar: Jaccard of the sets of five words 0.8 or more; texts without words are one group."""
    sets = []
    for _, t in rows:
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in WORDS.findall((t or "").encode())]
        sets.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) > width else {tuple(words)} - {()})
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    least: dict = {}
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    for (doc, _), r in zip(rows, root, strict=True):
        least[r] = min(doc, least.get(r, doc))
    return [least[r] for r in root]


def sample_texts(seed=0, n=60, words=400):
    """Texts that share passages, lines and whole copies, with empty and null ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    text = lambda k: " ".join(word() if rng.random() > 0.08 else word() + "\n" + word() for _ in range(k))
    passages = [text(rng.randint(30, 90)) for _ in range(6)]
    out = [text(rng.randint(0, words)) for _ in range(n)]
    for k in range(0, n, 3):
        cut = rng.randint(0, len(out[k]))
        out[k] = out[k][:cut] + " " + rng.choice(passages) + "\n" + out[k][cut:]
    out += [out[4], out[4], out[9] + " x", "", None, None, " ", "one", "same " * 300, "same " * 80, "a\n\nb\n\nc\n\nd"]
    return out


def vectors_near(seed=0, dim=16, clusters=8, each=6, spread=0.05, alone=100):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    rows = [c + spread * rng.standard_normal(dim) for c in centres for _ in range(each)] + list(rng.standard_normal((alone, dim)))
    return np.array(rows, np.float32)
