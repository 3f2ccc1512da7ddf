"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return ({tuple(words)} if words else set()) if len(words) < size else {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_groups(docs, percent):
    sets = {i: shingles(t) for i, t in docs}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return bool(sets[a] and sets[b]) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)

    return components(sorted(sets), linked), {i: len(s) for i, s in sets.items()}


def repeats(docs, size=200):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[k : k + size] for _, b in texts for k in range(len(b) - size + 1))
    out = {}
    for d, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\x01" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def item_words(text):
    spaced = re.sub(r"([฀-໿က-႟ក-៿ぁ-ゖァ-ヺ一-鿿])", r" \1 ", (text or "").lower())
    return re.findall(r"[^\W_]+", spaced)


def leaks(docs, items):
    """(doc_id, item_id) of every window of every text against every item, by plain sets."""
    parted = []
    for i, t in items:
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", (t or "").strip()) if s]
        q, a = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (t, "")
        q, a = item_words(q), item_words(a)
        if q or a:
            parted.append((i, *((q, a) if q else (a, q))))
    size = lambda q, a: max(64, 1 << (len(q) + len(a) - 1).bit_length())
    found = set()
    for c in {size(q, a) for _, q, a in parted}:
        mine = [(i, q, a) for i, q, a in parted if size(q, a) == c]
        stride = max(len(q) + len(a) for _, q, a in mine) * 5 // 4 + 1
        for d, t in docs:
            words = item_words(t)
            for k in range(0, max(1, len(words)), stride):
                window = words[k : k + 2 * stride]
                for i, q, a in mine:
                    n = min(5, len(q))
                    want = {tuple(q[x : x + n]) for x in range(len(q) - n + 1)}
                    have = {tuple(window[x : x + n]) for x in range(len(window) - n + 1)}
                    if 5 * len(want & have) >= 4 * len(want) and 5 * len(set(a) & set(window)) >= 4 * len(set(a)):
                        found.add((d, i))
    return found
