"""Plain versions of the operators for small tables."""

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grams(text, k):
    words = spaced((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i: i + k]) for i in range(len(words) - k + 1))


def groups(nodes, links):
    """Least node that links reach, for each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def removed(rows, length):
    """Kept words and number removed, by (id, text)."""
    owner = {}
    for doc, text in rows:
        words = spaced(text)
        if doc is None:
            continue
        for i in range(len(words) - length + 1):
            w = tuple(words[i: i + length])
            owner[w] = min(owner.get(w, doc), doc)
    out = defaultdict(list)
    for doc, text in rows:
        words = spaced(text)
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if doc is not None and owner[tuple(words[i: i + length])] < doc:
                gone[i: i + length] = [True] * length
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc].append((len(words), sum(gone), sha(kept)))
    return out
