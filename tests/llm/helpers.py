"""Brute-force versions that tests hold the operators against."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = re.compile(r"[\x20\x09-\x0D]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def exact(docs):
    """[(id, text)] -> {position: (keep_id, group_size, kept, sha)}."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(docs):
        groups[hashlib.sha256(WHITE.sub("", t or "").encode()).hexdigest()].append((-len(t or ""), d, i))
    out = {}
    for sha, members in groups.items():
        keep = min((m[:2] for m in members), key=lambda m: (m[0], m[1] is None, m[1]))[1]
        for _, d, i in members:
            out[i] = (keep, len(members), d == keep, sha)
    return out


def repeats(docs, length):
    """{id: text} -> {id: (n_words, n_removed, sha, kept words)}."""
    words = {k: WORD.findall(t or "") for k, t in docs.items()}
    count = Counter(tuple(x[i : i + length]) for x in words.values() for i in range(len(x) - length + 1))
    out = {}
    for k, x in words.items():
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if count[tuple(x[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = [w for w, g in zip(x, gone) if not g]
        out[k] = (len(x), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near(docs, k, percent=80):
    """{id: text} -> {id: component}."""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}
