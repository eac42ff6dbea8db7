"""Plain versions of the operators' contracts, text by text."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_row(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
        len(words) < 20 or 100 * len(hit) > 30 * len(words),
    )


def hits(text, items, width=10):
    words = PLAIN.findall(lower(text))
    windows = defaultdict(set)
    for name, item in items:
        w = PLAIN.findall(lower(item))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(name))
    hit, found = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            names = windows.get(tuple(words[i : i + size]))
            if names:
                hit.update(range(i, i + size))
                found |= names
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} from {source: size}."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / free > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        full |= over


def revisits(pages):
    """[(page_id, bytes, digest, type, refers_to)] from [(page_id, html)]."""
    largest = {}
    for i, html in pages:
        key = (html or "").encode()
        largest[key] = max(largest.get(key, i), i)
    out = []
    for i, html in pages:
        data = (html or "").encode()
        keeper = largest[data]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == keeper else "revisit", None if i == keeper else keeper))
    return out


def cut_repeats(docs, length=100):
    """{doc_id: (bytes, removed, spans, sha256)}."""
    met, out = set(), {}
    for doc, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in met:
                gone[i : i + length] = b"\1" * length
            met.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len([1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])])
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(docs):
    """{doc_id: (shingles, component)}."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for d, s in sets.items():
        for t in s:
            by[t].add(d)
    for d, s in sets.items():
        for e in {e for t in s for e in by[t] if e < d}:
            both = len(s & sets[e])
            if 100 * both >= 75 * (len(s) + len(sets[e]) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def thin_lines(docs, width=3):
    """{doc_id: kept text} after removing later occurrences of line windows."""
    first, spots = {}, []
    for doc, text in sorted(docs, key=lambda x: x[0]):
        rows = [] if text is None else text.split("\n")
        for i in range(len(rows) - width + 1):
            w = tuple(x if WORD.search(x) else "" for x in rows[i : i + width])
            if any(w):
                if w in first:
                    spots.append((doc, i))
                else:
                    first[w] = (doc, i)
    gone = defaultdict(set)
    for doc, i in spots:
        gone[doc].update(range(i, i + width))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def tokens(word, pieces, unknown):
    """Fewest tokens among the segmentations of highest score."""
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * unknown, -(-best[end - 1][1] + 0) + size)]
        for start in range(end):
            if word[start:end] in pieces:
                options.append((best[start][0] + pieces[word[start:end]], best[start][1] + 1))
        best[end] = max(options, key=lambda x: (x[0], -x[1]))
    return best[-1][1]
