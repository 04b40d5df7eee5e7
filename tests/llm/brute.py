"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash


def sha(data):
    return hashlib.sha256(data).hexdigest()


def spans_of(flags):
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def repeated_bytes(rows, length):
    count = Counter(t[i:i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if count[text[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out.append((doc, len(text), sum(gone), spans_of(gone), sha(kept)))
    return out


def repeated_words(rows, length):
    split = sorted((doc, re.findall(rb"[^\x20\x09-\x0D]+", text)) for doc, text in rows)
    seen, out = set(), []
    for doc, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i:i + length])
            if window in seen:
                gone[i:i + length] = [True] * length
            seen.add(window)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc, len(words), sum(gone), sha(b" ".join(kept))))
    return out


def fingerprint(text, shingle=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [words[i:i + shingle] for i in range(len(words) - shingle + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, radius):
    """id -> least id reachable over fingerprints within the radius."""
    label = {}
    ids = defaultdict(list)
    for i, f in fingerprints:
        ids[f].append(i)
    todo = set(ids)
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            f = edge.pop()
            group.add(f)
            near = {g for g in todo if (f ^ g).bit_count() <= radius}
            todo -= near
            edge += near
        least = min(i for f in group for i in ids[f])
        label.update({i: least for f in group for i in ids[f]})
    return label


def contamination(rows, items, size=10):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i:i + size])].add(item)
    out = []
    for doc, text in rows:
        w, found = words(text), set()
        hit = [False] * len(w)
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if (key := tuple(w[i:i + m])) in windows:
                    found |= windows[key]
                    hit[i:i + m] = [True] * m
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        n = len({i for i in found if i is not None})
        out.append((doc, len(w), sum(hit), n, sha(listed.encode()), any(hit)))
    return out
