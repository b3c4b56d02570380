"""Plain forms of the operators, to test against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def shingles(text, k):
    w = words(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs, k, percent):
    """Smallest id of each document's component; docs is a dict of texts by id."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    label = {i: i for i in docs}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def quality(text, min_repeat=8, most_covered=24, longest=50):
    text = text or ""
    w = words(text)
    n = len(w)
    tri = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    rep, cov, best, repeated = [0] * n, [0] * n, 0, set()
    for i in range(n - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            rep[i : i + 3] = [1] * 3
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= min_repeat:
                best = max(best, k)
                repeated.add(tuple(w[i : i + k]))  # not all its occurrences go on with the same word
                cov[i : i + k] = [1] * k
                cov[j : j + k] = [1] * k
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = n < 50 or 100 * sum(rep) > 50 * n
    kept = not failed and 100 * sum(cov) <= most_covered * n and best <= longest
    before = {x: [w[i - 1] if i else None for i in range(n) if tuple(w[i : i + len(x)]) == x] for x in repeated}
    maximal = sum(None in b or len(set(b)) > 1 for b in before.values())
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, sum(rep), failed, kept, sum(cov), best, maximal


def dedup(docs, min_words=50):
    """Kept text by id for a dict of texts by integer id."""
    places, spans = {}, {i: [] for i in docs}
    windows = []
    for i in sorted(docs):
        lines = [(k, x, len(words(x))) for k, x in enumerate(docs[i].split("\n")) if words(x)]
        for a in range(len(lines)):
            for step, side in ((1, "ahead"), (-1, "behind")):
                got, n, b = [], 0, a
                while 0 <= b < len(lines) and n < min_words:
                    got.append(lines[b])
                    n += lines[b][2]
                    b += step
                if n >= min_words:
                    got.sort()
                    windows.append((i, got[0][0], got[-1][0], side, tuple(x for _, x, _ in got)))
    for w in sorted(windows, key=lambda w: w[:2]):
        places.setdefault(w[3:], w[:2])
    for i, a, b, *content in windows:
        if places[tuple(content)] < (i, a):
            spans[i] += range(a, b + 1)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in spans[i]) for i, t in docs.items()}


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def crc16(raw):
    c = 0xFFFF
    for byte in raw:
        for k in range(7, -1, -1):
            c = (c << 1 ^ (0x8005 if (c >> 15) ^ (byte >> k & 1) else 0)) & 0xFFFF
    return c


def audio(payload):
    """The stored form of a payload, put together from the format's description, and how many frames it has."""
    kbits = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    safe = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))

    def frame(index, content):
        head = bytes([0xFF, 0xFA, index * 16 + 8, 0xC4])
        whole = head + crc16(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17) + content
        return whole + bytes(kbits[index - 1] * 9 // 2 - len(whole))

    parts = [payload[k : k + 1417] for k in range(0, len(payload), 1417)]
    frames = [frame(next(i for i in range(1, 15) if kbits[i - 1] * 9 // 2 - 23 >= len(x)), x) for x in parts]
    places = [432 + sum(map(len, frames[:k])) for k in range(len(frames))]
    total = 432 + sum(map(len, frames))
    toc = bytes(min(255, 256 * places[len(frames) * i // 100] // total) for i in range(100))
    table = frame(7, b"Xing" + b"".join(n.to_bytes(4, "big") for n in (7, len(frames), total)) + toc)
    tag = b"bytes\0" + len(payload).to_bytes(8, "big") + zlib.crc32(payload).to_bytes(4, "big")
    body = b"PRIV" + safe(len(tag)) + bytes(2) + tag
    return b"ID3\x04\0\0" + safe(len(body)) + body + table + b"".join(frames), len(frames)


def winners(pages, scored):
    """Each host's path with the most votes; pages are (host, page), scored gives a page's scores by path."""
    votes = {}
    for host, page in pages:
        found = scored(page)
        for path, x in found.items():
            votes.setdefault(host, Counter())[path] += round(1_000_000 * x / max(found.values()))
    return {host: max(v.items(), key=lambda x: (x[1], x[0]))[0] for host, v in votes.items()}
