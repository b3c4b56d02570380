"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained on the driver from a small labelled table of sentences (made by rule, from a seed, unless another
is given) by gradient steps on the exact log-likelihood. A word's features depend on its shape class only, so the
scores of a class are computed once; a line's scores are sums of the classes' of each word and its neighbours. Lines
where 'no personal data' provably has the best score at once, by a bound on what any other labels could gain, are
passed; all others are decoded by Viterbi, in numpy batches of lines padded to one length.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.llm.common import small_batches, table

BASE = ("email", "ip", "card", "phone")
#: Labels of the field: none, the kinds of the patterns in freer forms, credentials, and numbers of identity or bank.
LABELS = ("none", "email", "ip", "card", "phone", "secret", "ident")
KINDS = (*BASE, "secret", "ident")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_CLASS = "A-Za-z0-9._%+-"
_EMAIL = re.compile(rf"[{_CLASS}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(rf"[{_CLASS}]+$")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


# ------------------------------------------------------------------ patterns


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches. A match's only @ follows a whole run of the class, so each @ is tried from its run's start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LETTERS:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the patterns' matches, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def plausible(label: str, span: str) -> bool:
    """Whether a span of the field can be what its label says: card numbers pass Luhn, addresses have four parts, phones 7 to 15 digits."""
    digits = re.sub(r"[^0-9]", "", span)
    if label == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    if label == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if label == "phone":
        return 7 <= len(digits) <= 15
    if label == "email":
        return "@" in span or bool(re.search(r"[\[(<]at[\])>]", span, re.I))
    return len(span) >= 9 and any(c.isalnum() for c in span)


# ------------------------------------------------------------------ features

TRIGGERS = frozenset(
    b"password passwd pwd passphrase secret token key api apikey ssn iban phone tel telephone mobile fax call email mail card visa credit account ip host".split()
)
_SHAPE = bytes.maketrans(
    bytes(range(256)),
    bytes(ord("0") if 48 <= c < 58 else ord("A") if 65 <= c < 91 else ord("a") if 97 <= c < 123 else ord("w") if c >= 128 else c for c in range(256)),
)
_RUNS = re.compile(rb"(.)\1*", re.S)
_STRIP = b".,;:!?\"'()[]{}<>|*#$%&"


@functools.lru_cache(maxsize=None)
def _features(word_class: tuple) -> list[str]:
    shape, length, digits, trigger, mixed, caps = word_class
    inner = shape.strip(_STRIP.decode())
    out = ["bias", f"shape {inner}", f"digits {digits}", f"trigger {trigger}", f"mixed {mixed}", f"caps {caps}", f"mixed {mixed} {caps} {length}"]
    out += [f"has {c}" for c in "@.-+()=/:\"_" if c in shape]
    plain = re.sub(r"0\d?", "0", inner)
    out += [f"plain {plain}", f"start {plain[:2]}", f"end {plain[-2:]}", f"digits {digits} has. {'.' in shape} has- {'-' in shape} has@ {'@' in shape} ={'=' in shape}"]
    return out


#: Runs of a shape that are written out; a shape of more is told by its first and last runs, its kinds of signs and its size.
WRITTEN_RUNS = 16


def word_class(word: bytes) -> tuple:
    """What the features know of a word, all of it: the shape by runs, digits counted, and what mixes letters and digits."""
    pieces, digits, turns, last = [], 0, 0, b""
    shape = word.translate(_SHAPE)
    if shape.isalpha() and b"0" not in shape:
        pieces = _RUNS.sub(rb"\1", shape).decode("latin-1")
    else:
        for m in _RUNS.finditer(shape):
            c, n = m[1], len(m[0])
            if c == b"0":
                digits += n
                pieces.append(f"0{min(n, 7)}")
            else:
                pieces.append(c.decode("latin-1"))
            turns += c.isalnum() and last.isalnum()
            last = c
    if len(pieces) > WRITTEN_RUNS:
        kinds = "".join(sorted(set(shape.decode("latin-1"))))
        pieces = [*pieces[:2], "~", kinds, "~", *pieces[-2:]]
    text = "".join(pieces)
    bare = word.strip(_STRIP).lower()
    stem = re.split(rb"[=:_]", bare, maxsplit=1)[0]
    trigger = stem.decode() if stem in TRIGGERS else bare.decode() if bare in (b"at", b"dot") and word[:1] in (b"[", b"(", b"<") else ""
    n = len(shape)
    mixed = min(turns, 6) // 2 if digits >= 3 and n >= 12 else 0
    length = 0 if n < 8 else 1 if n < 12 else 2 if n < 18 else 3 if n < 28 else 4
    return text, length, min(digits, 20), trigger, mixed, shape.replace(b"0", b"").isupper() and b"a" not in shape and b"w" not in shape


EDGE = ("<edge>", 0, 0, "", 0, False)


def _near(side: str, wc: tuple) -> list[str]:
    shape, _, digits, trigger, mixed, _ = wc
    plain = re.sub(r"0\d?", "0", shape.strip(_STRIP.decode()))
    return [f"{side} trigger {trigger}", f"{side} digits {min(digits, 8)}", f"{side} plain {plain}", f"{side} {shape[-1:] if shape else ''}{' m' if mixed else ''}"]


# ------------------------------------------------------------------ labelled table


def labelled_table(n: int = 900, seed: int = 11) -> list[list[tuple[str, str]]]:
    """n sentences of (word, label), made by rule: invented words, ordinary numbers and signs, and personal data in many forms."""
    r = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve sch ung keit eau tion mente ció ñ é ü ö".split()
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    caps = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
    low = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def ordinary() -> list[str]:
        w = low()
        kind = r.random()
        if kind < 0.62:
            return [w]
        if kind < 0.72:
            return [w.capitalize() + r.choice(["", ",", "."])]
        if kind < 0.78:
            return [w + r.choice(["***", "###", "$$$", "%%%", "&&&", ".", ",", "!", "?", ";", ".***", ",%%%"])]
        if kind < 0.88:
            return [r.choice([d(1), d(2), d(3), d(4), "2.0", "4.0.", "2.0.", "3.", f"{d(1)}.{d(2)}", f"{d(1)},{d(3)}", f"{d(2)}%", f"${d(2)}.{d(2)}", f"{r.randint(1900, 2030)}", f"(c) {r.randint(1990, 2026)}".split()[1], f"{d(2)}:{d(2)}", f"{r.randint(1990, 2026)}-{d(2)}-{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(1)}-{d(1)}", f"{d(5)}", f"{d(6)}", f"#{d(3)}"])]
        if kind < 0.93:
            return [r.choice(["|", "-", "CC", "BY-NC", "MIT", "GNU", "Apache", "License,", "Version", "3.0", "A.B.", w.upper(), f"{w}-{w}", f"{w}/{w}", f"http://{w}.com/{w}", f"www.{w}.org", f"https://{w}.example.net/{d(3)}", f"{w}_{d(1)}", f"{w}{d(2)}", f"{w.capitalize()}{w.capitalize()}", "|", "****", "====", "@", "+", "e.g.", f"@{low()}", "(" + w + ")"])]
        return [r.choice(["key", "token", "password", "phone", "mail", "card", "at", "call", "account", "secret", "email", "host", "dot"]) + r.choice(["", "", ",", "."])]

    def personal() -> tuple[list[str], str]:
        name = r.choice([low() + d(2), f"{low()}.{d(2)}", f"{low()}.{low()}", low()])
        name = name.encode("ascii", "ignore").decode() or "ab"
        host, end = (low() + d(1)).encode("ascii", "ignore").decode() or "h", r.choice(["com", "org", "net", "example.com"])
        card = r.choice(["4", "5", "37", "6011"])
        card += d(16 - len(card))
        ip = ".".join(str(r.randint(1, 255)) for _ in range(4))
        a, b, c = d(3), d(3), d(4)
        choice = r.choice(["email", "email2", "ip", "card", "card4", "phone", "phone2", "phone3", "aws", "password", "token", "apikey", "ssn", "iban"])
        tail = r.choice(["", "", "", ".", ","])
        return {
            "email": ([f"{name}@{host}.{end}{tail}"], "email"),
            "email2": ([name, r.choice(["[at]", "(at)", "<at>"]), host, r.choice(["[dot]", "(dot)", "<dot>"]), r.choice(["com", "org", "net"])], "email"),
            "ip": ([ip + tail], "ip"),
            "card": ([card + tail], "card"),
            "card4": ([card[:4], card[4:8], card[8:12], card[12:] + tail] if r.random() < 0.6 else ["-".join([card[:4], card[4:8], card[8:12], card[12:]]) + tail], "card"),
            "phone": ([f"+{d(r.randint(1, 2))}", f"({a})", f"{b}-{c}{tail}"], "phone"),
            "phone2": (r.choice([[f"({a})", f"{b}-{c}{tail}"], [f"{a}-{b}-{c}{tail}"], [f"+{d(2)}", d(3), d(4), d(3)]]), "phone"),
            "phone3": ([f"+{d(11)}{tail}"], "phone"),
            "aws": (["AKIA" + caps(16) + tail], "secret"),
            "password": ([r.choice(["password=", "passwd=", "pwd=", "secret="]) + r.choice([hexa(18), hexa(12), hexa(24), low().encode("ascii", "ignore").decode() + d(4) + "!x"]) + tail], "secret"),
            "token": ([r.choice(["token", "api_key", "secret", "password"]), r.choice(["=", ":"]), r.choice([f'"{hexa(40)}"', f"'{hexa(32)}'", hexa(40)])], "secret token"),
            "apikey": ([r.choice(["sk-", "ghp_", "xoxb-", "pk_"]) + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36)) + tail], "secret"),
            "ssn": ([f"{d(3)}-{d(2)}-{d(4)}{tail}"], "ident"),
            "iban": (r.choice([[f"{r.choice(['DE', 'FR', 'GB', 'ES'])}{d(2)}", d(4), d(4), d(4), d(4), d(2)], [f"{r.choice(['DE', 'ES'])}{d(20)}"]]), "ident"),
        }[choice]

    sentences = []
    for k in range(n):
        words: list[tuple[str, str]] = []
        for _ in range(r.randint(3, 14)):
            if k % 9 == 0:
                words += [(r.choice(["at", "at.", "at", "dot", "at***"]), "none")]
            words += [(w, "none") for w in ordinary()]
        for _ in range((k % 3 != 0) * r.randint(1, 2)):
            got, label = personal()
            given = [(w, "secret" if label == "secret token" and i == len(got) - 1 else "none" if label == "secret token" else label) for i, w in enumerate(got)]
            # what follows at once may be personal data, too, but then of another kind
            at = r.randint(0, len(words))
            while 0 < at < len(words) and words[at][1] != "none" and words[at - 1][1] != "none":
                at -= 1
            words[at:at] = [("and", "none"), *given] if at and words[at - 1][1] != "none" else given
        sentences.append(words)
    return sentences


# ------------------------------------------------------------------ the field


#: Word classes held at most, but for a line of more words; words of the lines that are labelled at once.
MAX_CLASSES, CHUNK_WORDS = 200_000, 100_000


class Field:
    """Weights of features by label, transitions, and what follows from them for each word class."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.index, self.weights, self.steps = index, weights, steps
        self.ids: dict[bytes, int] = {}
        self.classes: dict[tuple, int] = {}
        self.own, self.left, self.right = [], [], []
        self.bounds: list[tuple[float, float, float]] = []
        self.edge = self._class(EDGE)
        #: what a transition can gain over none-none; each word that isn't none takes part in two
        self.gain = 2 * max(0.0, float(steps.max() - steps[0, 0]))

    def _sum(self, names: list[str]) -> np.ndarray:
        return sum((self.weights[i] for n in names if (i := self.index.get(n)) is not None), np.zeros(len(LABELS)))

    def _class(self, wc: tuple) -> int:
        if wc not in self.classes:
            self.classes[wc] = len(self.own)
            three = self._sum(_features(wc)), self._sum(_near("after", wc)), self._sum(_near("before", wc))
            self.own.append(three[0]), self.left.append(three[1]), self.right.append(three[2])
            self.bounds.append(tuple(float((v[0] - v[1:]).min()) for v in three))
        return self.classes[wc]

    def number(self, word: bytes) -> int:
        got = self.ids.get(word)
        if got is None:
            got = self._class(word_class(word))
            if len(self.ids) >= 400_000:
                self.ids.clear()
            self.ids[word] = got
        return got

    def viterbi(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of a batch of lines: scores[line, word, label], the lines having sizes words."""
        n, longest, k = scores.shape
        back = np.zeros((n, longest, k), np.int8)
        best = scores[:, 0] + self.steps[0]  # a line begins, and ends, as after 'none'
        for t in range(1, longest):
            through = best[:, :, None] + self.steps
            back[:, t] = through.argmax(1)
            best = np.where((t < sizes)[:, None], through.max(1) + scores[:, t], best)
        label = (best + self.steps[:, 0]).argmax(1)
        out = np.zeros((n, longest), np.int8)
        for t in range(longest - 1, -1, -1):
            inside = t < sizes
            out[inside, t] = label[inside]
            if t:
                label = np.where(inside, back[np.arange(n), t, label], label)
        return out

    def lines(self, raw: list[list[bytes]]) -> list[tuple[int, np.ndarray]]:
        """(line, labels) for every line that has any other label than none."""
        found, at = [], 0
        while at < len(raw):
            stop, words = at + 1, len(raw[at])
            while stop < len(raw) and words + len(raw[stop]) <= CHUNK_WORDS:
                words += len(raw[stop])
                stop += 1
            self._room(words)
            found += [(at + i, labels) for i, labels in self._chunk(raw[at:stop])]
            at = stop
        return found

    def _chunk(self, raw: list[list[bytes]]) -> list[tuple[int, np.ndarray]]:
        """lines() of some lines whose word classes are all held at once."""
        flat = [self.edge]
        for words in raw:
            flat += map(self.number, words)
            flat.append(self.edge)
        ids = np.array(flat, np.int64)
        bounds = np.array(self.bounds)
        sizes = np.array([len(x) for x in raw], np.int64)
        starts = np.r_[0, np.cumsum(sizes + 1)][:-1] + 1
        margin = bounds[ids, 0].copy()
        margin[1:] += bounds[ids[:-1], 1]
        margin[:-1] += bounds[ids[1:], 2]
        doubtful = margin < self.gain
        doubtful[0] = False
        doubtful[starts + sizes] = False
        todo = np.flatnonzero((sizes > 0) & (np.add.reduceat(np.r_[doubtful, False], np.stack([starts, starts + sizes], 1).ravel())[::2] > 0)) if len(raw) else []
        own, left, right = np.array(self.own), np.array(self.left), np.array(self.right)
        found = []
        order = sorted(todo, key=lambda i: sizes[i])
        at = 0
        while at < len(order):
            batch = [order[at]]
            while at + len(batch) < len(order) and (len(batch) + 1) * sizes[order[at + len(batch)]] <= 20_000:
                batch.append(order[at + len(batch)])
            longest = int(sizes[batch[-1]])
            place = np.minimum(starts[batch][:, None] + np.arange(longest), len(ids) - 2)
            labels = self.viterbi(own[ids[place]] + left[ids[place - 1]] + right[ids[place + 1]], sizes[batch])
            found += [(int(i), labels[k, : sizes[i]]) for k, i in enumerate(batch) if labels[k].any()]
            at += len(batch)
        return sorted(found, key=lambda x: x[0])

    def _room(self, n: int) -> None:
        """Forgets the shapes seen so far before n words that may not fit, never among them: their numbers must stay.

        So memory is bounded by MAX_CLASSES, or by the longest line.
        """
        if len(self.classes) + n > MAX_CLASSES:
            _features.cache_clear()
            self.__init__(self.index, self.weights, self.steps)


def train(sentences: list[list[tuple[str, str]]], *, epochs: int = 120, rate: float = 0.12, l2: float = 2e-3) -> Field:
    """The field that maximises the penalised log-likelihood of the labels, by Adam over all sentences at once."""
    index: dict[str, int] = {}
    rows = []
    for s in sentences:
        wcs = [EDGE, *(word_class(w.encode()) for w, _ in s), EDGE]
        rows.append([[index.setdefault(f, len(index)) for f in (*_features(wcs[i]), *_near("after", wcs[i - 1]), *_near("before", wcs[i + 1]))] for i in range(1, len(wcs) - 1)])
    n, longest, k, width = len(rows), max(map(len, rows)), len(LABELS), max(len(f) for row in rows for f in row)
    spare = len(index)
    feats = np.full((n, longest, width), spare)
    gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, row in enumerate(rows):
        for t, f in enumerate(row):
            feats[i, t, : len(f)] = f
            gold[i, t], mask[i, t] = LABELS.index(sentences[i][t][1]), True
    sizes = mask.sum(1)
    weights, steps = np.zeros((spare + 1, k)), np.zeros((k, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(steps), np.zeros_like(steps)]
    hot = np.eye(k)[gold] * mask[..., None]
    seen = np.zeros((k, k))
    for i in range(n):
        path = [0, *gold[i, : sizes[i]], 0]
        np.add.at(seen, (path[:-1], path[1:]), 1)
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for epoch in range(1, epochs + 1):
        e = weights[feats].sum(2)
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = e[:, 0] + steps[0]
        for t in range(1, longest):
            a = lse(alpha[:, t - 1][:, :, None] + steps, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t][:, None], a, alpha[:, t - 1])
        total = lse(alpha[:, -1] + steps[:, 0], 1)
        beta[:] = steps[:, 0]
        for t in range(longest - 2, -1, -1):
            b = lse(steps[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1][:, None], b, steps[:, 0])
        p = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        pair = alpha[:, :-1, :, None] + steps + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum((0, 1))
        expected[0] += p[:, 0].sum(0)
        expected[:, 0] += p[np.arange(n), sizes - 1].sum(0)
        g = np.zeros_like(weights)
        np.add.at(g, feats.reshape(-1), np.repeat((p - hot).reshape(-1, k), width, 0))
        grads = g / n + l2 * weights, (expected - seen) / n + l2 * steps
        for j, (w, gr) in enumerate(zip((weights, steps), grads, strict=True)):
            m, v = state[2 * j], state[2 * j + 1]
            m += 0.1 * (gr - m)
            v += 0.01 * (gr * gr - v)
            w -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
        weights[spare] = 0
    return Field(index, weights[:spare], steps)


@functools.lru_cache(maxsize=1)
def default_field() -> tuple[dict, np.ndarray, np.ndarray]:
    f = train(labelled_table())
    return f.index, f.weights, f.steps


# ------------------------------------------------------------------ texts


def find(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(spans of the patterns, all spans) of each text, as (start, index in KINDS, end), sorted.

    Spans of the field that overlap one of the patterns' are dropped; the patterns' stay.
    """
    base = [base_spans(t) for t in texts]
    lines, of = [], []
    for k, t in enumerate(texts):
        for line in t.encode().split(b"\n"):
            lines.append(line.split())
            of.append(k)
    more: dict[int, list[tuple[int, np.ndarray]]] = {}
    first: dict[int, int] = {}
    for i, k in enumerate(of):
        first.setdefault(k, i)
    for i, labels in field.lines(lines):
        more.setdefault(of[i], []).append((i - first[of[i]], labels))
    out = []
    for k, t in enumerate(texts):
        spans = list(base[k])
        if k in more:
            starts, at = [0], t.find("\n")
            while at >= 0:
                starts.append(at + 1)
                at = t.find("\n", at + 1)
            taken = sorted((a, b) for a, _, b in spans)
            for line, labels in more[k]:
                stop = starts[line + 1] - 1 if line + 1 < len(starts) else len(t)
                words = list(WORD.finditer(t, starts[line], stop))
                i = 0
                while i < len(labels):
                    j = i
                    while j < len(labels) and labels[j] == labels[i]:
                        j += 1
                    if labels[i]:
                        a, b = words[i].start(), words[j - 1].end()
                        while b > a and t[b - 1] in ".,;:!?\"'>|#*%&$":
                            b -= 1
                        while a < b and t[a] in "\"'<|":
                            a += 1
                        label = LABELS[labels[i]]
                        if a < b and plausible(label, t[a:b]) and not any(x < b and a < y for x, y in taken):
                            spans.append((a, KINDS.index(label), b))
                    i = j
            spans.sort()
        out.append((base[k], spans))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: list | None = None) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_spans, spans for each row of docs; spans are kind:start:end, in code points.

    sentences: the labelled table to train on, lists of (word, label of LABELS); None: labelled_table(). Null texts count as
    empty and have no span; null ids are kept; repeated rows are each done; other columns are dropped. Ties of start go
    by kind as listed in KINDS. An empty table gives no row. No shuffle; memory follows the longest text.
    """
    model = default_field() if sentences is None else (lambda f: (f.index, f.weights, f.steps))(train(sentences))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # as large as the labelled table's features: some hundred kilobytes
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = docs.select("id").schema
    for name in ("n_email", "n_ip", "n_card", "n_phone"):
        schema = schema.add(name, "long")
    schema = schema.add("base_spans", "string").add("spans", "string")

    def run(batches):
        field = Field(*shipped.value)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for at in range(0, batch.num_rows, 200):
                got = find([x or "" for x in texts[at : at + 200].to_pylist()], field)
                counts = [pa.array([sum(s[1] == k for s in b) for b, _ in got], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([ids[at : at + 200], *counts, pa.array([written(b) for b, _ in got], pa.string()), pa.array([written(s) for _, s in got], pa.string())], names=schema.names)

    return small_batches(docs).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
