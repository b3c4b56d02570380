"""Byte-level BPE encoding and decoding.

Texts are split by a pattern, and each match is encoded by itself: of all neighbouring pairs the one with the lowest
rank, the leftmost of them, is merged until none has a rank. The pairs wait in a rank queue: a bucket for each rank
holds a linked list of positions, in order, and a hierarchical bitmap of the filled buckets gives the lowest rank by
find-first-set on one word of each level. Pairs that a merge has changed are not searched for; their entries are stale
and skipped when they come up. So a match of n bytes costs O(n log n) at worst, however long it is. Short matches share a
queue, many at once, which takes a bucket's pairs of all of them in one go.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.llm.common import small_batches, table

#: How an id is stored: two bytes hold the ranks of two levels of bitmap.
ID = np.dtype(np.uint16)
#: Bits of a bitmap word; with two levels they hold BITS * BITS ranks. ONE[b] is the word with bit b.
BITS = 256
ONE = [1 << b for b in range(BITS)]
#: Encoded matches that a worker remembers in each of two generations, and the longest match it does: when the young
#: generation is full the old one is forgotten, and what is still in use moves on to the next.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: Characters of a text that are encoded at once; cut only where white space follows something else, where no match goes across.
BLOCK = 1_000_000
#: Characters of shorter texts that are encoded together, and bytes of the matches that share a queue: setting one up costs more than a match.
TOGETHER, QUEUE = 250_000, 16_384


class Codec:
    """ranks: bytes -> rank, with every single byte among them; pattern: what splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        if size > BITS * BITS:
            raise ValueError(f"{size} ranks are more than the {BITS * BITS} that two levels of bitmap hold")
        #: The lower level of the bitmap; all zero between calls, as every call empties its queue.
        self.words = [0] * BITS
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.double = np.full(65536, -1, np.int32)  # by both bytes: rank of two bytes
        for t, r in ranks.items():
            if len(t) == 2:
                self.double[t[0] << 8 | t[1]] = r
        #: By rank, null where there is none: the token, and the decimal rank and a comma.
        by_rank = dict(zip(ranks.values(), ranks, strict=True))
        self.tokens = pa.array([by_rank.get(r) for r in range(size)], pa.large_binary())
        self.decimals = pa.array([f"{r}," if r in by_rank else None for r in range(size)], pa.large_binary())
        #: Ids of matches, two bytes each: objects of one piece, without an int of their own for each id.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each match. One queue takes all of them, laid end to end with no pair across, as order only counts within a match.

        Tokens are known by where they begin: the one at i ends at end[i], follows the one at before[i], has the rank
        token[i], -1 once it is part of another, and makes a pair of rank pair[i] with the next, or -1. A queue entry is a
        node: place[node] is its position, after[node] the next node of its bucket, first[rank] and last[rank] a bucket's
        ends. words and top are the bitmap; edge tells where matches end.
        """
        data = b"".join(pieces)
        n, words, top, rank_of, one = len(data), self.words, 0, self.ranks.get, ONE
        edge, starts = bytearray(n + 1), list(itertools.accumulate(map(len, pieces), initial=0))
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in starts:
            edge[i] = 1
        for i in starts[:-1]:
            if i < n:
                before[i] = -1
        token = list(map(self.single.__getitem__, data))
        byte = np.frombuffer(data, np.uint8).astype(np.int32)
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self.double[byte[:-1] << 8 | byte[1:]]
        ranks[np.array(starts[1:], np.int64) - 1] = -1
        # each bucket's positions, in order, one after the other
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        heads = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        follow = np.full(n, -1, np.int64)
        follow[order[:-1]] = order[1:]
        tails = np.append(heads[1:], len(order))[: len(heads)] - 1
        follow[order[tails]] = -1
        filled = ranks[order[heads]].tolist()
        first, last, late = dict(zip(filled, order[heads].tolist(), strict=True)), dict(zip(filled, order[tails].tolist(), strict=True)), {}
        pair, after, place, node_count = ranks.tolist(), follow.tolist(), list(range(n)), n
        del byte, ranks, order, follow
        for r in filled:
            slot = r >> 8
            words[slot] |= one[r & 255]
            top |= one[slot]
        while top:
            slot = (top & -top).bit_length() - 1  # find first set, level by level
            word = words[slot]
            low = word & -word
            rank = slot << 8 | low.bit_length() - 1
            node, heap, lower = first.pop(rank, -1), late.pop(rank, None), False
            # until the bucket is empty or a merge makes a pair of lower rank; no merge makes one of the same
            while not lower:
                if heap and (node < 0 or heap[0] < place[node]):
                    i = heapq.heappop(heap)
                elif node >= 0:
                    i, node = place[node], after[node]
                else:
                    break
                if pair[i] != rank:
                    continue  # stale
                j = end[i]
                end[i] = k = end[j]
                pair[j] = token[j] = -1
                token[i] = rank
                if edge[k]:
                    pair[i] = -1
                else:
                    before[k] = i
                    r = pair[i] = rank_of(data[i : end[k]], -1)
                    if r >= 0:
                        lower = r < rank
                        tail = last.get(r, -1)
                        if tail < 0:
                            words[r >> 8] |= one[r & 255]
                            top |= one[r >> 8]
                            first[r] = last[r] = node_count
                            node_count += 1
                            place.append(i)
                            after.append(-1)
                        elif i > place[tail]:
                            after[tail] = last[r] = node_count
                            node_count += 1
                            place.append(i)
                            after.append(-1)
                        else:  # before a list's end: kept in order beside it
                            heapq.heappush(late.setdefault(r, []), i)
                if (h := before[i]) >= 0:
                    r = pair[h] = rank_of(data[h:k], -1)
                    if r >= 0:
                        lower = lower or r < rank
                        tail = last.get(r, -1)
                        if tail < 0:
                            words[r >> 8] |= one[r & 255]
                            top |= one[r >> 8]
                            first[r] = last[r] = node_count
                            node_count += 1
                            place.append(h)
                            after.append(-1)
                        elif h > place[tail]:
                            after[tail] = last[r] = node_count
                            node_count += 1
                            place.append(h)
                            after.append(-1)
                        else:
                            heapq.heappush(late.setdefault(r, []), h)
            if node >= 0:
                first[rank] = node
            if heap:
                late[rank] = heap
            if node < 0:
                last.pop(rank, None)
                if not heap:
                    words[slot] ^= low
                    if not words[slot]:
                        top ^= one[slot]
        ids = np.array(token, np.int32)
        kept = ids >= 0
        blob = ids[kept].astype(ID).tobytes()
        at = (np.concatenate(([0], np.cumsum(kept)))[starts] * ID.itemsize).tolist()
        return [blob[a:b] for a, b in itertools.pairwise(at)]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of matches that aren't in the young generation, remembered from now on if they are short."""
        got = [self.old.get(p) for p in pieces]
        if fresh := [i for i, ids in enumerate(got) if ids is None]:
            raw = [pieces[i].encode() for i in fresh]
            whole = list(map(self.ranks.get, raw))
            parts = [p for p, r in zip(raw, whole, strict=True) if r is None]
            merged = iter([ids for queue in _chunks(parts) for ids in self.merge(queue)])
            for i, r in zip(fresh, whole, strict=True):
                got[i] = next(merged) if r is None else ID.type(r).tobytes()
        for p, ids in zip(pieces, got, strict=True):
            if len(p) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.old, self.known = self.known, {}
                self.known[p] = ids
        return got

    def together(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Memory follows the length of all of them."""
        split = list(map(self.split.findall, texts))
        found = [list(map(self.known.get, pieces)) for pieces in split]
        lacking = [(pieces, ids) for pieces, ids in zip(split, found, strict=True) if not all(ids)]
        fresh = list(dict.fromkeys(itertools.chain.from_iterable(itertools.compress(pieces, map(operator.not_, ids)) for pieces, ids in lacking)))
        if fresh:
            learned = dict(zip(fresh, self.learn(fresh), strict=True))
            for pieces, ids in lacking:
                ids[:] = [got or learned[p] for p, got in zip(pieces, ids, strict=True)]
        return [np.frombuffer(b"".join(ids), ID) for ids in found]

    def blocks(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """Number of a text and the ids of its next block, text by text, so that memory doesn't follow a text's length."""
        group, size = [], 0
        for i, text in enumerate(texts):
            for part in cut_text(text):
                if group and size + len(part) > TOGETHER:
                    yield from self._numbered(group)
                    group, size = [], 0
                group.append((i, part))
                size += len(part)
        yield from self._numbered(group)

    def _numbered(self, group: list[tuple[int, str]]) -> Iterator[tuple[int, np.ndarray]]:
        return zip([i for i, _ in group], self.together([part for _, part in group]), strict=True)

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in self.blocks([text]) for i in ids.tolist()]

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return _joined(self.tokens, ids)


def _joined(values: pa.Array, ids: list[int] | np.ndarray) -> bytes:
    """The values of these ids, one after the other. Ids without a value raise KeyError."""
    try:
        found = values.take(pa.array(ids, pa.int64()))
    except pa.ArrowIndexError as e:
        raise KeyError(str(e)) from e
    if found.null_count:
        raise KeyError("an id without a token")
    _, offsets, data = found.buffers()
    ends = np.frombuffer(offsets, np.int64, len(found) + 1, found.offset * 8) if len(found) else (0, 0)
    return data[ends[0] : ends[-1]].to_pybytes() if ends[-1] else b""


def _chunks(pieces: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of matches for one queue: up to QUEUE bytes, or a longer match by itself."""
    some, size = [], 0
    for p in pieces:
        if some and size + len(p) > QUEUE:
            yield some
            some, size = [], 0
        some.append(p)
        size += len(p)
    if some:
        yield some


def cut_text(text: str, block: int = BLOCK) -> Iterator[str]:
    if len(text) <= block:
        yield text
        return
    start, place = 0, regex.compile(r"(?<=\S)(?=\s)")  # white space as in the pattern, which is of the same module
    while start < len(text):
        found = place.search(text, start + block) if start + block < len(text) else None
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Of a rank file: a token in base64, a space and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


_codecs: dict[str, Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec for each worker and vocabulary."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(raw), pattern)
    return _codecs[key]


def _encode(c: Codec, texts: Iterable[str]) -> list[dict]:
    rows = []
    for i, ids in c.blocks(texts):
        if i == len(rows):
            rows.append({"ids": []})
        rows[i]["ids"] += ids.tolist()
    return rows


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> for each row of docs; null text counts as empty and has no ids. Memory follows the text's length here."""
    return _per_text(docs, ranks_path, pattern, id_col, text_col, "ids array<int>", _encode)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text binary: the bytes of each row's ids (null: none). Ids outside the vocabulary raise KeyError."""
    return _per_text(encoded, ranks_path, pattern, id_col, ids_col, "bytes binary", lambda c, of: [{"bytes": c.decode(ids or [])} for ids in of])


def _digest(c: Codec, texts: Iterable[str]) -> list[dict]:
    rows = []
    for i, ids in c.blocks(texts):
        if i == len(rows):
            rows.append((hashlib.sha256(), hashlib.sha256(), [0]))
        ids_sha, decoded_sha, n = rows[i]
        if len(ids):
            ids_sha.update((b"," if n[0] else b"") + _joined(c.decimals, ids)[:-1])
            decoded_sha.update(c.decode(ids))
            n[0] += len(ids)
    return [{"n_tokens": n[0], "ids_sha256": a.hexdigest(), "decoded_sha256": b.hexdigest()} for a, b, n in rows]


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the bytes decoded from the ids.

    One row for each row of docs, repeated rows included; null texts count as empty (0 tokens, digests of nothing), null
    ids are kept, other columns are dropped. Texts of any length are encoded in blocks. No shuffle.
    """
    return _per_text(docs, ranks_path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _per_text(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, columns: str, f) -> DataFrame:
    spark = docs.sparkSession
    with open(ranks_path, "rb") as file:  # a file of the installed vocabulary, under a megabyte; workers get its bytes
        raw = spark.sparkContext.broadcast(file.read())
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("of"))
    schema = docs.select("id").schema
    for field in spark.createDataFrame([], columns).schema:
        schema = schema.add(field)
    kinds = [pa.string() if x.dataType.simpleString() == "string" else pa.int64() if x.dataType.simpleString() == "bigint" else pa.binary() if x.dataType.simpleString() == "binary" else pa.list_(pa.int32()) for x in schema.fields[1:]]
    names = schema.names

    def run(batches):
        c = codec(raw.value, pattern)
        for batch in batches:
            ids, of = batch.column("id"), batch.column("of")
            for at in range(0, batch.num_rows, 1000):
                rows = f(c, (x.as_py() if x.is_valid else "" for x in of[at : at + 1000]))
                yield pa.RecordBatch.from_arrays([ids[at : at + 1000], *(pa.array([r[n] for r in rows], k) for n, k in zip(names[1:], kinds, strict=True))], names=names)
        c.old = {}  # the worker goes on to other work

    return small_batches(docs).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of an installed public vocabulary, and the pattern it goes with."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents", "doc_id", "text"), *vocabulary())
