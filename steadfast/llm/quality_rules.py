"""Quality rules: base counts, and repetition by suffix arrays.

The words of a text are put into a suffix array by prefix doubling; a block of texts is done at once in numpy, and no
suffix reaches over its text's end. A doubling step sorts only suffixes that still share their prefix with another, so
text without long repeats is done after two or three small steps. Of the lengths of the common prefixes of neighbours in the
array the longest-common-prefix intervals are built; those whose suffixes don't all follow the same word are the maximal
repeated substrings. The spans of all of min_repeat words or more are united; a text is dropped if they cover too much
of it, or if its longest one is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.llm.common import small_batches, table

SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Base rule: fewer words fail, and so do more repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The method's limits: words from which a repeat counts, hundredths of the words covered by repeats, words of the longest repeat.
#: They follow published ones: 12 hundredths for repeated 8-grams (MassiveText), read as 24 since the first copy counts here, which
#: was decided with counts of labelled documents in view (see README); 50 tokens for exact copies in deduplication of training data.
MIN_REPEAT, MOST_COVERED, LONGEST = 8, 24, 50
#: Words of a block; a text with more is a block of its own.
BLOCK = 200_000

FIELDS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("covered_words", "long"), ("longest_repeat", "long"), ("n_repeats", "long"),
)


def _spread(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def intervals(common: np.ndarray, least: int) -> np.ndarray:
    """The longest-common-prefix intervals of least words or more, children first, as rows (words, first, last).

    common[i] is how many words the suffixes in places i and i + 1 of the array share. An interval is a run of places, as long as
    can be, whose neighbours all share its words, and not all more. One pass with a stack.
    """
    found, open_ = [], []
    for place in np.flatnonzero(np.r_[common >= least, True] | np.r_[True, common >= least]).tolist():
        shared, first = int(common[place]) if place < len(common) else 0, place
        while open_ and open_[-1][0] > shared:
            words, first = open_.pop()
            found.append((words, first, place))
        if shared >= least and (not open_ or open_[-1][0] < shared):
            open_.append((shared, first))
    return np.array(found, np.int64).reshape(-1, 3)


def repeats(words: np.ndarray, ends: np.ndarray, min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts put one after another: words are numbers that no two texts share, ends[i] is where the text of word i ends.

    Gives, for every word, whether it lies in a 3-word window that its text has twice, and how long the longest repeat
    of min_repeat words or more is that starts at it (0: none); and the maximal repeated substrings, as rows (place of an
    occurrence, words). min_repeat is 2 at least. What is covered by any repeat is covered by maximal ones.
    """
    n = len(words)
    tripled, longest = np.zeros(n, bool), np.zeros(n, np.int64)
    none = np.zeros((0, 2), np.int64)
    if not n:
        return tripled, longest, none
    counts = np.bincount(words)
    rank = (np.cumsum(counts) - counts)[words]  # a group's rank is where it begins in the array
    levels = [rank]
    left = np.flatnonzero(counts[words] > 1)
    h, long_ones = 1, None
    while len(left):
        after = left + h
        inside = after < ends[left]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[left] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        old = rank[left]
        index = np.arange(len(left))
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_group = np.r_[True, old[1:] != old[:-1]]
        run = np.maximum.accumulate(np.where(new_key, index, 0))
        rank = rank.copy()
        rank[left] = old + run - np.maximum.accumulate(np.where(new_group, index, 0))
        size = np.bincount(np.cumsum(new_key) - 1)
        left = left[np.repeat(size > 1, size)]
        h *= 2
        levels.append(rank)
        if h == 2 and len(left):
            i = left[left + 2 < ends[left]]
            _, back, times = np.unique(rank[i] * (n + 1) + levels[0][i + 2], return_inverse=True, return_counts=True)
            i = i[times[back] > 1]
            tripled = _spread(i, np.full(len(i), 3), n)
        if h <= min_repeat:
            long_ones = left  # they share h words with another
    if long_ones is None or not len(long_ones) or h <= min_repeat // 2:
        return tripled, longest, none
    array = long_ones[np.argsort(rank[long_ones], kind="stable")]
    a, b = array[:-1], array[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = np.r_[levels[k], -1]
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        common += np.where((level[x] == level[y]) & (x < n) & (y < n), 1 << k, 0)
    best = np.maximum(np.r_[0, common], np.r_[common, 0])
    longest[array] = np.where(best >= min_repeat, best, 0)
    found = intervals(common, min_repeat)
    # an interval is maximal to the left if the words before its suffixes differ; a text's first word has none before it
    head = array == np.r_[0, ends][array]
    before = np.where(head, -1 - array, words[array - 1])
    turns = np.r_[0, np.cumsum(before[1:] != before[:-1])]
    found = found[turns[found[:, 2]] > turns[found[:, 1]]]
    return tripled, longest, np.stack([array[found[:, 1]], found[:, 0]], 1)


def judge(texts: list[str | None], *, min_repeat: int = MIN_REPEAT, most_covered: int = MOST_COVERED, longest_repeat: int = LONGEST) -> dict[str, list]:
    """The FIELDS of each text, in order."""
    numbers, sizes, out = [], [], {name: [] for name, _ in FIELDS}
    base = 0
    for text in texts:
        raw = (text or "").encode()
        ids: dict[bytes, int] = {}
        got = [ids.setdefault(w, len(ids)) for w in raw.split()]
        numbers.append(np.array(got, np.int64) + base)
        base += len(ids)
        sizes.append(len(got))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out["n_words"].append(len(got))
        out["word_chars"].append(len(text or "") - len(raw) + len(raw.translate(None, SPACES)))
        out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    sizes = np.array(sizes, np.int64)
    ends = np.cumsum(sizes)
    words = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    tripled, longest, maximal = repeats(words, np.repeat(ends, sizes), min_repeat)
    starts = np.flatnonzero(longest)
    covered = _spread(starts, longest[starts], len(words))
    sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]])
    repeated, under = sums(tripled), sums(covered)
    most, many = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    of = np.searchsorted(ends, maximal[:, 0], side="right")
    np.maximum.at(most, of, maximal[:, 1])
    np.add.at(many, of, 1)
    failed = (sizes < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * sizes)
    out["n_repeat_words"], out["covered_words"], out["longest_repeat"], out["n_repeats"] = repeated.tolist(), under.tolist(), most.tolist(), many.tolist()
    out["base_failed"] = failed.tolist()
    out["kept"] = (~failed & (100 * under <= most_covered * sizes) & (most <= longest_repeat)).tolist()
    return out


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Where a block begins, and its texts."""
    start, block, size = 0, [], 0
    for k, text in enumerate(texts):
        text = text.as_py()
        n = len(text or "") // 5
        if block and size + n > BLOCK:
            yield start, block
            start, block, size = k, [], 0
        block.append(text)
        size += n
    if block:
        yield start, block


def judge_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """id and FIELDS for each row of docs; other columns are dropped. No shuffle; memory follows the longest text.

    Null and empty texts have no words and fail the base rule. Null ids are kept, and repeated rows are each judged. Limits
    are inclusive: a text exactly at one is kept, so ties decide nothing else. An empty table gives no row. limits: min_repeat, most_covered (hundredths), longest_repeat.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = docs.select("id").schema
    for name, kind in FIELDS:
        schema = schema.add(name, kind)
    kinds = [pa.bool_() if kind == "boolean" else pa.int64() for _, kind in FIELDS]

    def run(batches):
        for batch in batches:
            for start, block in _blocks(batch.column("text")):
                found = judge(block, **limits)
                columns = [pa.array(found[name], k) for (name, _), k in zip(FIELDS, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[start : start + len(block)], *columns], names=schema.names)

    return small_batches(docs).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_documents(docs: DataFrame, *, text_col: str = "text", **limits) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns, whatever these are called.

    Null and empty texts go; repeated rows are each judged; an empty table gives no row.
    """

    def run(batches):
        for batch in batches:
            kept = [k for _, block in _blocks(batch.column(text_col)) for k in judge(block, **limits)["kept"]]
            if any(kept):
                yield batch.filter(pa.array(kept, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
