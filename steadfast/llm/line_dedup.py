"""Line dedup: later copies of runs of lines are deleted; DataFrame functions only.

A run counts from `min_words` words on. Winnowing is over the hashes of a document's lines that have words: a line's
window is the fewest lines from it on that have min_words words, and the line with the smallest hash in it is
selected. Equal runs of min_words words hold equal windows, so they share a selected line: that is guaranteed.

1. Fingerprints are the selected lines. Those whose hash is selected at one place only can't be part of a repeat; they
   go, with the windows that selected them.
2. The windows left meet by the hash of all their lines. The earliest place of each content is a minimum, combined
   before the shuffle, and each later place is matched to it: never all pairs of a group.
3. Matches extend both ways to the ends of the equal run: along windows that start at its lines, and, in the documents
   that have a match, along windows that end at its lines, so that the last lines, too few to start a window, go too.

Which lines go doesn't depend on the selection: all lines from the first to the last of a window, from a line on or up
to a line, whose content begins earlier in the order of ids and then positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadfast.llm.common import WORD, cut, table

MIN_WORDS = 50
#: A key with more than this share of all rows is hot. So there are at most as many hot keys as its inverse, about 100 bytes each.
HOT = 1 / 10_000
DOC = ["id", "text_key"]


def _lines(docs: DataFrame) -> DataFrame:
    """Each line with words: its place, two hashes, and the document's words before (start) and up to its end.

    Rows that repeat id and text_key give each place as often; it counts once.
    """
    split = docs.select(*DOC, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    hashes = F.xxhash64("line").alias("h"), F.xxhash64(F.lit("2"), "line").alias("g")
    rows = split.select(*DOC, "pos", *hashes, F.regexp_count("line", F.lit(WORD)).alias("words")).filter("words > 0")
    ordered = Window.partitionBy(*DOC).orderBy("pos")
    rows = rows.withColumn("before", F.lag("pos").over(ordered)).filter("before is null or before < pos").drop("before")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum("words").over(upto)).withColumn("start", F.col("end") - F.col("words"))


def _windows(lines: DataFrame, over: Window, min_words: int) -> DataFrame:
    """Each window's span of positions, fingerprint and where that stands, and the two hashes of its lines."""
    found = lines.select(
        *DOC, F.min("pos").over(over).alias("first"), F.max("pos").over(over).alias("last"), F.sum("words").over(over).alias("n"),
        F.collect_list("h").over(over).alias("hs"), F.collect_list("g").over(over).alias("gs"), F.collect_list("pos").over(over).alias("at"),
    ).filter(F.col("n") >= min_words)
    least = F.array_min("hs")
    selected = F.element_at("at", F.array_position("hs", least).cast("int"))
    return found.select(*DOC, "first", "last", least.alias("fingerprint"), F.xxhash64(*DOC, selected).alias("place"), F.xxhash64("hs").alias("key"), F.xxhash64("gs").alias("check"))


def _meet(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with keys, written tables, keys being unique and having n, how many rows each has.

    Rows of hot keys stay where they are and meet these by broadcast; all others are dealt by key, so that no task gets many of one.
    """
    most = max(1.0, HOT * rows.count())
    hot, rest = F.broadcast(keys.filter(F.col("n") > most).drop("n")), keys.filter(F.col("n") <= most).drop("n")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on))


def _later(windows: DataFrame) -> DataFrame:
    """The windows of a written table whose content begins earlier elsewhere."""
    place = F.struct(*DOC, "first")
    heads = cut(windows.groupBy("key", "check").agg(F.count("*").alias("n"), F.min(place).alias("head")).filter("n > 1"))
    return _meet(windows, heads, ["key", "check"]).filter(place > F.col("head")).select(*DOC, "first", "last")


def repeated_spans(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """id, text_key, spans: the sorted, disjoint spans {first, last} of line numbers, from 0, that go.

    docs has id, text_key and text, without nulls; rows that repeat id and text_key are one document.
    """
    doc = Window.partitionBy(*DOC)
    lines = cut(_lines(docs))
    windows = cut(_windows(lines, doc.orderBy("start").rangeBetween(0, min_words - 1), min_words))
    shared = cut(windows.groupBy("fingerprint").agg(F.min("place").alias("a"), F.max("place").alias("z"), F.count("*").alias("n")).filter("a <> z").select("fingerprint", "n"))
    met = cut(_meet(windows, shared, ["fingerprint"]).drop("fingerprint", "place"))
    many = cut(met.groupBy("key", "check").agg(F.count("*").alias("n")).filter("n > 1"))
    touched = cut(_meet(met.select(*DOC, "key", "check"), many, ["key", "check"]).select(*DOC).distinct())
    tails = _windows(lines.join(touched, DOC, "left_semi"), doc.orderBy("end").rangeBetween(1 - min_words, 0), min_words)
    gone = _later(met).unionByName(_later(cut(tails.drop("fingerprint", "place")))).distinct()
    ordered = doc.orderBy("first", "last")
    gone = gone.withColumn("reach", F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    gone = gone.withColumn("run", F.sum(F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    runs = gone.groupBy(*DOC, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def _kept(lines: Column, spans: Column) -> Column:
    """The lines outside the spans: the stretches between them, put together."""
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at(spans, F.greatest(k, F.lit(1)))["last"] + 1)
    stop = lambda k: F.when(k == F.size(spans), F.size(lines)).otherwise(F.element_at(spans, F.least(k + 1, F.size(spans)))["first"])
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.slice(lines, start(k) + 1, stop(k) - start(k))))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeats deleted from the text, and n_lines (before) and n_removed; other columns as they were.

    Lines end at \\n; a line's words are runs without ASCII white space, and lines are equal when all their characters
    are. Lines without words belong to no window, but go with a run they stand in. A run that repeats in its own document
    goes there, too: of a line that repeats for more than min_words words only the first copy stays. Ties can't be, as a place
    is an id, a text and a line. Rows with a null id or text stay as they are (n_removed 0, n_lines 0 for null text).
    Rows that repeat id and text are one document: each gets the same text. Where all lines go, the text is ''. An empty
    table gives no row. Columns of docs named n_lines or n_removed are replaced; all other names are free.
    """
    known = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    spans = repeated_spans(known.select("id", "text_key", "text"), min_words=min_words)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    rows = rows.join(spans, DOC, "left").withColumn("lines", F.split(F.col("row")[text_col], "\n"))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    n_removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1), F.lit(0))
    text = F.when(F.col("spans").isNull(), F.col("row")[text_col]).otherwise(F.array_join(_kept(F.col("lines"), F.col("spans")), "\n"))
    others = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*others, n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
with raw as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where text is not null and doc_id is not null
), w as (
  select doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from raw
), l as (
  select doc_id, pos, line, words, sum(words) over (partition by doc_id order by pos) as fin from w where words > 0
), s as (select *, fin - words as beg from l),
a as (
  select doc_id, min(pos) over x as first, max(pos) over x as last, sum(words) over x as n,
         md5(array_to_string(list(line) over x, chr(10))) as k
  from s window x as (partition by doc_id order by beg range between current row and 49 following)
), b as (
  select doc_id, min(pos) over x as first, max(pos) over x as last, sum(words) over x as n,
         md5(array_to_string(list(line) over x, chr(10))) as k
  from s window x as (partition by doc_id order by fin range between 49 preceding and current row)
), a2 as (select doc_id, first, last, row_number() over (partition by k order by doc_id, first) as o from a where n >= 50),
b2 as (select doc_id, first, last, row_number() over (partition by k order by doc_id, first) as o from b where n >= 50),
g as (select doc_id, first, last from a2 where o > 1 union select doc_id, first, last from b2 where o > 1),
gone as (select distinct doc_id, unnest(range(first, last + 1)) as pos from g),
kept as (
  select r.doc_id, count(*) as n_lines, count(gone.pos) as n_removed,
         coalesce(string_agg(r.line, chr(10) order by r.pos) filter (where gone.pos is null), '') as text
  from raw r left join gone on r.doc_id = gone.doc_id and r.pos = gone.pos group by r.doc_id
)
select doc_id, n_lines, n_removed, sha256(text) as kept_sha256 from kept
union all
select doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end, 0, sha256(coalesce(text, ''))
from documents where text is null or doc_id is null
"""
