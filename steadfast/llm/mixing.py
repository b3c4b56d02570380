"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Each document of a source is wanted target / source_size times. The whole part of that is certain: so many whole
copies of every document. For the words still missing a sample is drawn with unequal probabilities: a document of s words
has the inclusion probability p = min(1, c s), where c is such that the words to be expected are those missing. Those
with p = 1 are certain, too, and set aside; the others are ranked by their random odds over their inclusion odds,
(u / (1 - u)) / (p / (1 - p)), u being a uniform number drawn from a digest of the document's id. The lowest ranked are
taken. The sample's size is fixed in words, the unit of targets: it ends where the words still missing run out, and a
few closing documents fill the gap that whole documents leave.

All a document's number of copies depends on is its own id and words and one row for its source (plan). No source is gathered
in one task: c comes from counts of documents by size, the cut in a source's ranking from histograms of the rank,
level by level, and only the documents of the final narrow slice are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadfast.llm.common import WORD, cut, table

MOST_COPIES = 3
#: Slices of each histogram level of the ranks, and levels: 2 levels leave about one document in 16 million in the last slice.
SLICES = 4096
LEVELS = 2
#: Sources whose rows (about 400 bytes each) are broadcast at most; with more, documents are joined to them by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the MD5 of seed and key: 48 of its bits, the same on every run and in other SQL engines."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def mix_key(id_: Column, text: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, *, weights=(1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target for rows (source, size): by code point, nulls last, sources weigh 1, 2, 3, repeating.

    Together the targets are all sizes. None is above `most` times its source's size; the excess goes to the others by
    weight. That is water filling: with sources ordered by size for each unit of weight, the first ones are capped.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row for each source from here on
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sums.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_of = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(all_of).cast("double"))
    # level if every source before this one is capped and this one and those after it are not
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest
    rows = rows.withColumn("level", level)
    # the first source that is not above its cap at its level fixes the level of all that follow
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    rows = rows.withColumn("level", F.first(fits, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def inclusion_scale(counts: DataFrame) -> DataFrame:
    """source, scale: the c for which sizes s, each in n documents, have min(1, c s) s n adding up to the source's missing words.

    counts has source, missing, size, n, one row for each size there is in a source. With the sizes above z certain, c is what
    these leave of the missing words over the sum of s * s * n up to z; the largest z that is then not certain itself is right.
    """
    of = Window.partitionBy("source")
    by = of.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)  # one narrow row for each size
    sums = counts.filter("size > 0 and missing > 0").withColumn("words", (F.col("size") * F.col("n")).cast("decimal(38,0)"))
    upto = F.sum((F.col("words") * F.col("size")).cast("decimal(38,0)")).over(by).cast("double")
    above = (F.sum("words").over(of) - F.sum("words").over(by)).cast("double")
    scale = (F.col("missing") - above) / upto
    return sums.select("source", "size", scale.alias("scale")).filter("scale > 0 and scale * size < 1").groupBy("source").agg(F.max(F.struct("size", "scale")).alias("s")).select("source", "s.scale")


def _drawn(rows: DataFrame) -> DataFrame:
    """rows (size, u, missing, scale) with p, the probability of one more copy, and rank: 0 where it is certain, null where it is none."""
    p = F.when((F.col("missing") > 0) & (F.col("size") > 0), F.least(F.lit(1.0), F.col("scale") * F.col("size")))
    rows = rows.withColumn("p", p)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    # q / (1 + q) is in (0, 1) and as ordered as q
    return rows.withColumn("rank", F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, odds / (1 + odds)))


def _numbered(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, key, source, size, u, rows: documents, and how many rows each is."""
    key = mix_key(F.col(id_col), F.col(text_col))
    docs = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    return docs.groupBy("id", "key", "source", "size").agg(F.count("*").alias("rows")).withColumn("u", uniform(F.col("key"), seed))


def _plan(docs: DataFrame, weights, most: int) -> tuple[DataFrame, DataFrame]:
    """One row for each source, with all that its documents' copies depend on; and _numbered documents with copy_of and rank."""
    counts = cut(docs.groupBy("source", "size").agg(F.sum("rows").alias("n")))
    # small tables below are written by cut(), so that Spark knows their size and broadcasts them only below its own threshold
    per = source_targets(counts.select("source", (F.col("size") * F.col("n")).alias("size")), weights=weights, most=most)
    per = per.withColumn("wanted", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    per = per.withColumn("whole", F.floor("wanted").cast("long"))
    per = cut(per.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")).drop("wanted"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    scale = cut(inclusion_scale(counts.join(per, same(counts, per)).select(per["source"], "missing", "size", "n")))
    per = cut(per.join(scale, same(per, scale), "left").drop(scale["source"]))
    rows = docs.withColumn("copy_of", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")
    # rows alike in id, source and size are told apart by a running number, so that each can be chosen alone
    rows = cut(_drawn(rows.join(_bounded(per), same(rows, per)).drop(per["source"])).select("id", "key", "source", "size", "copy_of", "missing", "rank"))
    # the slice of ranks in which each source's missing words run out, refined level by level
    at = rows.filter("rank is not null").drop("id")
    slices = at.withColumn("lo", F.lit(0.0)).withColumn("base", F.lit(0.0))
    for level in range(1, LEVELS + 1):
        width = float(SLICES) ** -level
        inside = slices.withColumn("slice", F.floor((F.col("rank") - F.col("lo")) / F.lit(width)))
        sums = inside.groupBy("source", "missing", "lo", "base", "slice").agg(F.sum("size").cast("double").alias("words"))
        by = Window.partitionBy("source").orderBy("slice")  # SLICES rows at most
        sums = sums.withColumn("upto", F.col("base") + F.sum("words").over(by)).withColumn("next_base", F.col("upto") - F.col("words"))
        bounds = cut(
            sums.filter("upto > missing").groupBy("source").agg(F.min(F.struct("slice", (F.col("lo") + F.col("slice") * width).alias("next_lo"), "next_base")).alias("b"))
            .select("source", F.col("b.next_lo").alias("lo"), F.col("b.next_base").alias("base"), F.lit(width).alias("width"))
        )
        slices = at.join(_bounded(bounds), same(at, bounds)).drop(bounds["source"]).filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("width"))).drop("width")
    order = Window.partitionBy("source").orderBy("rank", "key", "copy_of")  # one narrow slice of each source
    last = slices.withColumn("upto", F.col("base") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct("rank", "key", "copy_of")
    cuts = cut(
        last.groupBy("source")
        .agg(F.max(F.when(F.col("upto") <= F.col("missing"), row)).alias("last"), F.first("lo").alias("lo"), F.max(F.when(F.col("upto") <= F.col("missing"), F.col("upto"))).alias("filled"), F.first("base").alias("base"))
        .select("source", "last", "lo", F.coalesce("filled", "base").alias("filled"))
    )
    none = F.array().cast("array<struct<rank:double,key:string,copy_of:int>>")
    per = per.join(cuts, same(per, cuts), "left").drop(cuts["source"]).withColumn("gap", F.col("missing") - F.col("filled")).drop("filled").withColumn("closing", none)
    per = cut(per)
    # documents that best close what is left: each time one for each source, the largest that fits in, and at last the
    # nearest in size, if it brings the sum nearer
    rest = rows.filter("rank is not null").drop("missing")
    for fits in ("size <= gap", "size <= gap", "true"):
        open_ = rest.join(_bounded(per), same(rest, per)).drop(per["source"]).filter(f"gap > 0 and size > 0 and {fits}").filter(~_sampled())
        near = F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "key", "copy_of", "size")
        best = open_.groupBy("source").agg(F.min(near).alias("best"), F.first("gap").alias("was")).filter("best.off < was").select("source", "best")
        per = per.join(best, same(per, best), "left").drop(best["source"])
        one = F.array(F.struct("best.rank", "best.key", "best.copy_of"))
        per = cut(per.withColumn("closing", F.when(F.col("best").isNull(), F.col("closing")).otherwise(F.concat("closing", one))).withColumn("gap", F.col("gap") - F.coalesce("best.size", F.lit(0))).drop("best"))
    return per, rows


def _bounded(per: DataFrame) -> DataFrame:
    """per, a written table of one row for each source, marked for broadcast if its rows are few enough."""
    return F.broadcast(per) if per.count() <= BROADCAST_SOURCES else per


def _sampled() -> Column:
    """Whether a row (rank, key, copy_of), beside its source's plan, gets one more copy than `whole`."""
    row = F.struct("rank", "key", "copy_of")
    before = F.col("lo").isNull() | (F.col("rank") < F.col("lo")) | F.coalesce(row <= F.col("last"), F.lit(False))
    return F.coalesce(F.col("rank").isNotNull() & (before | F.array_contains("closing", row)), F.lit(False))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """id, mix_key, source, size, source_size, target, copies, taken: one row for each row of docs.

    Size is the number of words (null text: 0). A null source is a source of its own, the last. mix_key is the id as a
    string, or for null ids a digest of the text: the draw comes from it. Repeated rows with one id, size and source share their draw and rank next to each other; each is
    decided by itself, in no other order than their keys, so ties fall on whole rows only where the cut passes between them.
    Documents of size 0 are taken 0 words and as many copies as their source's whole part. Reruns agree. An empty table gives no row.
    """
    per, rows = _plan(cut(_numbered(docs, seed, id_col, text_col, source_col)), weights, most)
    rows = rows.drop("missing")
    rows = rows.join(_bounded(per), rows["source"].eqNullSafe(per["source"])).drop(per["source"])
    copies = F.col("whole") + F.when(_sampled(), 1).otherwise(0)
    return rows.select(F.col("id").alias(id_col), F.col("key").alias("mix_key"), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it.

    The copies are worked out on each row, from its id, words and source's row of the plan, so no text is moved as long as
    that is broadcast. Rows that repeat an id (for null ids: a text), size and source come equally often, as often as mix()
    takes the first of them. Nulls and empty tables are as in mix().
    """
    per, _ = _plan(cut(_numbered(docs, seed, id_col, text_col, source_col)), weights, most)
    per = per.select(F.struct(*per.columns).alias("plan of the source"))
    key = mix_key(F.col(f"row.{id_col}"), F.col(f"row.{text_col}"))
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", key.alias("key"), F.col(f"row.{source_col}").cast("string").alias("source"), word_count(F.col(f"row.{text_col}")).alias("size"), F.lit(1).alias("copy_of"), uniform(key, seed).alias("u"))
    rows = rows.join(_bounded(per), F.col("source").eqNullSafe(F.col("plan of the source.source"))).select("row", "key", "size", "copy_of", "u", *(F.col(f"plan of the source.{c}").alias(c) for c in ("whole", "missing", "scale", "lo", "last", "closing")))
    copies = F.col("whole") + F.when(_sampled(), 1).otherwise(0)
    rows = _drawn(rows).select("row", copies.cast("int").alias("copies")).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP3_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (('0x' || substr(md5('7:' || doc_id), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, [1.0::double, 2.0::double, 3.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
         3 * source_size::double as cap, (sum(source_size) over ())::double as total
  from s
), l as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from w
), f as (select *, first(case when level * weight <= cap then level end ignore nulls) over (order by cap / weight, source nulls last rows between unbounded preceding and unbounded following) as lev from l),
t as (
  select source, source_size, least(cap, coalesce(lev * weight, cap)) as target from f
), p as (
  select *, target - whole * source_size as missing
  from (select *, floor(case when source_size > 0 then target / source_size else 0.0 end) as whole from t)
), n as (
  select source, size, count(*) as n from d where size > 0 group by source, size
), c0 as (
  select n.source, size, missing,
         (sum(size::hugeint * n * size) over (partition by n.source order by size rows between unbounded preceding and current row))::double as upto,
         coalesce(sum(size::hugeint * n) over (partition by n.source order by size rows between 1 following and unbounded following), 0)::double as above
  from n join p on n.source is not distinct from p.source where missing > 0
), c as (
  select source, max_by((missing - above) / upto, size) as scale from c0 where (missing - above) / upto > 0 and (missing - above) / upto * size < 1 group by source
), q0 as (
  select d.doc_id, d.source, d.size, d.u, p.source_size, p.target, p.whole::bigint as whole, p.missing,
         case when p.missing > 0 and d.size > 0 then least(1.0, c.scale * d.size) end as prob
  from d join p on d.source is not distinct from p.source left join c on d.source is not distinct from c.source
), q as (
  select *, case when prob >= 1 then 0.0 when prob > 0 then (u / (1 - u)) / (prob / (1 - prob)) end as odds from q0
), r as (
  select *, odds / (1 + odds) as rank, doc_id::varchar as key,
         sum(size) over (partition by source order by odds / (1 + odds), doc_id::varchar rows between unbounded preceding and current row) as upto
  from q where odds is not null
), r0 as (select *, upto <= missing as extra from r),
g0 as (select source, any_value(missing) - coalesce(sum(size) filter (where extra), 0) as gap from r0 group by source),
b1 as (select r0.source, min(struct_pack(o := abs(size - gap), r := rank, k := key, z := size)) as b from r0 join g0 on r0.source is not distinct from g0.source
       where not extra and gap > 0 and size > 0 and size <= gap group by r0.source),
r1 as (select r0.* replace (extra or coalesce(key = b.k, false) as extra) from r0 left join b1 on r0.source is not distinct from b1.source),
g1 as (select source, any_value(missing) - coalesce(sum(size) filter (where extra), 0) as gap from r1 group by source),
b2 as (select r1.source, min(struct_pack(o := abs(size - gap), r := rank, k := key, z := size)) as b from r1 join g1 on r1.source is not distinct from g1.source
       where not extra and gap > 0 and size > 0 and size <= gap group by r1.source),
r2 as (select r1.* replace (extra or coalesce(key = b.k, false) as extra) from r1 left join b2 on r1.source is not distinct from b2.source),
g2 as (select source, any_value(missing) - coalesce(sum(size) filter (where extra), 0) as gap from r2 group by source),
b3 as (select r2.source, min(struct_pack(o := abs(size - gap), r := rank, k := key, z := size)) as b, any_value(gap) as gap from r2 join g2 on r2.source is not distinct from g2.source
       where not extra and gap > 0 and size > 0 group by r2.source),
r3 as (select r2.* replace (extra or coalesce(key = b.k and b.o < gap, false) as extra) from r2 left join b3 on r2.source is not distinct from b3.source)
select q.doc_id, q.size, q.source_size, q.target, (q.whole + coalesce(r3.extra::int, 0)) * q.size as taken, q.whole + coalesce(r3.extra::int, 0) as copies
from q left join r3 on q.doc_id = r3.doc_id
"""
