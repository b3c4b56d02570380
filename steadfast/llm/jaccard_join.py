"""N-gram Jaccard join by grouped prefixes: which documents' shingle sets are alike, to the last link.

A document's set is its distinct word shingles, as 64-bit hashes. Two sets with |A and B| >= t |A or B| share an
element among their first n - ceil(t n) + 1 (their prefixes) in any order of all elements. Here the order is by hash,
with the frequent shingles last, so that passages which many documents share bring no pairs together.

1. Documents of one set are one class, stood for by its smallest id.
2. Which shingles are frequent is counted on the lowest hashes of each class and, for classes that have too few others
   among these, on their whole sets. Then every class has its prefix, rare shingles first.
3. Classes with the same prefix and size collapse into one group, by aggregation on a 128-bit digest: from here on only
   one row for each group has prefix elements. Members are verified against their group's smallest; those alike make
   one unit with it, each of the others is a unit of its own.
4. Stars: of the units that share prefix elements, all are verified against one leader, the one with fewest rare
   shingles; in later rounds, against others, if their component is still another. Large groups of near copies become
   components in steps that grow with the group, not with its square.
5. Prefix elements that two components have bring these together, and then their groups, never groups of one component,
   as these are linked already. Size and the number of common prefix elements rule out group pairs; of the rest the
   smallest members are verified, and pairs that are still apart then are expanded to all members.
6. Members are verified by their whole sets. Connected components of all links give the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadfast.llm.common import components, cut, discard, small_batches, table

#: Words of a shingle and hundredths of similarity, where nothing else is said.
SHINGLE, SIMILARITY = 5, 80
#: A shingle in more classes than this is frequent. Which ones are changes only the order, so the work, never the result.
FREQUENT = 16
#: Frequent shingles broadcast, 8 bytes each; with more, the mark is doubled until they are so few.
MOST_FREQUENT = 500_000
#: Rounds of stars at most. What they miss is found later, at more cost.
ROUNDS = 2
#: Rows of one or two numbers that are broadcast at most, about 32 MB; larger tables are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; of all its words, if it has fewer than k; none without words."""
    words = (text or "").encode().lower().split()  # of bytes: A to Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - size + 1 + i])
    return np.unique(out.view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def head_length(n: int, percent: int) -> int:
    """How many of the lowest hashes are kept: more than the prefix, so that some frequent ones may be passed over."""
    return min(n, 5 * prefix_length(n, percent) // 4 + 8)


def _small(df: DataFrame) -> DataFrame:
    """df, a written table, marked for broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _map_texts(docs: DataFrame, k: int, columns: str, f: Callable[[np.ndarray], tuple]) -> DataFrame:
    """id and what f gives for each document's set, for docs (id, text)."""
    spark = docs.sparkSession
    schema = docs.select("id").schema
    for field in spark.createDataFrame([], columns).schema:
        schema = schema.add(field)
    kind = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    kinds = [kind[x.dataType.simpleString()] for x in schema.fields[1:]]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for at in range(0, batch.num_rows, 500):
                found = list(zip(*(f(shingle_set(x.as_py(), k)) for x in texts[at : at + 500]), strict=True))
                yield pa.RecordBatch.from_arrays([ids[at : at + 500], *(pa.array(v, t) for v, t in zip(found, kinds, strict=True))], names=schema.names)

    return small_batches(docs).mapInArrow(run, schema)


def _may_be_alike(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """id and hashes of the wanted ids' sets."""
    return cut(_map_texts(texts.join(_small(wanted), "id", "left_semi"), k, "hashes array<long>", lambda s: (s,)))


def _with_sets(pool: DataFrame, texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """pool (id, hashes) with the sets of the wanted ids that it hasn't yet: no text is read for that twice."""
    missing = cut(wanted.select("id").distinct().join(pool.select("id"), "id", "left_anti"))
    return pool.unionByName(_sets(texts, missing, k)) if missing.limit(1).count() else pool


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the distinct pairs (a, b) of ids, those whose sets are alike."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select("a", "b")


def _parts(classes: DataFrame, links: DataFrame) -> DataFrame:
    """class and part, the smallest class that links reach."""
    found = components(links)
    return cut(classes.join(found, F.col("class") == F.col("node"), "left").select("class", F.coalesce("component", "class").alias("part")))


def _least_common(na: Column, nb: Column, percent: int) -> Column:
    """Elements that prefixes of alike sets share at least: of the one that ends first, n - overlap can be missing in the other."""
    overlap = F.ceil(percent * (na + nb) / (100 + percent))
    return F.greatest(F.lit(1), overlap - F.ceil(percent * F.greatest(na, nb) / 100) + 1)


def _stars(entries: DataFrame, texts: DataFrame, parts: DataFrame, links: DataFrame, pool: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links and those found by stars, the parts all of them make, and the sets read; entries are (token, class, n, rare)."""
    crowded = entries.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1").drop("many")
    lows = cut(entries.join(crowded, "token"))
    near = lows.groupBy("class").agg(F.count("*").alias("many"), F.first("n").alias("n"))
    near = cut(near.filter(2 * F.col("many") > F.col("n") - F.ceil(percent * F.col("n") / 100)).select("class"))
    lows = cut(lows.join(_small(near), "class", "left_semi"))
    pool = _with_sets(pool, texts, near.select(F.col("class").alias("id")), k)
    for r in range(ROUNDS):
        here = lows.join(_small(parts), "class")
        first = F.col("rare") if r % 2 == 0 else F.lit(0)
        leader = F.min(F.struct(first, F.when(F.lit(r == 0), F.col("class")).otherwise(F.xxhash64("class", F.lit(r))).alias("h"), F.col("class").alias("leader"), F.col("n").alias("m"), F.col("part").alias("of")))
        met = here.join(here.groupBy("token").agg(leader.alias("l")).select("token", "l.leader", "l.m", "l.of"), "token").filter("part <> of").filter(_may_be_alike(F.col("n"), F.col("m"), percent))
        met = met.groupBy("class", "leader").agg(F.count("*").alias("many"), F.first("n").alias("n"), F.first("m").alias("m")).filter(F.col("many") >= _least_common(F.col("n"), F.col("m"), percent))
        best = met.groupBy("class").agg(F.max(F.struct("many", (-F.col("leader")).alias("leader"))).alias("best"))
        pairs = cut(best.select(F.least("class", -F.col("best.leader")).alias("a"), F.greatest("class", -F.col("best.leader")).alias("b")).distinct())
        if not pairs.limit(1).count():
            break
        new = cut(_verified(pairs, pool, percent))
        links = links.unionByName(new)
        if new.limit(1).count():
            parts = _parts(parts.select("class"), links)
    return links, parts, pool


def _frequent(counts: DataFrame, mark: int) -> np.ndarray:
    """The tokens of counts (token, many) above the mark, which is doubled until they are few enough to be broadcast."""
    while counts.filter(F.col("many") > mark).count() > MOST_FREQUENT:
        mark *= 2
    return np.array(sorted(r[0] for r in counts.filter(F.col("many") > mark).select("token").collect()), np.int64)


def link_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = SIMILARITY, frequent: int = FREQUENT) -> DataFrame:
    """id, n_shingles, component_id for each row of docs: the size of its set and the smallest id that links reach, itself included.

    Words are runs without ASCII white space, A to Z lower-cased. Two rows link if 100 times their sets' intersection is
    at least `percent` times their union. Rows without words, or with a null text, have an empty set and link with
    nothing. A row with a null id has its n_shingles and a null component_id and links nothing. Rows with one id are one
    document. Other columns are dropped. An empty table gives no row.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def summary(s: np.ndarray) -> tuple:
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), s[: head_length(len(s), percent)] if len(s) else s

    heads = cut(_map_texts(texts, k, "n long, digest binary, head array<long>", summary))
    sets = cut(heads.select("id", "n", "digest"))
    full = heads.filter("n > 0 and id is not null")
    standing = cut(full.groupBy("digest").agg(F.min("id").alias("class"), F.first("n").alias("n"), F.first("head").alias("head")))
    discard(docs.sparkSession, heads)
    # the classes of one id's rows, where these have different texts, are one document's
    of_id = sets.filter("n > 0 and id is not null").select("id", "digest").distinct()
    several = of_id.groupBy("id").agg(F.count("*").alias("many")).filter("many > 1").select("id")
    of_id = of_id.join(several, "id", "left_semi").join(standing.select("digest", "class"), "digest")
    links = cut(of_id.join(of_id.groupBy("id").agg(F.min("class").alias("a")), "id").select("a", F.col("class").alias("b")).filter("a <> b").distinct())

    # frequent shingles: by the heads, then by the whole sets of those whose heads have too few others
    counts = cut(standing.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("many")).filter("many > 1"))
    spark, last = docs.sparkSession, _frequent(counts, frequent)
    needy = cut(_prefixes(standing, percent, spark.sparkContext.broadcast(last)).filter("prefix is null").select(F.col("class").alias("id")).distinct())
    pool = _sets(texts, needy, k)
    more = cut(pool.select(F.explode("hashes").alias("token")).groupBy("token").agg(F.count("*").alias("many")).filter(F.col("many") > frequent))
    last = spark.sparkContext.broadcast(np.union1d(last, _frequent(more, frequent)))
    by_head = cut(_prefixes(standing, percent, last))
    needy = cut(by_head.filter("prefix is null").select(F.col("class").alias("id")).distinct())
    pool = _with_sets(pool, texts, needy, k)
    wide = pool.join(_small(needy), "id", "left_semi").select(F.col("id").alias("class"), F.size("hashes").cast("long").alias("n"), F.col("hashes").alias("head"))
    prefixes = by_head.filter("prefix is not null").withColumn("whole", F.lit(False)).unionByName(cut(_prefixes(wide, percent, last)).withColumn("whole", F.lit(True)))

    # groups of one prefix and size; only their smallest members go on with prefix elements
    groups = cut(prefixes.groupBy("same").agg(F.min("class").alias("class"), F.count("*").alias("members"), *(F.first(c).alias(c) for c in ("n", "prefix", "rare")), F.max("whole").alias("whole")))
    member = prefixes.select("class", "same").join(groups.select("same", F.col("class").alias("group"), "members", "n", "rare", F.size("prefix").alias("size")), "same")
    member = cut(member.select("class", "group", "members", "n", "rare", (F.col("size") - F.least("size", "rare")).alias("f")))
    exploded = groups.select("class", "whole", F.posexplode("prefix").alias("at", "token"), "rare").withColumn("often", F.col("at") >= F.col("rare"))
    # a shingle matters if two classes have it: as the heads tell, or, behind a head's end, perhaps
    matters = cut(counts.select("token").union(exploded.filter("whole").select("token")).distinct())
    entries = cut(exploded.select("token", F.col("class").alias("group"), "often").join(_small(matters), "token", "left_semi"))
    discard(spark, standing, by_head, counts, matters, groups)

    crowd = cut(member.filter("members > 1 and class <> group").select(F.col("group").alias("a"), F.col("class").alias("b")).distinct())
    pool = _with_sets(pool, texts, crowd.select(F.col("a").alias("id")).union(crowd.select(F.col("b").alias("id"))), k)
    alike = cut(_verified(crowd, pool, percent))
    links = links.unionByName(alike)
    member = member.join(alike.select(F.col("a").alias("group"), F.col("b").alias("class"), F.lit(True).alias("alike")), ["group", "class"], "left")
    member = cut(member.select("class", "group", "n", "rare", "f", F.when(F.col("alike"), F.col("group")).otherwise(F.col("class")).alias("unit")))
    units = cut(member.filter("unit = class").select("unit", "group", "n", "rare"))
    alone = _parts(units.select(F.col("unit").alias("class")).distinct(), links)
    links, parts, pool = _stars(entries.join(_small(units), "group").select("token", F.col("unit").alias("class"), "n", "rare"), texts, alone, links, pool, k, percent)
    discard(spark)

    # units of one group and component go together
    member = member.join(_small(parts.select(F.col("class").alias("unit"), "part")), "unit")
    member = cut(member.select("class", "part", "group", "n", "f"))
    stands = _small(cut(member.groupBy("group", "part").agg(F.min("class").alias("key"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("f").alias("f"))))
    entries = cut(entries.join(stands, "group").select("token", "often", "key", "part", "n", "f"))
    tokens = cut(entries.groupBy("token", "part").agg(F.first("often").alias("often"), F.max("f").alias("f"), F.min("n").alias("lo"), F.max("n").alias("hi")))
    several = tokens.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1").select("token")
    tokens = cut(tokens.join(several, "token", "left_semi"))
    others = tokens.select("token", *(F.col(c).alias(f"{c}_") for c in ("f", "lo", "hi")), F.col("part").alias("other"))
    # what any two of their members must have in common at least; of the frequent shingles both prefixes have no more
    # than the shorter frequent part, and pairs for which that is too little need a rare one in common, too
    bound = F.ceil(percent * (F.col("lo") + F.col("lo_")) / (100 + percent)) - F.ceil(percent * F.greatest("hi", "hi_") / 100) + 1
    sizes_meet = (F.col("lo") * percent <= F.col("hi_") * 100) & (F.col("lo_") * percent <= F.col("hi") * 100)
    both = tokens.join(others, "token").filter("part < other").filter(sizes_meet & (~F.col("often") | (F.least("f", "f_") >= F.greatest(F.lit(1), bound)))).select("token", "part", "other", "often")
    side = lambda x, part: entries.select("token", F.col("part").alias(part), F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("f").alias(f"f{x}"))
    least = _least_common(F.col("na"), F.col("nb"), percent)
    met = both.join(side("a", "part"), ["token", "part"]).join(side("b", "other"), ["token", "other"]).filter(_may_be_alike(F.col("na"), F.col("nb"), percent) & (~F.col("often") | (F.least("fa", "fb") >= least)))
    met = met.groupBy("ka", "kb", "part", "other").agg(F.sum(F.when(F.col("often"), 0).otherwise(1)).alias("some"), F.sum(F.when(F.col("often"), 1).otherwise(0)).alias("more"), *(F.first(c).alias(c) for c in ("na", "nb", "fa", "fb")))
    frequent_part = F.when(F.least("fa", "fb") >= least, F.col("more")).otherwise(F.least("fa", "fb"))
    met = cut(met.filter(F.col("some") + frequent_part >= least).select("ka", "kb", "part", "other"))
    discard(spark, tokens)
    pool = _with_sets(pool, texts, met.select(F.col("ka").alias("id")).union(met.select(F.col("kb").alias("id"))), k)
    new = cut(_verified(met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct(), pool, percent))
    links = links.unionByName(new)

    # what the smallest members' links leave apart is expanded to all members
    larger = cut(member.join(stands.filter("members > 1").select("group", "part", "key"), ["group", "part"]).select("key", "class"))
    if larger.limit(1).count():
        joined = cut(components(links)).select("node", "component")
        part = lambda x, c: joined.select(F.col("node").alias(x), F.col("component").alias(c))
        apart = met.join(part("ka", "ca"), "ka", "left").join(part("kb", "cb"), "kb", "left").filter(F.coalesce("ca", "ka") != F.coalesce("cb", "kb")).select("ka", "kb")
        every = lambda x, c: larger.select(F.col("key").alias(x), F.col("class").alias(c))
        between = apart.join(every("ka", "a"), "ka", "left").join(every("kb", "b"), "kb", "left").select(F.coalesce("a", "ka").alias("a"), F.coalesce("b", "kb").alias("b"), "ka", "kb").filter("a <> ka or b <> kb")
        between = cut(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        pool = _with_sets(pool, texts, between.select(F.col("a").alias("id")).union(between.select(F.col("b").alias("id"))), k)
        links = links.unionByName(_verified(between, pool, percent))
    found = cut(components(links))

    chosen = sets.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("class"))
    of_class = chosen.join(found, F.col("class") == F.col("node"), "left").select("digest", F.coalesce("component", "class").alias("component"))
    out = sets.select("id", "n", "digest").join(cut(of_class), "digest", "left")
    one = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), one.alias("component_id"))


def _prefixes(classes: DataFrame, percent: int, last) -> DataFrame:
    """class, n, prefix, rare, same for (class, n, head): the first elements in the order with the frequent ones last, or null if the head doesn't tell.

    same is a digest of n and the prefix.
    """
    schema = T.StructType([T.StructField("class", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("rare", T.LongType()), T.StructField("same", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows, rares = batch.slice(at, 1000), [], []
                heads, marks = part.column("head").flatten().to_numpy(), last.value
                place = np.minimum(np.searchsorted(marks, heads), max(0, len(marks) - 1))
                known = marks[place] == heads if len(marks) else np.zeros(len(heads), bool)
                start = 0
                for k, n in zip(part.column("head").value_lengths().to_pylist(), part.column("n").to_pylist(), strict=True):
                    head, rare, size = heads[start : start + k], ~known[start : start + k], prefix_length(n, percent)
                    start += k
                    rares.append(int(rare.sum()))
                    rows.append(np.r_[head[rare], head[~rare]][:size] if k == n else head[rare][:size] if rares[-1] >= size else None)
                same = [None if row is None else xxhash.xxh3_128_digest(np.r_[n, row].tobytes()) for row, n in zip(rows, part.column("n").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("class"), part.column("n"), pa.array(rows, pa.list_(pa.int64())), pa.array(rares, pa.int64()), pa.array(same, pa.binary())], names=schema.names)

    return small_batches(classes.select("class", "n", "head")).mapInArrow(run, schema)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents", "doc_id", "text"), k=3, percent=90)
