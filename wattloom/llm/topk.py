"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments of a little under log2(codes) bits. Round r looks up all values r
bits away from a query's own segment values; a code is verified once, in the first segment and
round that reach it. After round r every code within m(r+1)-1 bits has been seen (m segments:
some segment differs in r bits at most), so a query is done once its kth verified distance is
within that. All rounds are DataFrame joins; codes shared by many rows are one entry, which holds
its k+1 smallest ids, so hot codes cost nothing, and hot segment values are split as skewed joins. All joins are merged: every side
grows with the table, and a stored table of a few compressed MB would else be broadcast through the driver at many times that size.

Defined cases: rows without a code (null vector, null component) neither ask nor are found; a row is no
neighbour of itself, but its copies are; ties go to the smaller id, null ids last; fewer than k
other rows give all of them; repeated rows are found one by one, but ask once; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import durable

BITS = 64
NEAREST = 10


def sign_code(column: str = "embedding") -> Column:
    """One bit per positive component, the first lowest; longer vectors wrap around by exclusive or."""
    bits = f"transform(`{column}`, (x, i) -> if(x is null, null, if(x > 0, shiftleft(1L, cast(i % {BITS} as int)), 0L)))"
    return F.when(F.size(column) > 0, F.expr(f"aggregate({bits}, 0L, (a, b) -> a ^ b)"))


def segments(codes: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment.

    A few bits less than log2(codes): a value then has some codes of its own, and a step of the
    radius makes fewer lookups than it finds codes.
    """
    m = max(2, min(16, round(BITS / max(math.log2(max(codes, 2)) - 3, 1.0))))
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def part(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def flips(width: int, r: int) -> list[int]:
    """All values of ``width`` bits with r bits set, ascending."""
    if r == 0:
        return [0]
    out, x = [], (1 << r) - 1
    while x < 1 << width:
        out.append(x)
        low = x & -x
        up = x + low
        x = ((x ^ up) >> 2) // low | up
    return out


def _nearest(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("ask").orderBy("distance", F.col("id").asc_nulls_last())
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).drop("nth")


def search(rows: DataFrame, asks: Column, k: int = NEAREST) -> DataFrame:
    """ask_id, rank, id, distance: the k nearest rows of ``rows`` (id, code) for each row that ``asks`` selects."""
    coded = durable(rows.filter("code is not null").select("id", "code", F.coalesce(asks, F.lit(False)).alias("asks")))
    nth = F.row_number().over(Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last()))
    entries = coded.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    books = durable(entries.groupBy("code").agg(F.collect_list("id").alias("some"), F.count(F.lit(1)).alias("n")).select(
        "code", F.when(F.col("n") > F.size("some"), F.concat("some", F.array_repeat(F.lit(None).cast(dict(rows.dtypes)["id"]), (F.col("n") - F.size("some")).cast("int"))))
        .otherwise(F.col("some")).alias("ids")))
    total, known = coded.count(), books.count()
    cut = segments(known)
    index = durable(books.select("code", F.explode(F.array(*[
        F.struct(F.lit(i).alias("seg"), part(F.col("code"), s, w).alias("value")) for i, (s, w) in enumerate(cut)])).alias("x"))
        .select("code", "x.seg", "x.value"))
    queries = durable(coded.filter("asks").select(F.col("code").alias("ask")).distinct())
    best, open_ = None, queries
    bits = F.bit_count(F.col("ask").bitwiseXOR(F.col("code")))
    far = [F.bit_count(part(F.col("ask").bitwiseXOR(F.col("code")), s, w)) for s, w in cut]
    for r in range(max(w for _, w in cut) + 1):
        probes = []
        for i, (s, w) in enumerate(cut):
            if r <= w:
                masks = F.from_json(F.lit(str(flips(w, r))), "array<bigint>")
                probes.append(open_.select("ask", F.explode(masks).alias("mask")).select(
                    "ask", F.lit(i).alias("seg"), part(F.col("ask"), s, w).bitwiseXOR(F.col("mask")).alias("value")))
        asked = probes[0]
        for p in probes[1:]:
            asked = asked.unionByName(p)
        first = F.lit(True)
        for i, f in enumerate(far):         # no segment nearer than r, none before this one as near
            first = first & F.when(F.col("seg") > i, f > r).otherwise(f >= r)
        hits = (asked.join(index.hint("merge"), ["seg", "value"]).filter(first).select("ask", "code", bits.alias("distance")))
        found = hits.join(books.hint("merge"), "code").select("ask", "distance", F.explode("ids").alias("id"))
        best = durable(_nearest(found if best is None else best.unionByName(found), k + 1))
        bound = len(cut) * (r + 1) - 1
        state = best.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("last"))
        enough = (F.col("n") >= min(k + 1, total)) & ((F.col("last") <= bound) | (F.col("n") >= total))
        open_ = durable(queries.join(state.filter(enough).select("ask").hint("merge"), "ask", "left_anti"))
        if open_.isEmpty():
            break
    asking = coded.filter("asks").select(F.col("id").alias("ask_id"), F.col("code").alias("ask")).distinct()
    own = F.row_number().over(Window.partitionBy("ask_id").orderBy((~F.col("me")).cast("int"), "distance", F.col("id").asc_nulls_last()))
    pairs = asking.join(best.hint("merge"), "ask").withColumn("me", F.col("id").eqNullSafe(F.col("ask_id")) & (F.col("distance") == 0))
    pairs = pairs.withColumn("o", own).filter(~(F.col("me") & (F.col("o") == 1)))
    rank = F.row_number().over(Window.partitionBy("ask_id").orderBy("distance", F.col("id").asc_nulls_last()))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("ask_id", "rank", "id", F.col("distance").cast("int").alias("distance"))


def nearest_vectors(vectors: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, distance for every vec_id divisible by 100, against all vectors."""
    rows = vectors.select(F.col("vec_id").alias("id"), sign_code().alias("code"))
    found = search(rows, F.col("id") % 100 == 0, k)
    return found.select(F.col("ask_id").alias("query_id"), "rank", F.col("id").alias("vec_id"), "distance")


ORACLE = f"""
with c as (
  select vec_id, list_reduce(list_transform(embedding, lambda x, i: case when x > 0 then 1::hugeint << ((i - 1) % {BITS})::int else 0::hugeint end), lambda a, b: xor(a, b)) code
  from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null)) = 0)
select q.vec_id query_id, row_number() over w rank, c.vec_id vec_id, bit_count(xor(q.code, c.code))::int distance
from c q join c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0
window w as (partition by q.vec_id order by bit_count(xor(q.code, c.code)), c.vec_id)
qualify row_number() over w <= {NEAREST}
"""
