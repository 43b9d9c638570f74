"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document's expected copies are
target / words of its source. The expected copies are prefix-summed within the
source, one random offset per source is added, and a document is emitted once for
every integer that its interval crosses. Within a source documents stand in the
order of their size (equal sizes by a hash), so that the words taken differ from the
target by about one document only.

Defined cases: a null text has size 0; a null source is a source of its own and comes
last; documents of size 0 take part and take no words; a source without words has target 0
and is never drawn; repeated rows are separate documents; an empty table gives an
empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import WORD, durable, rank_within

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2.0
SEED = 17


def sized(docs: DataFrame, size: str = "__size") -> DataFrame:
    """Add the number of words of each text."""
    return docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per source of ``sizes`` (__source, __size): __source_size, __target, __rate, __offset.

    Weights are dealt to sources by code point, nulls last, repeating. ``share`` times all
    words is shared by weight; no target goes above ``max_repeat`` times the words of
    its source, and what that leaves over is shared again by weight. Filling all
    sources up to one common level per weight gives this fixed point directly.
    """
    sources = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    # windows over one row per source
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    s = sources.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")))
    s = s.withColumns({"__cap": F.col("__source_size") * F.lit(float(max_repeat)),
                       "__total": F.sum("__source_size").over(Window.partitionBy()) * F.lit(float(share))})
    s = s.withColumn("__level", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__level", F.col("__source").asc_nulls_last())
    upto, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({"__full_before": F.coalesce(F.sum("__cap").over(upto), F.lit(0.0)), "__w_left": F.sum("__w").over(rest)})
    s = s.withColumn("__full", F.col("__full_before") + F.col("__level") * F.col("__w_left") <= F.col("__total"))
    everything = Window.partitionBy()
    left = F.col("__total") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(everything), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(everything)
    s = s.withColumn("__target", F.when(F.col("__full"), F.col("__cap")).otherwise(left * F.col("__w") / open_w))
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce("__source", F.lit("")))), 1, 8)
    return s.select("__source", "__source_size", "__target",
                    F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).alias("__rate"),
                    (F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)).alias("__offset"))


def drawn(docs: DataFrame, max_repeat: float = MAX_REPEAT, **how) -> DataFrame:
    """``docs`` (doc_id, text or __size, source, ...) with __source_size, __target and __copies.

    The rank of a document within its source is its place among equal sizes plus the
    documents of smaller sizes; both come from counts, so a hot source or a hot size
    is never numbered in one task.
    """
    rows = docs if "__size" in docs.columns else sized(docs)
    rows = rows.withColumns({"__source": F.col("source"),
                             "__hash": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))})
    narrow = durable(rows.select("__source", "__size", "__hash"))
    plan = targets(narrow, max_repeat=max_repeat, **how)
    salt = F.conv(F.substring("__hash", 1, 2), 16, 10).cast("int")
    ranked = rank_within(rows, ["__source", "__size"], ["__hash", F.col("doc_id").asc_nulls_last()], salt, "__place", narrow)
    smaller = Window.partitionBy("__source").orderBy("__size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (narrow.groupBy("__source", "__size").agg(F.count(F.lit(1)).alias("__n"))
             .select(F.col("__source").alias("__s2"), F.col("__size").alias("__z2"),
                     F.coalesce(F.sum("__n").over(smaller), F.lit(0)).alias("__smaller")))
    steps = ahead.join(plan.withColumnRenamed("__source", "__s3"), F.col("__s2").eqNullSafe(F.col("__s3")), "left").drop("__s3")
    out = ranked.join(steps, F.col("__source").eqNullSafe(F.col("__s2")) & (F.col("__size") == F.col("__z2")))
    nth = (F.col("__place") + F.col("__smaller")).cast("double")
    crossed = (F.floor((nth + 1.0) * F.col("__rate") + F.col("__offset")) - F.floor(nth * F.col("__rate") + F.col("__offset")))
    copies = F.least(F.coalesce(crossed, F.lit(0)), F.ceil(F.col("__rate"))).cast("long")
    return out.withColumn("__copies", F.coalesce(copies, F.lit(0).cast("long"))).drop(
        "__source", "__hash", "__s2", "__z2", "__smaller", "__place", "__rate", "__offset")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is drawn, in the columns of ``docs``."""
    out = drawn(docs, **how).filter("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted), copies."""
    narrow = durable(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "__size"))
    return drawn(narrow).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))


#: The same rows in one statement.
ORACLE = f"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size
  from documents),
s as (
  select source, sum(size)::bigint source_size, row_number() over (order by source collate "binary" nulls last) - 1 nth
  from d group by source),
w as (
  select *, case nth % 3 when 0 then {WEIGHTS[0]}.0::double when 1 then {WEIGHTS[1]}.0::double else {WEIGHTS[2]}.0::double end w,
         source_size * {MAX_REPEAT}::double cap, sum(source_size) over () * {SHARE}::double total from s),
l as (
  select *, cap / w as level,
         coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) full_before,
         sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) w_left from w),
f as (select *, full_before + level * w_left <= total as isfull from l),
t as (
  select source, source_size,
         case when isfull then cap
              else (total - coalesce(sum(case when isfull then cap end) over (), 0)) * w / sum(case when not isfull then w end) over () end target,
         ('0x' || substr(md5('{SEED}|' || coalesce(source, '')), 1, 8))::bigint / 4294967296.0::double as off from f),
r as (
  select d.doc_id, d.size, t.source_size, t.target, t.off,
         case when t.source_size > 0 then t.target / t.source_size end rate,
         (row_number() over (partition by d.source order by d.size, d.h, d.doc_id nulls last) - 1)::double n
  from d join t on d.source is not distinct from t.source),
c as (
  select *, coalesce(least((floor((n + 1.0::double) * rate + off) - floor(n * rate + off))::bigint, ceil(rate)::bigint), 0)::bigint copies from r)
select doc_id, size, source_size, target, (size * copies)::bigint taken, copies from c
"""
