"""Phrase collocations from FM-indexes over word ids.

The texts are cut into shards of about ``SHARD`` words, one language each, while they are read: the words become ids of
the shard, the boundaries of pieces become 0. Words are counted over all shards, and those that are frequent
enough get dense global ids (below 2^31: two fit in a long), which go back to the shards that hold them. A shard then builds the suffix orders of its ids and of their
reverse (to the depth of the longest phrase), their Burrows-Wheeler transforms, and extends intervals:
a phrase to the left in the one transform, to the right in the other, keeping both intervals in step. The extensions of all intervals of
one length are found at once by sorting the symbols that the transform holds in them, so each
comes with its count. Pairs of frequent words are counted and summed over the shards first; the frequent ones go back, and the
longer phrases are enumerated from them only where all their pairs are frequent, then summed as well. No phrase that
is frequent overall is lost by this, since its parts are at least as frequent.

Words are split by Arrow kernels. A shard holds whole pieces, so nothing depends on where shards are cut. Counts are longs; products in
scores are decimals, and floors are exact.

Defined cases: a null text is empty; a null lang is ``und``, together with texts of that label; texts without words take part with no words; repeated
rows count as often as they come; a table without frequent phrases, or without rows, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import durable

SHARD = 3 << 19
#: Texts handed to the Arrow kernels at once, in bytes.
BLOCK = 1 << 22
LONGEST = 4
LEAST = 30
TOP = 2000
SALTS = 64
SPLIT = "[.,;:!?\x0a-\x0d]"


# ---- shards of word ids ----------------------------------------------------------

def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order, a full stop for each boundary of pieces, and the number of entries of each text.

    A full stop cuts pieces, so it can't be a word.
    """
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    marked = pc.replace_substring_regex(pc.replace_substring(low, "\t", " "), SPLIT, " . ")
    lists = pc.split_pattern(pc.binary_join_element_wise(marked, pa.scalar(".", marked.type), pa.scalar(" ", marked.type)), " ")
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    return flat.filter(full), np.bincount(parent.filter(full).to_numpy(zero_copy_only=False), minlength=len(texts))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shards: either (shard, lang, pos, word, n), or a part of the ids (shard, pos, ids) with positions of that shard."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}

    def out(lang: str) -> Iterator[pa.RecordBatch]:
        words = pa.concat_arrays(held.pop(lang))
        sizes.pop(lang)
        ends = [0]
        if len(words) > 2 * SHARD:              # one text may be longer than a shard: cut between pieces
            dots = np.flatnonzero(pc.equal(words, ".").to_numpy(zero_copy_only=False)) + 1
            ends += sorted({int(dots[np.searchsorted(dots, t)]) for t in range(SHARD, len(words), SHARD)})
        for a, b in zip(ends, [*ends[1:], len(words)]):
            yield from shard(lang, words.slice(a, b - a))

    def shard(lang: str, words: pa.Array) -> Iterator[pa.RecordBatch]:
        nonlocal number
        coded = words.dictionary_encode()
        ids, names = coded.indices.to_numpy().astype("<i4") + 1, coded.dictionary
        dot = pc.index(names, pa.scalar(".", names.type)).as_py()
        ids[ids == dot + 1] = 0
        n = np.bincount(ids, minlength=len(names) + 1)[1:]
        real = np.flatnonzero(n)
        real = real[real != dot]
        if len(real):
            yield _rows(number, lang, pos=(real + 1).astype("i4"), word=names.take(pa.array(real)).cast(pa.string()), n=n[real])
            for at in range(0, len(ids), 1 << 20):
                part = pa.compress(ids[at:at + (1 << 20)].tobytes(), codec="zstd", asbytes=True)
                yield _rows(number, lang, pos=np.array([at], "i4"), n=np.array([min(len(ids) - at, 1 << 20)]), ids=pa.array([part], pa.binary()))
            number += 1

    for batch in batches:
        langs = pc.fill_null(batch.column("lang"), "und").cast(pa.string())
        texts = batch.column("text").cast(pa.large_string())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
            words, counts = words_of(texts.slice(at, to - at))
            lang_of = langs.slice(at, to - at).dictionary_encode()
            which = np.repeat(lang_of.indices.to_numpy(), counts)
            for i, lang in enumerate(lang_of.dictionary.to_pylist()):
                own = words.filter(pa.array(which == i)) if len(lang_of.dictionary) > 1 else words
                held.setdefault(lang, []).append(own)
                sizes[lang] = sizes.get(lang, 0) + len(own)
                if sizes[lang] >= SHARD:
                    yield from out(lang)
            if sum(sizes.values()) >= 2 * SHARD:            # many languages: the fullest one goes
                yield from out(max(sizes, key=sizes.get))
            at = to
    for lang in list(held):
        yield from out(lang)


def _rows(shard: int, lang: str, pos, n, word=None, ids=None) -> pa.RecordBatch:
    k = len(pos)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(k, shard, "i8")), pa.array([lang], pa.string()).take(pa.array(np.zeros(k, "i8"))), pa.array(pos, pa.int32()),
         word if word is not None else pa.nulls(k, pa.string()), pa.array(n, pa.int64()), ids if ids is not None else pa.nulls(k, pa.binary())],
        names=["shard", "lang", "pos", "word", "n", "ids"])


# ---- one shard's index -----------------------------------------------------------

class Index:
    """Depth-limited FM-index of an id sequence (0 ends a piece) and of its reverse."""

    def __init__(self, ids: np.ndarray, symbols: int, depth: int = LONGEST):
        self.symbols, self.size = symbols, len(ids)
        # one transform holds what stands before each suffix, the other one what stands behind each prefix
        self.left, self.right = self._transform(ids, depth), self._transform(ids[::-1], depth)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=symbols + 1))])
        self._rank: dict[bool, np.ndarray] = {}

    def _transform(self, ids: np.ndarray, depth: int) -> np.ndarray:
        n = len(ids)
        rank, span, width = ids.astype(np.int64), 1, self.symbols + 1
        while span < depth and n:
            behind = np.zeros(n, np.int64)
            behind[:n - span] = rank[span:] + 1 if n > span else 0
            key = rank * (width + 1) + behind
            rank = np.unique(key, return_inverse=True)[1]
            width, span = int(rank.max()) + 1, span * 2
        order = np.argsort(rank, kind="stable")
        before = ids[order - 1].astype(np.int64)
        before[order == 0] = 0
        return before

    def words(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Intervals (in either order the same) of single symbols."""
        return self.starts[ids], self.starts[ids + 1], self.starts[ids], self.starts[ids + 1]

    def extended(self, spans: tuple[np.ndarray, ...], to_left: bool) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Every extension by one symbol: index of its interval, the symbol, its own intervals (count: their width).

        ``spans`` are (low, high) in the order of suffixes and (low, high) in that of reversed prefixes.
        """
        low, high, other, _ = spans if to_left else (spans[2], spans[3], spans[0], spans[1])
        transform = self.left if to_left else self.right
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        keys, first, count = np.unique(owner * (self.symbols + 1) + transform[place], return_index=True, return_counts=True)
        place = place[first]
        owner, symbol = np.divmod(keys, self.symbols + 1)
        # smaller symbols of the same interval come first in the other order
        run = np.cumsum(count) - count
        heads = np.searchsorted(owner, owner)
        new_other = other[owner] + run - run[heads]
        # the first occurrence in the interval says how often the symbol comes before it
        new_low = self.starts[symbol] + self._ranks(to_left)[place]
        keep = symbol > 0
        mine, others = (new_low, new_low + count), (new_other, new_other + count)
        both = (*mine, *others) if to_left else (*others, *mine)
        return owner[keep], symbol[keep], tuple(x[keep] for x in both)

    def _ranks(self, to_left: bool) -> np.ndarray:
        """For each place of a transform, how often its symbol occurs before it."""
        if to_left not in self._rank:
            transform = self.left if to_left else self.right
            order = np.argsort(transform, kind="stable")
            rank = np.empty(self.size, np.int64)
            rank[order] = np.arange(self.size) - self.starts[transform[order]]
            self._rank[to_left] = rank
        return self._rank[to_left]


def phrases(ids: np.ndarray, symbols: int, lengths: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of the phrase's words by column, counts) for each length up to the last of ``lengths``, ascending.

    Words are extended to the left, pairs to the right, triples to the left again, and so on.
    """
    index = Index(ids, symbols, max(lengths))
    table = np.flatnonzero(np.bincount(ids, minlength=symbols + 1)[1:])[:, None] + 1
    spans = index.words(table[:, 0])
    for length in range(2, max(lengths) + 1):
        to_left = length % 2 == 0
        owner, symbol, spans = index.extended(spans, to_left)
        table = np.column_stack([symbol, table[owner]] if to_left else [table[owner], symbol])
        if length in lengths:
            yield table, spans[1] - spans[0]


# ---- tasks -----------------------------------------------------------------------

def _sequence(parts: pa.Table) -> np.ndarray:
    parts = parts.sort_by("pos")
    return np.concatenate([np.frombuffer(pa.decompress(x.as_buffer(), int(n) * 4, codec="zstd"), "<i4")
                           for x, n in zip(parts.column("ids"), parts.column("n").to_pylist())])


def _known(ids: np.ndarray, pos: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with the known words numbered from 1 and all others 0, and the global id of each number (0: none)."""
    number = np.zeros(max(int(ids.max(initial=0)), int(pos.max(initial=0))) + 1, np.int32)
    number[pos] = np.arange(1, len(pos) + 1)
    return _squeezed(number[ids]), np.concatenate([[0], names])


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """One boundary instead of several in a row."""
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0)
    return ids[keep]


PAIRS = "shard long, p long, n long"


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


def _pairs(parts: pa.Table, known: pa.Table) -> pa.Table:
    """All pairs of known words of one shard with their counts."""
    if not len(parts) or not len(known):
        return pa.table({c: pa.array([], pa.int64()) for c in ("shard", "p", "n")})
    ids, names = _known(_sequence(parts), known.column("number").to_numpy(), known.column("id").to_numpy())
    table, n = next(phrases(ids, len(names) - 1, range(2, 3)))
    return pa.table({"shard": np.full(len(n), parts.column("shard")[0].as_py()), "p": _packed(names[table[:, 0]], names[table[:, 1]]), "n": n})


LONGER = "p long, q long, n long"


def _longer(parts: pa.Table, known: pa.Table) -> pa.Table:
    """All phrases of three and four words of one shard whose pairs are all known: p, q hold two ids each, the last one is 0 in the shorter ones.

    ``known`` has rows of words (number, id) and of pairs (id: both words).
    """
    pair = known.filter(pc.is_null(known.column("number")))
    word = known.filter(pc.is_valid(known.column("number")))
    none = pa.table({c: pa.array([], pa.int64()) for c in ("p", "q", "n")})
    if not len(parts) or not len(pair):
        return none
    ids, names = _known(_sequence(parts), word.column("number").to_numpy(), word.column("id").to_numpy())
    order = np.argsort(names)

    def local(ids: np.ndarray) -> np.ndarray:
        return order[np.searchsorted(names, ids, sorter=order)].astype(np.int64)
    wide, both = len(names), pair.column("id").to_numpy()
    keys = np.sort(local(both >> 32) * wide + local(both & 0xFFFFFFFF))
    both = ids[:-1].astype(np.int64) * wide + ids[1:]
    near = np.searchsorted(keys, both)
    joined = keys[np.minimum(near, len(keys) - 1)] == both
    # a boundary goes between words that are no known pair; words without any neighbour go
    after, before = np.concatenate([joined, [False]]), np.concatenate([[False], joined])
    runs = np.column_stack([np.zeros(len(ids), np.int32), ids])
    ids = _squeezed(np.concatenate([runs[np.column_stack([~before, after | before])], [0]]))
    out = [none]
    for table, n in phrases(ids, len(names) - 1, range(3, LONGEST + 1)):
        w = [names[table[:, i]] for i in range(table.shape[1])] + [np.zeros(len(n), np.int64)] * (LONGEST - table.shape[1])
        out.append(pa.table({"p": _packed(w[0], w[1]), "q": _packed(w[2], w[3]), "n": n}))
    return pa.concat_tables(out)


# ---- the job ---------------------------------------------------------------------

def counted(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All frequent phrases (g: ids of 1 to 4 words, f), the frequent words (lang, word, id, f), all words per lang (lang, n)."""
    shards = durable(docs.select("lang", "text").mapInArrow(
        _shards, "shard long, lang string, pos int, word string, n long, ids binary"))
    words, parts = shards.filter("word is not null"), shards.filter("ids is not null").select("shard", "pos", "n", "ids")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    # a word has one row per shard at most, and so has a pair: totals go to each of them in the same shuffle
    common = durable(words.select("shard", "lang", "pos", "word", F.sum("n").over(Window.partitionBy("lang", "word")).alias("f"))
                     .filter(F.col("f") >= least))
    frequent = numbered(common.groupBy("lang", "word").agg(F.max("f").alias("f")))
    known = durable(common.select("shard", "lang", "pos", "word").join(frequent.select("lang", "word", "id"), ["lang", "word"]).select(
        F.col("shard").alias("to"), F.col("pos").alias("number"), "id"))
    pairs = parts.groupBy("shard").cogroup(known.groupBy("to")).applyInArrow(_pairs, PAIRS)
    kept = durable(pairs.withColumn("f", F.sum("n").over(Window.partitionBy("p"))).filter(F.col("f") >= least))
    more = known.unionByName(kept.select(F.col("shard").alias("to"), F.lit(None).cast("int").alias("number"), F.col("p").alias("id")))
    longer = (parts.groupBy("shard").cogroup(more.groupBy("to")).applyInArrow(_longer, LONGER)
              .groupBy("p", "q").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))

    def both(c: str):
        return F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    grams = (frequent.select(F.array("id").alias("g"), "f")
             .unionByName(kept.groupBy("p").agg(F.max("f").alias("f")).select(F.array(*both("p")).alias("g"), "f"))
             .unionByName(longer.select(F.filter(F.array(*both("p"), *both("q")), lambda w: w > 0).alias("g"), "f")))
    return durable(grams), frequent, totals


def numbered(rows: DataFrame) -> DataFrame:
    """``rows``, stored, with dense ids from 1: the rows of the partitions before, plus the place in the own one."""
    at = durable(rows.withColumn("at", F.monotonically_increasing_id()))
    before, offsets = 1, []
    for r in at.groupBy(F.shiftright("at", 33).cast("int").alias("part")).count().orderBy("part").collect():     # one number per partition
        offsets.append((r.part, before))
        before += r["count"]
    start = F.map_from_arrays(F.array(*[F.lit(p) for p, _ in offsets]).cast("array<int>"), F.array(*[F.lit(b) for _, b in offsets]).cast("array<long>"))
    return at.withColumn("id", F.try_element_at(start, F.shiftright("at", 33).cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")


def scored(grams: DataFrame) -> DataFrame:
    """Candidates that no longer phrase stands for: g, a, l, r, score (decimals are exact there)."""
    long = grams.filter(F.size("g") > 1)
    cuts = long.select("g", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k")).select("g", "k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.slice("g", 1, F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), F.slice("g", F.col("k") + 1, F.size("g") - F.col("k")).alias("part")))).alias("x"))
    sides = cuts.select("g", "k", "x.side", "x.part").join(grams.select(F.col("g").alias("part"), "f"), "part")

    def side(k: int, s: int):
        return F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{'lr'[s]}{k}")
    by = sides.groupBy("g").agg(*[side(k, s) for k in range(1, LONGEST) for s in (0, 1)])
    # one word less at either end suffices: what holds a phrase holds one of these too, at least as often
    ends = long.filter(F.size("g") > 2).select("f", F.explode(F.array(
        F.slice("g", 1, F.size("g") - 1), F.expr("slice(g, 2, size(g) - 1)"))).alias("g"))
    within = ends.groupBy("g").agg(F.max("f").alias("longest"))
    big = "decimal(20,0)"
    rows = long.join(durable(within), "g", "left").filter(
        F.col("longest").isNull() | (F.col("longest").cast(big) * 100 < F.col("f").cast(big) * 80)).select("g", F.col("f").alias("a"))
    rows = rows.join(durable(by), "g")

    def cut(k: int):
        value = F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as {big}) div (cast(l{k} as {big}) + cast(r{k} as {big}))")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(value.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return rows.select("g", "a", F.least(*[cut(k) for k in range(1, LONGEST)]).alias("x")).select("g", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    grams, frequent, totals = counted(docs, least)
    rows = durable(scored(grams))
    named = rows.select("g", F.posexplode("g").alias("nth", "id")).join(frequent.select("id", "lang", "word"), "id").groupBy("g").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = rows.join(durable(named), "g")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    first = rows.withColumn("salt", F.pmod(F.hash("g"), F.lit(SALTS))).withColumn("nth", part).filter(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in one statement.
ORACLE = rf"""
with d as (
  select row_number() over () doc, coalesce(lang, 'und') lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select doc, lang, unnest(l) piece, generate_subscripts(l, 1) pn from (select doc, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') l from d)),
s as (select doc, lang, pn, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') l from p),
tokens as (select doc, lang, pn, unnest(l) w, generate_subscripts(l, 1) i from s),
four as (select lang, w, lead(w, 1) over o w2, lead(w, 2) over o w3, lead(w, 3) over o w4 from tokens window o as (partition by doc, pn order by i)),
f as (
  select lang, [w] g, count(*) f from four group by all
  union all select lang, [w, w2] g, count(*) f from four where w2 is not null group by all having count(*) >= {LEAST}
  union all select lang, [w, w2, w3] g, count(*) f from four where w3 is not null group by all having count(*) >= {LEAST}
  union all select lang, [w, w2, w3, w4] g, count(*) f from four where w4 is not null group by all having count(*) >= {LEAST}),
c as (select * from f where len(g) > 1),
subs as (
  select lang, g[a:b] g, max(f) f from (select lang, g, f, unnest(range(1, len(g))) a from c) x, unnest(range(x.a + 1, len(x.g) + 1)) y(b)
  where b - a + 1 < len(g) group by all),
kept as (select c.* from c left join subs using (lang, g) where subs.f is null or 100::hugeint * subs.f < 80::hugeint * c.f),
cuts as (select lang, g, f, unnest(range(1, len(g))) k from kept),
sc as (
  select x.lang, x.g, x.f a, k, l.f l, r.f r, (2000000::hugeint * x.f) // (l.f + r.f) score
  from cuts x join f l on l.lang = x.lang and l.g = x.g[1:k] join f r on r.lang = x.lang and r.g = x.g[k + 1:]
  qualify row_number() over (partition by x.lang, x.g order by score, k) = 1),
n as (select lang, sum(f)::bigint n from f where len(g) = 1 group by lang)
select lang, row_number() over w as rank, array_to_string(g, ' ') phrase, a, l, r, n, score::bigint score
from sc join n using (lang)
window w as (partition by lang order by score desc, a desc, array_to_string(g, ' '))
qualify row_number() over w <= {TOP}
"""
