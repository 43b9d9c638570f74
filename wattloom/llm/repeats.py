"""Removal of every byte that a repeated 400-byte string covers, by suffix arrays of shards.

A string of ``LENGTH`` bytes is located by an anchor that its own first bytes decide
(the least hashed gram), so equal strings have anchors in the same place. All strings of one anchor
form a unit: their common core after the anchor is the unit's key. Then

1. a key that occurs once has no repeated string;
2. equal units (same key, same bytes around it) repeat in whole;
3. what remains, different units of one key, is sorted: each shard is the text of many such
   units, with the core as one symbol. Its suffix array comes from induced sorting, its
   permuted common prefixes show which strings stand beside an equal one.

Shards are bounded. A key with many different units is dealt to several shards, which then
publish a hash of each different string, so that equal strings meet across them too. No step
gathers the units of a key in one task, and nothing but counts reaches the driver.

Defined cases: a null text is an empty one; texts shorter than ``LENGTH`` keep all bytes; copies of
a document repeat in whole; overlapping occurrences within one text count; texts of any length are
read whole, in blocks; repeated rows are separate documents; an empty table gives an empty
result; further columns are ignored, or kept by ``strip``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import WORD, durable
from wattloom.llm.suffixes import permuted_prefixes, suffix_array

LENGTH = 400
#: Bytes hashed for an anchor, and how many of them a string chooses its anchor from.
GRAM = 16
CHOICE = 160
CORE = LENGTH - CHOICE + 1
#: Strings of one text looked at together.
BLOCK = 1 << 19
#: Different units of a key in one shard, and symbols in one suffix array.
PIECE = 4096
SHARD = 1 << 18
#: Documents given out together.
TEXTS = 256

#: Bytes that stand for a word where repeats of words are sought: ``LENGTH`` bytes are 50 words then.
WORD_BYTES = 8
WORDS = LENGTH // WORD_BYTES

_PLACE = np.uint64((1 << 20) - 1)


def utf8(text: str | None) -> bytes:
    return (text or "").encode()


_WORD = re.compile(WORD.encode())


def word_code(text: str | None) -> bytes:
    """Each word of a text as the eight bytes of its hash."""
    return np.fromiter(map(xxhash.xxh64_intdigest, _WORD.findall(utf8(text))), np.uint64).tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on, by doubling."""
    h, width, factor = _BYTE[text], 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    return _mixed(h)


def leftmost_least(h: np.ndarray, choice: int) -> np.ndarray:
    """For each run of ``choice`` hashes the place of the least, the first one among equals."""
    n = len(h)
    ranked = np.full(-(-n // choice) * choice, np.uint64(0xFFFFFFFFFFFFFFFF))
    ranked[:n] = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    rows = ranked.reshape(-1, choice)
    to_here = np.minimum.accumulate(rows, axis=1).ravel()
    from_here = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(from_here[:n - choice + 1], to_here[choice - 1:n]) & _PLACE).astype(np.int64)


def _anchored(text: bytes) -> Iterator[tuple[int, bytes, list[int], list[int], list[int]]]:
    """Per block its place and bytes, and of its units the first strings, numbers of strings and anchors."""
    for base in range(0, len(text) - LENGTH + 1, BLOCK):
        part = text[base:base + BLOCK + LENGTH - 1]
        anchors = leftmost_least(gram_hashes(np.frombuffer(part, np.uint8)), CHOICE)[:len(part) - LENGTH + 1]
        first = np.append([0], np.flatnonzero(np.diff(anchors)) + 1)
        count = np.diff(np.append(first, len(anchors)))
        yield base, part, first.tolist(), count.tolist(), anchors[first].tolist()


def unit_keys(text: bytes) -> list[int]:
    """The keys of ``units`` alone."""
    key = xxhash.xxh3_64_intdigest
    return [key(part[a:a + CORE]) for _, part, _, _, anchors in _anchored(text) for a in anchors]


def units(text: bytes) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(key, digest of all its bytes, first string, number of strings, bytes before the anchor)."""
    key, whole = xxhash.xxh3_64_intdigest, xxhash.xxh3_128
    for base, part, first, count, anchors in _anchored(text):
        for at, n, anchor in zip(first, count, anchors):
            around = whole(part[at:at + n - 1 + LENGTH])
            around.update(struct.pack("<HH", n, anchor - at))
            yield key(part[anchor:anchor + CORE]), around.digest(), base + at, n, anchor - at


def _keys(batches: Iterator[pa.RecordBatch], code: Callable = utf8) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [k for text in batch.column(0) for k in unit_keys(code(text.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64))], names=["key"])


def _units(batches: Iterator[pa.RecordBatch], code: Callable = utf8) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for mark, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows += [(k, a, mark, at, n, left) for k, a, at, n, left in units(code(text.as_py()))]
        if rows:
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(c[0], dtype=np.uint64).view(np.int64)), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary()),
                pa.array(c[3], pa.int64()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int32())],
                names=["key", "around", "mark", "at", "n", "before"])


def _fetch(batches: Iterator[pa.RecordBatch], code: Callable = utf8) -> Iterator[pa.RecordBatch]:
    """Bytes before and after the core of the asked-for units of each text, once per text."""
    seen: set[bytes] = set()
    for batch in batches:
        rows: list[tuple] = []
        for mark, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if mark in seen:
                continue
            seen.add(mark)
            data = code(text.as_py())
            for u in asked.as_py():
                core = u["at"] + u["before"]
                rows.append((u["key"], u["piece"], u["pieces"], u["sure"], mark, u["at"], u["n"],
                             data[u["at"]:core], data[core + CORE:u["at"] + u["n"] - 1 + LENGTH]))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                             names=["key", "piece", "pieces", "sure", "mark", "at", "n", "left", "right"])


def sort_shard(rows: list[tuple]) -> list[tuple]:
    """Repeated strings of a shard of units (key, piece, pieces, sure, mark, at, n, left, right).

    Gives (mark, first string, number of strings, None) for each run of repeated strings and, for keys in
    several pieces, (mark, string, 1, hash) for one of each set of equal strings. A suffix is a string if it
    starts in a unit's first n places; equal strings share CHOICE symbols, the core being one.
    """
    end, low, cores = len(rows), len(rows) + 1, {}
    parts, place, unit, in_unit = [], 0, [], []
    for i, (key, piece, _, _, _, _, n, left, right) in enumerate(rows):
        core = cores.setdefault((key, piece), low + 256 + len(cores))
        parts += [np.frombuffer(left, np.uint8).astype(np.int64) + low, [core], np.frombuffer(right, np.uint8).astype(np.int64) + low, [i + 1]]
        unit.append(place)
        place += len(left) + len(right) + 2
    s = np.concatenate([*parts, [0]])
    counts = np.array([r[6] for r in rows])
    starts = np.repeat(np.array(unit), counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat(np.arange(end), counts)
    sa = suffix_array(s)
    shared = permuted_prefixes(s, sa)
    of_place = np.full(len(s), -1, dtype=np.int64)
    of_place[starts] = np.arange(len(starts))
    order = of_place[sa]                               # strings in order, -1 for other suffixes
    same = (shared[sa] >= CHOICE)
    group = np.cumsum(~same)                           # equal strings have one number
    strings = order >= 0
    order, group = order[strings], group[strings]
    size = np.bincount(group)
    twice = np.zeros(len(starts), dtype=bool)
    twice[order] = size[group] > 1
    out: list[tuple] = []
    sure = np.array([r[3] for r in rows])
    hit = np.flatnonzero(twice & ~sure[owner])
    if len(hit):
        offset = starts - np.array(unit)[owner]
        breaks = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1
        for run in np.split(hit, breaks):
            r = rows[owner[run[0]]]
            out.append((r[4], r[5] + int(offset[run[0]]), len(run), None))
    spread = np.array([r[2] > 1 for r in rows])
    heads = order[np.append([True], group[1:] != group[:-1])] if len(order) else order
    for w in heads[spread[owner[heads]]].tolist():
        key, _, _, _, mark, at, _, left, right = rows[owner[w]]
        o = int(starts[w]) - unit[owner[w]]
        before = left[o:]
        text = struct.pack("<qH", key, len(before)) + before + right[:CHOICE - 1 - len(before)]
        out.append((mark, at + o, 1, xxhash.xxh3_128_digest(text)))
    return out


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = sort_shard(rows)
        if found:
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["mark", "at", "n", "hash"])

    held: list[tuple] = []
    symbols = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if symbols >= SHARD and row[:2] != held[-1][:2]:
                yield from emit(held)
                held, symbols = [], 0
            held.append(row)
            symbols += len(row[7]) + len(row[8]) + 2
    if held:
        yield from emit(held)


def texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__mark``, a digest that stands for the text; null texts are empty."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__mark", F.unhex(F.md5("text")))


def repeated(docs: DataFrame, code: Callable = utf8) -> DataFrame:
    """mark, spans: for each text with repeated strings of its ``code``, array of (at, n), runs of n strings from at on."""
    marked = texts(docs.select("text")).select(F.col("__mark").alias("mark"), "text")
    found = marked.mapInArrow(lambda batches: _units(batches, code), "key long, around binary, mark binary, at long, n int, before int")
    # a table of its own, so that the join below reads two plain shuffles and a hot key can be split
    keys = marked.select("text").mapInArrow(lambda batches: _keys(batches, code), "key long")
    common = durable(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"))
    unit = durable(found.join(common, "key", "left_semi"))
    kinds = durable(unit.groupBy("key", "around").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("mark", "at", "n", "before")).alias("u")))
    whole = unit.join(kinds.filter("c > 1").select("key", "around"), ["key", "around"], "left_semi").select("mark", "at", "n")
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").withColumn(
        "pieces", F.ceil(F.col("kinds") / F.lit(PIECE)).cast("int")).select("key", "pieces")
    open_ = kinds.join(several, "key").select(
        F.col("u.mark").alias("mark"), F.struct(
            "key", F.pmod(F.xxhash64("around"), F.col("pieces")).cast("int").alias("piece"), "pieces", (F.col("c") > 1).alias("sure"),
            F.col("u.at").alias("at"), F.col("u.n").alias("n"), F.col("u.before").alias("before")).alias("u"))
    asked = open_.groupBy("mark").agg(F.collect_list("u").alias("asked"))          # units of one text
    shards = (marked.join(asked, "mark").select("mark", "text", "asked")
              .mapInArrow(lambda batches: _fetch(batches, code), "key long, piece int, pieces int, sure boolean, mark binary, at long, n int, left binary, right binary")
              .repartition("key", "piece").sortWithinPartitions("key", "piece", "mark", "at"))
    strings = durable(shards.mapInArrow(_sorted_shards, "mark binary, at long, n int, hash binary"))
    published = strings.filter("hash is not null")
    across = published.join(published.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "hash", "left_semi")
    spans = whole.unionByName(strings.filter("hash is null").drop("hash")).unionByName(across.drop("hash")).distinct()
    return spans.groupBy("mark").agg(F.collect_list(F.struct("at", "n")).alias("spans"))      # of one text


def covered(size: int, spans: Iterable[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings of ``spans`` cover."""
    runs: list[list[int]] = []
    for a, b in sorted((s["at"], s["at"] + s["n"] - 1 + LENGTH) for s in spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, min(b, size)) for a, b in runs]


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (batch.slice(i, TEXTS) for batch in batches for i in range(0, batch.num_rows, TEXTS)):
        rows = []
        for text, spans in zip(part.column(1), part.column(2)):
            data = text.as_py().encode()
            runs = covered(len(data), spans.as_py() or ())
            kept = kept_bytes(data, runs)
            rows.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
        c = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()),
                                          pa.array(c[3], pa.string()), pa.array(c[4], pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text for every row of ``docs``.

    ``text`` are the remaining bytes; the rest of a character cut in two is left out there, the hash has it.
    """
    spans = durable(repeated(docs))
    kind = dict(docs.dtypes)["doc_id"]
    rows = texts(docs.select("doc_id", "text"))
    return (rows.join(spans, rows["__mark"] == spans["mark"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_digests, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"))


def without(text: str, spans: Iterable[dict]) -> str:
    """``text`` without its repeated bytes; the rest of a character cut in two goes as well."""
    data = utf8(text)
    return kept_bytes(data, covered(len(data), spans)).decode(errors="ignore")


def without_words(text: str, spans: Iterable[dict]) -> str:
    """``text`` without its repeated words, each up to the next word; ``spans`` are of its word code."""
    data = utf8(text)
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    # whole words only: a string that starts within a code covers the words that lie in it whole
    runs = [(-(-a // WORD_BYTES), b // WORD_BYTES) for a, b in covered((len(starts) - 1) * WORD_BYTES, spans)]
    return kept_bytes(data, [(starts[a], starts[b]) for a, b in runs]).decode()


def strip(docs: DataFrame, by_words: bool = False) -> DataFrame:
    """``docs`` without repeated strings of ``LENGTH`` bytes, or of ``WORDS`` words whatever the space between them; n_chars follows."""
    spans = durable(repeated(docs, word_code if by_words else utf8))
    cut_out = without_words if by_words else without

    def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cut_out(text.as_py(), found.as_py()) for text, found in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["__text", *batch.schema.names[2:]])
    rows = texts(docs)
    others = [c for c in docs.columns if c != "text"]
    joined = rows.join(spans, rows["__mark"] == spans["mark"], "left").select(
        rows["text"].alias("__t"), F.col("spans").alias("__s"), *[rows[f"`{c}`"].alias(f"__c{i}") for i, c in enumerate(others)])
    kinds = dict(docs.dtypes)
    cut = joined.filter("__s is not null").mapInArrow(
        stripped, ", ".join(["__text string", *[f"__c{i} {kinds[c]}" for i, c in enumerate(others)]]))
    whole = joined.filter("__s is null").select(F.col("__t").alias("__text"), *[f"__c{i}" for i in range(len(others))])
    both = whole.unionByName(cut)
    columns = {"text": F.col("__text"), **{c: F.col(f"__c{i}") for i, c in enumerate(others)}}
    if kinds.get("n_chars") in ("bigint", "int"):
        columns["n_chars"] = F.length("__text").cast(kinds["n_chars"])
    return both.select(*[columns[c].alias(c) for c in docs.columns])
