"""Scoring documents by cross-entropy difference of two matched n-gram models.

The target model is counted on documents labelled good, the background model on all
documents. Both are interpolated bigram models over one vocabulary, all words of all
documents, with the same smoothing; background counts are scaled to the size of the
target, so that the models differ in what they have seen and not in how much. A document's score is
its cross-entropy per token under the target minus that under the background: the lower, the more
like the target.

Every word and every (previous, word) pair is counted, in tables that grow with the corpus. Documents are dealt into blocks
while they are read: a block keeps its tokens as ids and the 64-bit hash of each word, so no text is shuffled. A word, context or pair is
known to other blocks by a 64-bit key (two of 10^7 keys are equal with a probability of 10^-5). A block counts its keys and sends them,
sorted and packed, to the parts of the key range; a part adds up the counts of its keys and tells each block, in the order of the
block's keys, what other blocks counted. Documents are scored in their blocks. No task and no driver holds a whole model. A word is a context
as often as it is a token, but for the texts that end with it, so it has one key, and these texts are counted beside it.

Defined cases: a null or empty text has no tokens and null scores; labels that
are null or lack a document are ignored, repeated labels count once; without target documents both
models are the same and scores are 0; repeated rows count and are scored like others; texts
of any length are read in parts; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import durable
from wattloom.llm.simhash import SEED, word_blocks

BIGRAM_SHARE = 0.7
SMOOTHING = 0.5
#: Tokens of a block, after which it is closed with the next document.
BLOCK_TOKENS = 1_500_000
#: The word before the first; no word has a blank.
START = b" "
#: What a key stands for, in its two lowest bits.
TOKEN, PAIR = 0, 2
#: Counts of a key: occurrences in target and all texts, and the target and all texts that end with the word.
NUMBERS = ("t", "b", "et", "eb")
#: Tokens of the corpus for each part of the keys, which is a power of two.
PART_TOKENS = 1 << 21
#: Bits of a sorted key that are kept as steps; the others are kept as they are.
STEPS = 24


def _good(labels: DataFrame, kind: str) -> DataFrame:
    return labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").try_cast(kind).alias("doc_id")).distinct()


class Block:
    """Tokens of some texts, their distinct pairs, and counts (target, all) of tokens, contexts and pairs."""

    def __init__(self, texts: Iterator[str | None], good: np.ndarray) -> None:
        ids: defaultdict[bytes, int] = defaultdict(count(1).__next__, {START: 0})
        parts, lengths = [], []
        for text in texts:
            parts.append(_numbered(text, ids))
            lengths.append(len(parts[-1]))
        self.ids = dict(ids)
        self.count(np.concatenate([*parts, np.empty(0, np.int64)]), lengths, len(ids), good)

    @classmethod
    def of(cls, now: np.ndarray, lengths: list[int], size: int, good: np.ndarray) -> Block:
        """From token ids of texts of ``lengths``, one after the other."""
        block = cls.__new__(cls)
        block.count(now, lengths, size, good)
        return block

    def count(self, now: np.ndarray, lengths: list[int], size: int, good: np.ndarray) -> None:
        self.lengths, self.size = lengths, size
        before = np.concatenate([[0], now[:-1]]) if len(now) else now
        firsts = (np.cumsum(lengths) - lengths)[np.array(lengths) > 0] if lengths else np.empty(0, np.int64)
        before[firsts] = 0
        marked = np.repeat(good, self.lengths).astype(np.float64)
        self.pairs, self.place = np.unique(before << 32 | now, return_inverse=True)

        def counts(at: np.ndarray, size: int) -> np.ndarray:
            return np.array([np.bincount(at, marked, size), np.bincount(at, minlength=size)], dtype=np.int64)

        self.tokens, self.contexts, self.bigrams = counts(now, self.size), counts(before, self.size), counts(self.place, len(self.pairs))

    def table(self) -> pa.Table:
        """prev, word, t, b: a token has no ``prev``, a context no ``word``."""
        words = pa.array(list(self.ids), pa.binary())
        none = pa.nulls(self.size, pa.binary())
        seen = [np.flatnonzero(self.tokens[1]), np.flatnonzero(self.contexts[1])]
        before = [none.take(pa.array(seen[0])), words.take(pa.array(seen[1])), words.take(pa.array(self.pairs >> 32))]
        now = [words.take(pa.array(seen[0])), none.take(pa.array(seen[1])), words.take(pa.array(self.pairs & 0xFFFFFFFF))]
        n = [np.concatenate([self.tokens[i, seen[0]], self.contexts[i, seen[1]], self.bigrams[i]]) for i in (0, 1)]
        return pa.table({"prev": pa.concat_arrays(before), "word": pa.concat_arrays(now), "t": pa.array(n[0]), "b": pa.array(n[1])})

    def put(self, sums: pa.Table) -> None:
        """Sums over all blocks, in place of the block's own counts."""
        before, now = (np.array([-1 if w is None else self.ids[w] for w in sums.column(c).to_pylist()], dtype=np.int64) for c in ("prev", "word"))
        n = np.array([sums.column("t").to_numpy(), sums.column("b").to_numpy()], dtype=np.int64).reshape(2, -1)
        token, context = before < 0, now < 0
        pair = ~token & ~context
        self.tokens[:, now[token]] = n[:, token]
        self.contexts[:, before[context]] = n[:, context]
        self.bigrams[:, np.searchsorted(self.pairs, before[pair] << 32 | now[pair])] = n[:, pair]

    def losses(self, words: int, target: int, every: int) -> np.ndarray:
        """Total loss of each text under target and background, (2, texts)."""
        scale = np.array([[1.0], [target / max(every, 1) if target else 1.0]])
        total = target or every

        def of(n: np.ndarray) -> np.ndarray:
            return scale * (n if target else n[[1, 1]])

        tokens = (of(self.tokens) + SMOOTHING) / (total + SMOOTHING * (words + 1))        # one share is that of unseen words
        given = of(self.bigrams) / (of(self.contexts)[:, self.pairs >> 32] + 1e-9)
        loss = -np.log(BIGRAM_SHARE * given + (1 - BIGRAM_SHARE) * tokens[:, self.pairs & 0xFFFFFFFF])
        ends = np.cumsum(self.lengths, dtype=np.int64)
        out = np.zeros((2, len(self.lengths)))
        for i, (end, n) in enumerate(zip(ends.tolist(), self.lengths)):
            out[:, i] = loss[:, self.place[end - n:end]].sum(axis=1)
        return out


def _numbered(text: str | None, ids: defaultdict[bytes, int]) -> np.ndarray:
    """The tokens of a text as ids, which ``ids`` deals out."""
    parts = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in word_blocks((text or "").encode())]
    return np.concatenate([*parts, np.empty(0, np.int64)])


def _read(docs: pa.Table, good: pa.ChunkedArray) -> Block:
    ids = set(good.to_pylist())
    return Block((t.as_py() for t in docs.column("text")), np.array([i in ids for i in docs.column("doc_id").to_pylist()], dtype=bool))


# ---- blocks as rows --------------------------------------------------------------

ZSTD = pa.Codec("zstd", compression_level=6)
BLOCKS = "block long, place int, doc_id {kind}, n long, ids binary, words binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks: (place, doc_id, n) of each document, parts of the token ids by place, and the hashes of the words."""
    number = TaskContext.get().partitionId() << 32
    ids: defaultdict[bytes, int] = defaultdict(count(1).__next__, {START: 0})
    docs, parts, held, kind = [], [], 0, None

    def rows(size: int, **columns) -> pa.RecordBatch:
        types = {"block": pa.int64(), "place": pa.int32(), "doc_id": kind, "n": pa.int64(), "ids": pa.binary(), "words": pa.binary()}
        columns["block"] = pa.array(np.full(size, number))
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(size, t) for c, t in types.items()], names=list(types))

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal ids, docs, parts, held, number
        if not docs:
            return
        yield rows(len(docs), place=pa.array(range(len(docs))), doc_id=pa.array([d for d, _ in docs], kind), n=pa.array([n for _, n in docs]))
        tokens = np.concatenate(parts).astype("<i4")
        for at in range(0, len(tokens), 1 << 20):
            part = tokens[at:at + (1 << 20)]
            yield rows(1, place=pa.array([at // (1 << 20)]), n=pa.array([len(part)]), ids=pa.array([ZSTD.compress(part.tobytes(), asbytes=True)]))
        yield rows(1, words=pa.array([np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in ids), np.uint64, len(ids)).tobytes()]))
        ids, docs, parts, held, number = defaultdict(count(1).__next__, {START: 0}), [], [], 0, number + 1

    for batch in batches:
        kind = batch.column(0).type
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            tokens = _numbered(text.as_py(), ids)
            docs.append((doc, len(tokens)))
            parts.append(tokens.astype("<i4"))
            held += len(tokens)
            if held >= BLOCK_TOKENS:
                yield from closed()
    yield from closed()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _opened(table: pa.Table, marks: list[int]) -> tuple[Block, np.ndarray, pa.Table]:
    """A block, the keys of its tokens and pairs, and its documents by place."""
    documents = table.filter(pc.and_(pc.is_null(table.column("ids")), pc.is_null(table.column("words")))).sort_by("place")
    parts = table.filter(pc.is_valid(table.column("ids"))).sort_by("place")
    words = np.frombuffer(table.filter(pc.is_valid(table.column("words"))).column("words")[0].as_buffer(), np.uint64)
    tokens = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(pa.decompress(x.as_buffer(), n * 4, codec="zstd"), "<i4").astype(np.int64)
                                                      for x, n in zip(parts.column("ids"), parts.column("n").to_pylist())]])
    good = np.zeros(len(documents), bool)
    good[marks] = True
    block = Block.of(tokens, documents.column("n").to_pylist(), len(words), good)
    pair = _mixed(words[block.pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + words[block.pairs & 0xFFFFFFFF])
    keys = [x & ~np.uint64(3) | np.uint64(k) for x, k in ((_mixed(words), TOKEN), (pair, PAIR))]
    return block, np.concatenate(keys), documents


def _all(block: Block) -> np.ndarray:
    """``NUMBERS`` of tokens and pairs, in the order of the keys; the start has the texts that are not empty."""
    ends = block.tokens - block.contexts
    ends[:, 0] = block.contexts[:, 0]
    return np.concatenate([np.concatenate([block.tokens, ends]), np.concatenate([block.bigrams, np.zeros_like(block.bigrams)])], axis=1)


def _ranges(keys: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the counted keys by key, and where each of 2 ** ``bits`` equal parts of the key range begins and ends."""
    seen = np.flatnonzero(n.any(axis=0))
    order = seen[np.argsort(keys[seen])]
    begins = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return order, np.concatenate([[0], np.searchsorted(keys[order], begins), [len(order)]])


def _pack(n: np.ndarray) -> bytes:
    """Numbers that are not negative, in as few bytes each as the largest needs."""
    n = n.astype(np.min_scalar_type(int(n.max())))
    return bytes([n.itemsize]) + ZSTD.compress(n.tobytes(), asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(ZSTD.decompress(data[1:], size * data[0], asbytes=True), f"<u{data[0]}").astype(np.int64)


def _pack_keys(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys: the lower bytes, and steps of the upper ones."""
    high = (keys >> np.uint64(64 - STEPS)).astype(np.int64)
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :8 - STEPS // 8].tobytes()
    return low, high[0].astype("<i8").tobytes() + _pack(np.diff(high, prepend=high[0]))


def _unpack_keys(low: bytes, steps: bytes, size: int) -> np.ndarray:
    high = np.frombuffer(steps[:8], "<i8")[0] + np.cumsum(_unpack(steps[8:], size))
    wide = np.zeros((size, 8), np.uint8)
    wide[:, :8 - STEPS // 8] = np.frombuffer(low, np.uint8).reshape(size, -1)
    return wide.view("<u8").ravel() | high.astype(np.uint64) << np.uint64(64 - STEPS)


COUNTS = "block long, part long, n long, low binary, steps binary, t binary, b binary, et binary, eb binary"
SUMS = "to long, part long, n long, t binary, b binary, et binary, eb binary"


def _rows(columns: dict, schema: str) -> pa.Table:
    types = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table({name: pa.array(columns[name], types[kind]) for name, kind in (c.split() for c in schema.split(", "))})


def _counted(bits: int):
    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        block, keys, _ = _opened(table, marks.column("mark").to_pylist())
        n = _all(block)
        order, at = _ranges(keys, n, bits)
        out: dict[str, list] = {c.split()[0]: [] for c in COUNTS.split(", ")}
        for part in np.flatnonzero(np.diff(at)).tolist():
            own = order[at[part]:at[part + 1]]
            for name, x in zip(out, (table.column("block")[0].as_py(), part, len(own), *_pack_keys(keys[own]), *map(_pack, n[:, own]))):
                out[name].append(x)
        return _rows(out, COUNTS)
    return run


def _summed(table: pa.Table) -> pa.Table:
    """What other blocks counted of each block's keys in a part, for blocks that share any."""
    rows = table.to_pylist()
    sizes = [r["n"] for r in rows]
    keys = np.concatenate([_unpack_keys(r["low"], r["steps"], r["n"]) for r in rows])
    own = np.array([np.concatenate([_unpack(r[c], r["n"]) for r in rows]) for c in NUMBERS])
    _, at = np.unique(keys, return_inverse=True)
    others = np.array([np.bincount(at, n).astype(np.int64)[at] for n in own]) - own
    out: dict[str, list] = {c.split()[0]: [] for c in SUMS.split(", ")}
    for r, n in zip(rows, np.split(others, np.cumsum(sizes)[:-1], axis=1)):
        if n.any():
            for name, x in zip(out, (r["block"], r["part"], r["n"], *map(_pack, n))):
                out[name].append(x)
    return _rows(out, SUMS)


def _scored(sizes: tuple[int, int, int], bits: int):
    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        mark = pc.is_valid(known.column("mark"))
        block, keys, documents = _opened(table, known.filter(mark).column("mark").to_pylist())
        n = _all(block)
        order, at = _ranges(keys, n, bits)
        for r in known.filter(pc.invert(mark)).select(["part", "n", *NUMBERS]).to_pylist():
            own = order[at[r["part"]]:at[r["part"] + 1]]
            for count, name in zip(n, NUMBERS):
                count[own] += _unpack(r[name], r["n"])
        (block.tokens, ends), block.bigrams = np.split(n[:, :block.size], 2), n[:2, block.size:]
        block.contexts = block.tokens - ends
        block.contexts[:, 0] = ends[:, 0]
        lengths = np.array(block.lengths, dtype=np.int64)
        each = block.losses(*sizes) / np.maximum(lengths, 1)
        c = [pa.array(x, pa.float64(), mask=lengths == 0) for x in (each[0], each[1], each[0] - each[1])]
        return pa.table([documents.column("doc_id"), pa.array(lengths), *c], names=["doc_id", "tokens", "target_loss", "background_loss", "score"])
    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words.as_buffer(), np.int64)[1:])], names=["h"])     # without START


class Models:
    """Both models of a corpus that fits into memory, to look at them; ``scores`` never gathers one."""

    def __init__(self, block: Block, sizes: tuple[int, int, int]) -> None:
        self.counts, self.sizes = block, sizes
        order = sorted((w for w in block.ids if w != START), key=lambda w: (-block.tokens[1, block.ids[w]], w))
        self.ids = {w: i + 1 for i, w in enumerate(order)}
        words, target, every = sizes
        n = np.zeros((2, len(order) + 1))
        n[:, 1:] = block.tokens[:, [block.ids[w] for w in order]]
        n = n if target else n[[1, 1]]
        n[1] *= target / max(every, 1) if target else 1.0
        self.tokens = (n + SMOOTHING) / ((target or every) + SMOOTHING * (words + 1))

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame) -> Models:
        good = _good(labels, dict(docs.dtypes)["doc_id"])
        table, ids = docs.select("doc_id", "text").toArrow(), good.toArrow()
        block = _read(table, ids.column("doc_id"))
        return cls(block, (block.size - 1, int(block.tokens[0].sum()), int(block.tokens[1].sum())))

    def losses(self, text: str) -> tuple[int, float, float]:
        """Tokens, and the total loss under target and background; words and pairs have to be known."""
        own, known = Block([text], np.zeros(1, dtype=bool)), self.counts.table()
        mine = set(_keys(own.table()))
        own.tokens[:], own.contexts[:], own.bigrams[:] = 0, 0, 0
        own.put(known.take(pa.array([i for i, x in enumerate(_keys(known)) if x in mine], pa.int64())))
        loss = own.losses(*self.sizes)
        return own.lengths[0], float(loss[0, 0]), float(loss[1, 0])


def _keys(table: pa.Table) -> list[tuple[bytes | None, bytes | None]]:
    return list(zip(table.column("prev").to_pylist(), table.column("word").to_pylist()))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tokens, loss per token under target and background, and their difference."""
    kind = dict(docs.dtypes)["doc_id"]
    good = _good(labels, kind)
    blocks = durable(docs.select("doc_id", "text").mapInArrow(_blocks, BLOCKS.format(kind=kind)))
    documents = blocks.filter("ids is null and words is null").select(F.col("block").alias("to"), F.col("place").alias("mark"), "doc_id", "n")
    # labels grow with the corpus, so they are never sent to all tasks: one plan at every size
    marks = durable(documents.join(good.hint("merge"), "doc_id", "left_semi").select("to", "mark", "n"))
    words = blocks.filter("words is not null").select("words").mapInArrow(_hashes, "h long").distinct().count()
    sizes = (words, marks.agg(F.sum("n")).first()[0] or 0, documents.agg(F.sum("n")).first()[0] or 0)
    bits = (sizes[2] // PART_TOKENS).bit_length()
    counts = blocks.groupBy("block").cogroup(marks.groupBy("to")).applyInArrow(_counted(bits), COUNTS)
    sums = counts.groupBy("part").applyInArrow(_summed, SUMS)
    known = sums.unionByName(marks.select("to", "mark"), allowMissingColumns=True)
    return blocks.groupBy("block").cogroup(known.groupBy("to")).applyInArrow(
        _scored(sizes, bits), f"doc_id {kind}, tokens long, target_loss double, background_loss double, score double")
