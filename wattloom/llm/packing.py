"""Best-fit packing of token pieces into sequences, planned on a length histogram.

Texts become token ids with an end id; a document longer than a sequence is cut
into full pieces, its first piece taking the remainder. Pieces are counted by length,
best-fit decreasing runs over these counts (never over documents), and each piece takes
the planned slot of its rank within its length. The plan is bounded by the sequence
length, not by the data, so it is made on the driver and broadcast.

Defined cases: a null text is an empty one (its end id alone); texts of any length are
packed whole; repeated rows are packed separately; equal lengths are ranked by a
hash, then doc_id and piece; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import durable, rank_within

SEQUENCE = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Characters that go to the tokenizer at once.
SLICE = 1 << 20


@functools.cache
def exact_encoder(name: str = VOCABULARY):
    """The tokenizer file's own encoder; a worker holds it only once a text asks for it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@functools.cache
def fast_encoder(name: str = VOCABULARY):
    """A faster encoder over the same vocabulary and pattern."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str) -> np.ndarray:
    """Ids of ``tokenizers`` without special tokens, then the end id, as little-endian uint32.

    Only a text that spells a special token is treated differently by the two
    encoders; such a text goes to ``tokenizers`` itself.
    """
    if SPECIAL in text:
        ids = exact_encoder().encode(text, add_special_tokens=False).ids
    else:
        ids = fast_encoder().encode_ordinary(text)
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    out[-1] = END_ID
    return out


def cut(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


def _pieces(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py() or "")
                for i, (start, length) in enumerate(cut(len(ids), most)):
                    rows.append((doc, i, start, length, zlib.crc32(ids[start:start + length])))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(most), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], most: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, slots, first sequence, offset).

    Sequences with the same free space are kept as ranges of numbers. The longest
    pieces go first; each goes where the least space is left over, and opens sequences only when
    none has room. Every step ends a length or uses up a range, so the work follows the
    number of lengths.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}     # free space -> ranges (first sequence, how many)
    spaces: list[int] = []
    opened = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in open_:
                open_[space] = []
                insort(spaces, space)
            open_[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fits = most // length           # how many of this length one new sequence takes
                whole = left // fits
                if whole:
                    for i in range(fits):
                        slots.append((length, rank, whole, opened, i * length))
                        rank += whole
                    put(most - fits * length, opened, whole)
                    opened += whole
                    left -= whole * fits
                else:
                    for i in range(left):
                        slots.append((length, rank + i, 1, opened, i * length))
                    put(most - left * length, opened, 1)
                    opened += 1
                    left = 0
                continue
            space = spaces[at]
            first, n = open_[space].pop()
            take = min(n, left)
            if take < n:
                open_[space].append((first + take, n - take))
            if not open_[space]:
                del open_[space]
                spaces.pop(at)
            slots.append((length, rank, take, first, most - space))
            put(space - length, first, take)
            rank += take
            left -= take
    return slots


def pack(docs: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """Pieces with sequence_id and offset. Sequences are gapless from offset 0."""
    spark = docs.sparkSession
    cut_up = durable(pieces(docs, most))
    counts = {r[0]: r[1] for r in cut_up.groupBy("length").count().collect()}      # at most ``most`` rows
    slots = spark.createDataFrame(plan(counts, most) or [(0, 0, 0, 0, 0)],
                                  "__length long, __rank long, __slots long, __sequence long, offset long")
    spread = F.xxhash64("doc_id", "piece")
    ranked = rank_within(cut_up, ["length"], [spread, F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32"],
                         F.pmod(spread, F.lit(1024)).cast("int"), "__nth")
    fits = ((F.col("length") == F.col("__length")) & (F.col("__nth") >= F.col("__rank"))
            & (F.col("__nth") < F.col("__rank") + F.col("__slots")))
    return ranked.join(F.broadcast(slots), fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("__sequence") + F.col("__nth") - F.col("__rank")).alias("sequence_id"), "offset")
