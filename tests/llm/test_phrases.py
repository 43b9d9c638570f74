"""Collocations against brute force, and their defined edge cases."""

import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattloom.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(docs, least=30, top=2000):
    f = defaultdict(Counter)
    for _, text, lang, _ in docs:
        for words in pieces(text):
            for k in range(1, 5):
                f[lang if lang is not None else "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cand = {g: v for g, v in c.items() if len(g) > 1 and v >= least}
        gone = {g[a:b] for g, v in cand.items() for a in range(len(g)) for b in range(a + 2, len(g) + 1)
                if b - a < len(g) and 100 * v >= 80 * c[g[a:b]]}
        best = []
        for g, a in cand.items():
            if g not in gone:
                score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(best)[:top]):
            out.append({"lang": lang, "rank": i + 1, "phrase": p.decode(), "a": -a, "l": l, "r": r, "n": n, "score": -s})
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r["lang"], r["rank"]))


def made(seed, docs=160):
    r = random.Random(seed)
    words = ["The", "of", "and", "New", "York", "city", "é", "Ünit", "x\x00y", "to", "be", "or", "not"]
    fixed = ["new york city hall", "to be or not to be", "of the", "a a a a a"]
    out = []
    for i in range(docs):
        parts = []
        for _ in range(r.randrange(0, 12)):
            parts.append(r.choice(fixed) if r.random() < .5 else " ".join(r.choice(words) for _ in range(r.randrange(1, 9))))
        out.append((i, r.choice([" ", "  ", "\t"]).join(r.choice([p, p + r.choice(".,;:!?\n\r\x0b\x0c")]) for p in parts), r.choice(["en", "en", "de", None, "und"]), "a"))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=50))
def test_index_counts_all_phrases(ids):
    ids = np.array([*ids, 0], np.int32)
    got = {tuple(g): n for table, c in phrases.phrases(ids, 4, range(2, 5)) for g, n in zip(table.tolist(), c.tolist())}
    line = ids.tolist()
    assert got == Counter(tuple(line[i:i + k]) for k in (2, 3, 4) for i in range(len(line) - k + 1) if 0 not in line[i:i + k])


def test_intervals_stay_in_step():
    """Left and right intervals of a phrase have the same width, whichever way it was found."""
    ids = np.array([1, 2, 1, 2, 3, 0, 1, 2, 3, 1, 2, 0], np.int32)
    index = phrases.Index(ids, 3)
    spans = index.words(np.array([1, 2, 3]))
    _, _, left = index.extended(spans, True)
    _, _, right = index.extended(spans, False)
    for s in (left, right):
        assert (s[1] - s[0] == s[3] - s[2]).all()
    assert sorted(zip(*[x.tolist() for x in left])) == sorted(zip(*[x.tolist() for x in right]))


def test_words_are_split_as_the_contract_says():
    texts = ["A b.\tc,,d  É\x00x", "", None, "x", "\n\n", "a\x0bB\x0cc\rd"]
    words, counts = phrases.words_of(pa.array(texts, pa.large_string()))
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(texts):
        own = words.slice(at[i], counts[i]).to_pylist()
        assert [[w for w in p.split("\x01") if w] for p in "\x01".join(own).split(".")] == [*pieces(t), []]


@pytest.mark.parametrize("shard", [64, 1 << 21])
def test_rows_equal_brute_force(make, rows, odd, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "BLOCK", 512 if shard == 64 else 1 << 24)
    docs = made(1) + odd
    got = rows(phrases.collocations(make(docs).repartition(3)))
    assert ordered(got) == ordered(brute(docs)) and len(got) > 15


def test_the_first_of_each_language(make, rows):
    docs = made(2)
    assert ordered(rows(phrases.collocations(make(docs), least=5, top=7))) == ordered(brute(docs, 5, 7))


def test_shards_are_cut_between_pieces(make, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 100)
    from pyspark import TaskContext
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    text = ". ".join("a b c d e" for _ in range(200))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    out = [b for b in phrases._shards(iter([batch])) if b.column("ids")[0].is_valid]
    assert len(out) > 5 and sum(b.column("n")[0].as_py() for b in out) == 200 * 6
    for b in out:
        assert np.frombuffer(pa.decompress(b.column("ids")[0].as_buffer(), b.column("n")[0].as_py() * 4, codec="zstd"), "<i4")[-1] == 0


def test_no_rows(make):
    assert phrases.collocations(make([])).count() == 0
    assert phrases.collocations(make([(1, None, None, None), (2, "a b", "en", "a")])).count() == 0
