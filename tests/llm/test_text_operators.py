"""Operators on texts against brute force, and their defined edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from wattloom.llm import language, licenses, mixing, modelscore, packing, repeats, simhash, suffixes, toxicity


# ---- mixing ----------------------------------------------------------------------

def level_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Reshare by weight round by round until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        give = {s: (left - sum(capped.values())) * w[s] / sum(w[o] for o in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if give[s] >= most * sizes[s]]
        if not over:
            return {**capped, **give}
        capped.update({s: most * sizes[s] for s in over})


def test_mixing_targets_and_copies(make, rows, odd):
    docs = [*odd, *[(100 + i, "w " * (1 + i * 7 % 90), "en", f"s{i % 3}") for i in range(300)]]
    out = rows(mixing.digest(make(docs)))
    assert len(out) == len(docs)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in docs:
        sizes[s] += words(t)
    want = level_targets(sizes)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in out) == sorted((i or -1, words(t)) for i, t, _, _ in docs)
    source = {i: s for i, _, _, s in docs}
    taken, largest = Counter(), Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1


def test_mix_repeats_rows_in_the_same_columns(make, rows, odd):
    df = make(odd)
    a, b = rows(mixing.mix(df)), rows(mixing.mix(df))
    assert mixing.mix(df).columns == df.columns
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert max(Counter((r["doc_id"]) for r in a if r["doc_id"] != 6).values()) <= 2


def test_mixing_of_nothing(make):
    assert mixing.digest(make([])).count() == 0 and mixing.mix(make([])).count() == 0


# ---- packing ---------------------------------------------------------------------

def test_pieces_are_whole_and_sequences_gapless(make, rows, odd):
    from tokenizers import Tokenizer
    import public_tokenizers
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [*odd, (11, "a <|endoftext|> b", "en", "a"), *[(50 + i, "tok " * (i * 37 % 900), "en", "a") for i in range(40)]]
    out = rows(packing.pack(make(docs)))
    ids = {i: exact.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _, _ in docs}
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(i for i, *_ in docs)
    sequences = defaultdict(list)
    for r in out:
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 1024 or r["piece"] == 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(make([])).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_gives_every_piece_one_slot(counts):
    slots = packing.plan(counts, 64)
    places, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in slots:
        ranks[length] += range(rank, rank + n)
        for i in range(n):
            places[first + i].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for p in places.values():
        ends = [0, *[o + n for o, n in sorted(p)]]
        assert [o for o, _ in sorted(p)] == ends[:-1] and ends[-1] <= 64
    total = sum(k * n for k, n in counts.items())
    assert len(places) <= max(1.25 * total / 64 + 2, sum(n for k, n in counts.items() if k > 32) + total / 32 + 1)


# ---- simhash ---------------------------------------------------------------------

def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_against_brute_force(make, rows, odd):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(0)
    base = list(rng.choice(words, 3000))
    near = []
    for i in range(30):
        t = list(base)
        for k in rng.integers(0, 3000, i % 4):
            t[k] = "other"
        near.append((200 + i, " ".join(t), "en", "a"))
    docs = [*odd, *near]
    got = rows(simhash.near_duplicates(make(docs)))
    prints = [plain_fingerprint(t) for _, t, _, _ in docs]
    root = plain_components(prints)
    least = {}
    for (i, *_), r in zip(docs, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{p:016x}", least.get(r)) for (i, *_), p, r in zip(docs, prints, root))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    kept = rows(simhash.keep_one(make(docs)))
    assert Counter(r["doc_id"] for r in kept) == Counter(least.get(r) for r in set(root))
    assert simhash.near_duplicates(make([])).count() == 0


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"a{i % 91} B{i % 17}" for i in range(500))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash.word_blocks, "__defaults__", (64,))
    assert simhash.fingerprint(text.encode()) == want


@given(st.lists(st.integers(0, 2 ** 16 - 1), max_size=60), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_tree_finds_what_a_scan_finds(values, radius):
    tree = simhash.BKTree()
    for v in values:
        assert sorted(tree.values[i] for i in tree.within(v, radius)) == sorted(x for x in tree.values if (x ^ v).bit_count() <= radius)
        tree.add(v)


# ---- repeats ---------------------------------------------------------------------

@given(st.lists(st.integers(1, 3), max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_array_and_prefixes(symbols):
    s = np.array([*symbols, 0], dtype=np.int64)
    plain = s.tolist()
    order = sorted(range(len(plain)), key=lambda i: plain[i:])
    sa = suffixes.suffix_array(s)
    assert sa.tolist() == order
    shared = suffixes.permuted_prefixes(s, sa)
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(plain) and plain[a + k] == plain[b + k]:
            k += 1
        assert shared[b] == k


def plain_removal(docs):
    seen = Counter()
    for _, t, *_ in docs:
        b = (t or "").encode()
        seen.update(b[s:s + 400] for s in range(len(b) - 399))
    out = Counter()
    for i, t, *_ in docs:
        b = (t or "").encode()
        hit = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - 399):
            if seen[b[s:s + 400]] > 1:
                hit[s:s + 400] = True
        runs = int((np.diff(np.append(0, hit.astype(int))) == 1).sum())
        out[(i, len(b), int(hit.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeats_against_brute_force(make, rows, monkeypatch, small):
    if small:           # keys in several pieces, shards of a few units
        monkeypatch.setattr(repeats, "PIECE", 4)
        monkeypatch.setattr(repeats, "SHARD", 2000)
    rng = np.random.default_rng(3)
    letters = list("abé ")
    word = lambda n: "".join(rng.choice(letters, n))
    base, docs = word(700), []
    for i in range(60):
        u, v = sorted(rng.integers(0, 700, 2))
        middle = base[u:v] if i % 3 else base
        docs.append((i, word(rng.integers(0, 300)) + middle + word(rng.integers(0, 300)), "en", "a"))
    docs += [(100, None, "en", "a"), (101, "", "en", "a"), (102, "x" * 3000, "en", "a"), (103, base, "en", "a"), (104, base, "en", "a"),
             (104, base, "en", "a"), (None, base[:420], "en", "a"), (105, "ab" * 700, "en", "a")]
    df = make(docs)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(repeats.digest(df)))
    assert got == plain_removal(docs)
    stripped = rows(repeats.strip(df))
    assert len(stripped) == len(docs) and all(r["n_chars"] == len(r["text"]) for r in stripped)
    assert not [r for r in stripped if r["doc_id"] in (103, 104) and r["text"]]
    assert repeats.digest(make([])).count() == 0


def test_repeats_in_blocks(monkeypatch):
    text = bytes(np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8))
    whole = {(k, at + i) for k, _, at, n, _ in repeats.units(text) for i in range(n)}
    monkeypatch.setattr(repeats, "BLOCK", 300)
    assert {(k, at + i) for k, _, at, n, _ in repeats.units(text) for i in range(n)} == whole


# ---- language, toxicity, licenses, scoring ---------------------------------------

def test_language_edges_and_held_out(documents, make, rows, odd):
    model = language.fit(documents)
    out = rows(language.predict(documents, model))
    truth = {r["doc_id"]: r["lang"] for r in rows(documents.select("doc_id", "lang"))}
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    edges = rows(language.predict(make(odd), model))
    assert len(edges) == len(odd) and all(0 <= r["score"] <= 1 for r in edges)
    assert all(r["lang_pred"] == "und" for r in edges if r["doc_id"] in (1, 2, 3, 10))
    assert [r["held_out"] for r in edges if r["doc_id"] is None] == [False]
    assert {r["lang_pred"] for r in rows(language.predict(make([(1, "abc", None, "a")])))} == {"und"}


def test_language_mixture_of_two():
    rng = np.random.default_rng(0)
    table = rng.dirichlet(np.full(200, 0.1), size=3).T
    counts = rng.multinomial(600, table[:, 0]) + rng.multinomial(400, table[:, 2])
    full = np.zeros((language.BUCKETS, 3)) + 1e-9
    full[:200] = table + 1e-9
    share = language.languages(np.pad(counts, (0, language.BUCKETS - 200)), full)
    assert share[1] == 0 and share[0] == pytest.approx(0.6, abs=0.05)


def test_toxicity_learns_and_keeps_clean(make, rows, spark, odd):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(50)]
    docs, labels = [], []
    for i in range(600):
        bad, junk = i % 5 == 0, i % 7 == 0
        t = " ".join([*rng.choice([w.replace("w", "plain") for w in words], 30), *(["vileword"] if bad else []), *(["zzzz"] if junk else [])])
        docs.append((1000 + i, re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t), "en", "a"))
        if i % 2:
            labels.append((1000 + i, 0 if junk else 1, int(bad)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    df = make([*docs, *odd])
    out = rows(toxicity.scores(df, lab))
    assert len(out) == len(docs) + len(odd)
    truth = {i: "vileword" in t for i, t, *_ in docs}
    assert all(r["toxic"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth)
    kept = rows(toxicity.reject(df, lab))
    assert {r["doc_id"] for r in kept} == {i for i, t, *_ in [*docs, *odd] if not truth.get(i)}
    assert toxicity.reject(df, lab).columns == df.columns
    none = rows(toxicity.scores(df, lab.limit(0)))
    assert len(none) == len(out) and not any(r["toxic"] for r in none)
    assert toxicity.scores(make([]), lab).count() == 0


def test_toxicity_cut_with_wrong_labels():
    p = np.linspace(0.99, 0.01, 1000)
    truth = np.arange(1000) < 200
    y = truth.astype(float)
    clean = toxicity.best_cut(p, y)
    assert (p >= clean).sum() == 200
    y[4:200:20] = 0                                 # one label of twenty flipped, from near the top on
    y[300::70] = 1
    assert 190 <= (p >= toxicity.best_cut(p, y)).sum() <= 210
    assert toxicity.best_cut(p, np.zeros(1000)) == toxicity.REJECT_AT


def test_licenses(make, rows, odd):
    texts = {1001: "intro text here\nReleased under the MIT License.\nmore text", 1002: "Licensed under the Apache License, Version 2.0.",
             1003: "the license of nature is under no version of public work", 1004: "This work is licensed under the GNU General Public License, version 3.",
             1005: "Licensed under CC BY-NC 4.0.", 1006: "Licensed under CC BY 4.0."}
    out = rows(licenses.scan(make([*[(i, t, "en", "a") for i, t in texts.items()], *odd])))
    found = {r["doc_id"]: r["families"] for r in out}
    assert [found[i] for i in texts] == [["mit"], ["apache"], [], ["gpl"], ["cc-by-nc"], ["cc-by"]]
    assert len(out) == len(texts) + len(odd) and not any(found[i] for i, *_ in odd)


def test_background_has_whole_paragraphs(make):
    text = " ".join(f"word{i}" for i in range(2000)) + " lastword"
    got = licenses.background(make([(1, text, "en", "a"), (2, "Released under the MIT License.", "en", "a")]).select("doc_id", "text"))
    assert got == [licenses.grams(licenses.words(text))]


def test_wrapped_licenses(make, rows):
    mit = "/*\n * Copyright (c) someone\n *\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n" \
          " * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction\n */"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = "intro\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n" \
          "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    cut = "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof nothing"
    texts = {1: mit, 2: bsd, 3: gpl, 4: f"{bsd}\n{bsd}", 5: cut, 6: "Released under\nthe MIT License."}
    out = {r["doc_id"]: r for r in rows(licenses.scan(make([(i, t, "en", "a") for i, t in texts.items()])))}
    assert [out[i]["families"] for i in texts] == [["mit"], ["bsd"], ["gpl"], ["bsd"], [], ["mit"]]
    assert [[(f["line"], f["last_line"]) for f in out[i]["findings"]] for i in texts] == [[(3, 4)], [(0, 2)], [(2, 4)], [(0, 2), (3, 5)], [], [(0, 1)]]


def test_scoring_prefers_the_target(make, rows, spark, odd):
    rng = np.random.default_rng(0)
    good = [(2000 + i, " ".join(rng.choice(["sun", "moon", "star"], 40)), "en", "a") for i in range(40)]
    poor = [(3000 + i, " ".join(rng.choice(["mud", "moon", "dirt"], 40)), "en", "a") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good[:20]] + [(i, 0, 0) for i, *_ in poor[:20]], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in rows(modelscore.scores(make([*good, *poor, *odd]), labels))}
    assert max(out[i]["score"] for i, *_ in good) < min(out[i]["score"] for i, *_ in poor)
    assert out[1]["tokens"] == 0 and out[1]["score"] is None and out[6]["tokens"] == 120_000
    assert all(abs(r["score"]) < 1e-9 for r in rows(modelscore.scores(make(good), labels.limit(0))))


def test_scoring_matches_plain_counts(make, rows, spark):
    docs = [(1, "a b a b c", "en", "a"), (2, "b b a", "en", "a"), (3, "c d", "en", "a")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    m = modelscore.Models.fit(make(docs), labels)
    assert list(m.ids) == [b"b", b"a", b"c", b"d"]
    uni = np.array([0, 2, 2, 1, 0]) + 0.5
    assert m.tokens[0] == pytest.approx(uni / uni.sum())
    back = np.array([0, 4, 3, 2, 1]) * 5 / 10 + 0.5
    assert m.tokens[1] == pytest.approx(back / back.sum())
    n, t, _ = m.losses("a b")
    p = [0.7 * 1.0 + 0.3 * m.tokens[0][2], 0.7 * 1.0 + 0.3 * m.tokens[0][1]]
    assert n == 2 and t == pytest.approx(-np.log(p).sum(), abs=1e-6)


def plain_scores(docs, good):
    """Both losses per token, from dictionaries of all words and pairs."""
    lists = [(t or "").lower().split() for _, t, *_ in docs]
    uni, ctx, bi = ([Counter(), Counter()] for _ in range(3))
    for (i, *_), w in zip(docs, lists):
        for m in (0, 1) if i in good else (1,):
            uni[m].update(w)
            ctx[m].update([" ", *w][:-1] if w else [])
            bi[m].update(zip([" ", *w], w))
    n, v = [sum(u.values()) for u in uni], len(uni[1])
    scale = [1.0, n[0] / n[1]]
    return [[-sum(np.log(0.7 * scale[m] * bi[m][p] / (scale[m] * ctx[m][p[0]] + 1e-9) + 0.3 * (scale[m] * uni[m][p[1]] + 0.5) / (n[0] + 0.5 * (v + 1)))
                  for p in zip([" ", *w], w)) / len(w) for m in (0, 1)] if w else None for w in lists]


def test_scoring_counts_all_words_and_pairs(make, rows, spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"v{x}" for x in rng.integers(0, 90_000, 1500)), "en", "a") for i in range(120)]
    docs += [(200 + i, " ".join(rng.choice(["sun", "moon", "star", "Sun"], 30)), "en", "a") for i in range(20)] + [(None, "sun moon", "en", "a"), (300, None, "en", "a")]
    good = {*range(0, 40), *range(200, 206)}
    labels = spark.createDataFrame([(i, 1, 0) for i in [*good, *good]] + [(None, 1, 0), (9999, 1, 0), (50, None, 0)], "doc_id long, quality int, toxic int")
    assert len({w for _, t, *_ in docs for w in (t or "").split()}) > 50_000
    out = {r["doc_id"]: r for r in rows(modelscore.scores(make(docs), labels))}
    assert len(out) == len(docs)
    for (i, *_), want in zip(docs, plain_scores(docs, good)):
        got = out[i]
        if want is None:
            assert got["tokens"] == 0 and got["score"] is None
        else:
            assert [got["target_loss"], got["background_loss"]] == pytest.approx(want, rel=1e-9)


def test_counts_are_packed_by_part(make, rows, spark, monkeypatch):
    monkeypatch.setattr(modelscore, "PART_TOKENS", 300)
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"v{min(x, 4000)}" for x in rng.zipf(1.3, 300)), "en", "a") for i in range(60)] + [(90, "", "en", "a"), (91, "v1", "en", "a")]
    good = set(range(0, 60, 3))
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in rows(modelscore.scores(make(docs).repartition(5), labels))}
    for (i, *_), want in zip(docs, plain_scores(docs, good)):
        assert [out[i]["target_loss"], out[i]["background_loss"]] == (pytest.approx(want, rel=1e-9) if want else [None, None])


def test_packed_keys_and_counts_come_back_smaller():
    rng = np.random.default_rng(5)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, 400_000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    low, steps = modelscore._pack_keys(keys)
    assert (modelscore._unpack_keys(low, steps, len(keys)) == keys).all() and len(low) + len(steps) < 6.5 * len(keys)
    n = np.array([0, 1, 1, 255, 256, 70_000, 1 << 33])
    assert (modelscore._unpack(modelscore._pack(n), len(n)) == n).all()
    one = keys[-1:]
    assert (modelscore._unpack_keys(*modelscore._pack_keys(one), 1) == one).all()


def test_repeats_leave_the_text_in_sight(make, rows):
    passage = "".join(f"w{i}\u00e9 " for i in range(120))
    short = " ".join(f"s{i}" for i in range(60))                 # over 50 words, below 400 bytes
    docs = [(1, f"one \u00fc{passage}end of one", "en", "a"), (2, f"two {passage}", "en", "a"), (3, f"three {short}", "en", "a"),
            (4, f"four {short}", "en", "a"), (5, None, "en", "a")]
    out = {r["doc_id"]: r for r in rows(repeats.digest(make(docs)))}
    assert out[1]["text"] == "one \u00fcend of one" and out[2]["text"] == "two " and out[5]["text"] == ""
    assert out[3]["text"] == f"three {short}" and out[4]["text"] == f"four {short}"
    for r in out.values():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] and len(r["text"].encode()) == r["n_bytes"] - r["n_removed"]


def test_keys_alone_are_those_of_the_units(monkeypatch):
    text = np.random.default_rng(3).bytes(3000)
    for block in (repeats.BLOCK, 300):
        monkeypatch.setattr(repeats, "BLOCK", block)
        assert repeats.unit_keys(text) == [u[0] for u in repeats.units(text)] and repeats.unit_keys(text[:399]) == []


# ---- repeats of words ------------------------------------------------------------

def plain_word_removal(docs, n=repeats.WORDS):
    """Texts without the words that a run of n words covers which also starts anywhere else."""
    found = {i: list(re.finditer(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, (_, t, _, _) in enumerate(docs)}
    starts = Counter(tuple(m.group() for m in ms[a:a + n]) for ms in found.values() for a in range(len(ms) - n + 1))
    out = []
    for i, (doc, t, _, _) in enumerate(docs):
        data, ms = (t or "").encode(), found[i]
        gone = {j for a in range(len(ms) - n + 1) if starts[tuple(m.group() for m in ms[a:a + n])] > 1 for j in range(a, a + n)}
        edges = [m.start() for m in ms] + [len(data)]
        out.append((doc, (data[:edges[0]] + b"".join(data[edges[j]:edges[j + 1]] for j in range(len(ms)) if j not in gone)).decode()))
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_repeats_of_fifty_words(make, rows, odd, monkeypatch, small):
    if small:
        monkeypatch.setattr(repeats, "PIECE", 4)
        monkeypatch.setattr(repeats, "SHARD", 2000)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abé"), rng.integers(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    # passages of short words: 51 of them are far fewer than 400 bytes
    passages = [text(51), text(60), text(50), text(49), text(130)]
    space = lambda ws: "".join(w + str(rng.choice([" ", "  ", "\n", "\t "])) for w in ws)
    docs = []
    for i in range(40):
        p = passages[i % 5]
        part = p if i % 3 else p[:int(rng.integers(40, len(p) + 1))]
        docs.append((i, space(text(int(rng.integers(0, 80))) + part + text(int(rng.integers(0, 80)))), "en", "a"))
    docs += [(200, " ".join(["so"] * 300), "en", "a"), (201, space(passages[1]), "en", "a"), (201, space(passages[1]), "en", "a")] + odd
    got = rows(repeats.strip(make(docs), by_words=True))
    assert Counter((r["doc_id"], r["text"]) for r in got) == plain_word_removal(docs)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert repeats.strip(make([]), by_words=True).count() == 0
