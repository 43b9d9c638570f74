"""The five stages of the pipeline against plain Python, on planted toxic documents, copies and passages."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import level_targets, plain_word_removal
from wattloom.llm import packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(docs):
    """Smallest doc_id of each group of documents whose shingle sets are at least 0.8 alike."""
    root = {i: i for i, *_ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    sets = [(i, shingles(t)) for i, t, *_ in docs]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in root}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 7))) for _ in range(500)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs, labels, toxic = [], [], set()
    passages = [text(55), text(80)]                     # few letters: well under 400 bytes
    for i in range(420):
        words = text(r.randrange(40, 160))
        if i % 6 == 0:
            for at in r.sample(range(len(words)), 6):
                words[at] = "vileword"
            toxic.add(i)
        elif i % 10 == 1:
            at = r.randrange(len(words))
            words[at:at] = passages[i % 20 > 10]
        docs.append((i, " ".join(words), "en", f"s{i % 3}"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, int(i in toxic)))
    for i in range(30):                                 # near and exact copies of clean documents
        base = docs[7 + 6 * i][1].split(" ")
        if i % 3:
            base[r.randrange(len(base))] = "changed"
        docs.append((1000 + i, " ".join(base), "en", "s1"))
    docs += [(2000, None, None, None), (2001, "", "en", "s0"), (2002, " \t\n", "en", "s0"), (2003, "one", "en", "s2"),
             (2004, " ".join(text(6000)), "en", "s2"), (2005, "Über Maß", "de", "s2")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame = spark.createDataFrame([(*d, None if d[1] is None else len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages, last = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, last, folder).write.parquet(f"{folder}/{name}")
        last = spark.read.parquet(f"{folder}/{name}")
        stages[name] = last
    return folder, docs, toxic, {n: [tuple(x[c] for c in COLUMNS) for x in s.collect()] if n != "packing" else s.collect() for n, s in stages.items()}, stages


def test_toxic_documents_go_and_clean_ones_stay(corpus):
    _, docs, toxic, out, _ = corpus
    kept, clean = Counter(x[:4] for x in out["toxicity"]), Counter(d for d in docs if "vileword" not in (d[1] or ""))
    assert not kept - clean and (clean - kept).total() <= 0.02 * clean.total()


def test_one_of_each_group_of_near_copies_stays(corpus):
    *_, out, _ = corpus
    assert {x[0] for x in out["simhash"]} == groups(out["toxicity"]) and len(out["simhash"]) < len(out["toxicity"])
    assert set(out["simhash"]) <= set(out["toxicity"])


def test_repeated_passages_go(corpus):
    *_, out, _ = corpus
    assert Counter((x[0], x[1]) for x in out["suffix_dedup"]) == plain_word_removal([x[:4] for x in out["simhash"]])
    assert sum(len(x[1]) for x in out["suffix_dedup"]) < sum(len(x[1] or "") for x in out["simhash"])
    assert all(x[4] == len(x[1]) for x in out["suffix_dedup"])


def test_sources_come_near_their_targets(corpus):
    *_, out, _ = corpus
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for x in out["suffix_dedup"]:
        sizes[x[3]] += words(x[1])
        largest[x[3]] = max(largest[x[3]], words(x[1]))
    for x in out["mixing"]:
        taken[x[3]] += words(x[1])
    for s, want in level_targets(sizes).items():
        assert abs(taken[s] - want) <= 2 * largest[s] + 1
    assert set(out["mixing"]) <= set(out["suffix_dedup"]) and max(Counter(x[0] for x in out["mixing"]).values()) <= 2


def test_packed_pieces_hold_every_token(corpus):
    import public_tokenizers
    from tokenizers import Tokenizer
    *_, out, _ = corpus
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got, places = Counter(), Counter(), defaultdict(list)
    for x in out["mixing"]:
        want[x[0]] += len(exact.encode(x[1] or "", add_special_tokens=False).ids) + 1
    for p in out["packing"]:
        got[p["doc_id"]] += p["length"]
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024


def test_run_is_all_stages(spark, corpus):
    folder, *_, out, stages = corpus
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == stages["packing"].columns
    assert Counter((x["doc_id"], x["piece"], x["length"], x["ids_crc32"]) for x in rows.collect()) == Counter(
        (x["doc_id"], x["piece"], x["length"], x["ids_crc32"]) for x in out["packing"])
    for name in list(stages)[:-1]:
        assert stages[name].columns == COLUMNS


def test_nothing_comes_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_a_worker_gets_little_text_at_once(spark, corpus, stage):
    folder, docs, *_ = corpus
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    try:
        stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        long = spark.range(0, 6000, 1, 1).select(F.expr("repeat('abcdefgh', 256)").alias("text"))
        got = [x["n"] for x in long.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(got) >= 6000 * 2048 and max(got) <= corpus_pipeline.BATCH_BYTES + 4096


def test_the_exact_tokenizer_is_held_only_where_a_text_asks_for_it():
    packing.exact_encoder.cache_clear()
    packing.token_ids("one two")
    assert not packing.exact_encoder.cache_info().currsize
    packing.token_ids(f"one {packing.SPECIAL} two")
    assert packing.exact_encoder.cache_info().currsize == 1
