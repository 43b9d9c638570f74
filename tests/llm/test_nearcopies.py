"""The pipeline's near copies: SimHash links count, whatever the shingle sets say, and similar sets beyond its radius."""

import random

import corpus_pipeline
from wattloom.llm import simhash


def test_fingerprints_link_texts_of_different_shingle_sets(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    tail = lambda: " ".join(word() for _ in range(9))
    other = [" ".join(word() for _ in range(80)) for _ in range(20)]
    docs = [(i, "alpha beta gamma " * 40 + tail()) for i in range(4)] + [(10 + i, t) for i, t in enumerate(other)]
    docs += [(50, other[0]), (51, other[1].replace(other[1].split()[40], "changed"))]
    docs += [(60, None), (61, " "), (62, "one")]
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in docs}
    assert all((prints[0] ^ prints[i]).bit_count() <= 2 for i in range(4))
    frame = spark.createDataFrame([(i, t, "en", "s", None) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert out.columns == frame.columns
    assert sorted(x.doc_id for x in out.collect()) == [0, *range(10, 30), 60, 62]
