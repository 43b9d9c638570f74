"""Secret scan against brute force, and its defined edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

from wattloom.llm import secrets

KEY = "q7XbT2mKz9LwR4vNc8Yp"


def base_spans(text):
    out = []
    for i, (_, pattern, group, least) in enumerate(secrets.BASE):
        out += [(m.start(), i, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return out


def entropy_spans(text):
    out = []
    for i, (_, chars, _, w, bits) in enumerate(secrets.CLASSES):
        for m in re.finditer(f"[{chars}]{{{w},}}", text):
            run = m.group()
            if re.search(secrets.ALLOWED, run):
                continue
            spans = []
            for j in range(len(run) - w + 1):
                n = Counter(run[j:j + w])
                if -sum(c / w * math.log2(c / w) for c in n.values()) >= bits:
                    if spans and spans[-1][1] >= j:
                        spans[-1][1] = j + w
                    else:
                        spans.append([j, j + w])
            out += [(m.start() + a, len(secrets.BASE) + i, m.start() + b) for a, b in spans]
    return out


def line(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def texts():
    r = random.Random(5)
    pool = ["password", "Token", "api_key", "APIKEY", " = ", ":", '"', "'", " ", "\n", "=", "token=token:abcdefgh", "AKIA", "AKIAAKIA" + "Q" * 13,
            "0123456789abcdef" * 2, "d41d8cd98f00b204e980", "é", "😀", KEY, "Z" * 30, "Q7XZ2M9L4R8NC3YPKD5W", "some-long-slug-of-words-here", "user/name/Path/And/More",
            "123e4567-e89b-12d3-a456-426614174000", "EXAMPLE" + KEY, "abcdefghijklmnopqrstuvwxyz", "2024-01-01-12-30-59-00", "x" * 15, ". "]
    out = ["".join(r.choice(pool) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    out += ["".join(r.choice("ABCDEFab01289+/_-") for _ in range(r.randrange(20, 90))) for _ in range(60)]
    # a long run whose middle is dull: two spans
    out += [KEY + "a" * 60 + KEY[::-1]]
    return out


def test_spans_equal_brute_force(make, rows):
    docs = list(enumerate(texts()))
    out = {r["doc_id"]: r for r in rows(secrets.digest(make([(i, t, "en", "a") for i, t in docs])))}
    assert len(out) == len(docs)
    seen = Counter()
    for i, t in docs:
        base, more = base_spans(t), entropy_spans(t)
        seen.update(secrets.KINDS[k] for _, k, _ in base + more)
        assert out[i]["spans"] == line(base + more), t
        assert out[i]["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(k == x for _, k, _ in base) for x in range(3)]
    assert set(seen) == set(secrets.KINDS)


def test_allow_list_spares_no_base_span(make, rows):
    found = rows(secrets.digest(make([(1, "password=" + "example" * 4, "en", "a"), (2, KEY, "en", "a"), (3, f"EXAMPLE{KEY}", "en", "a"),
                                      (4, "a" + KEY + "a" * 60 + KEY[::-1], "en", "a")])))
    by = {r["doc_id"]: r["spans"] for r in found}
    assert by[1] == "assign:0:37" and by[2] == "ent_mixed:0:20" and by[3] == ""
    assert by[4].count("ent_mixed") == 2


def test_scan_gives_the_found_text_and_keeps_columns(make, rows):
    df = make([(1, "é token: s3cretvalue.", "en", "a")])
    out = rows(secrets.scan(df))[0]
    assert [(s["kind"], s["start"], s["end"], s["found"]) for s in out["secrets"]] == [("assign", 2, 21, "token: s3cretvalue.")]
    assert secrets.scan(df).columns == [*df.columns, "secrets"]


def test_odd_rows_and_long_runs(make, rows, odd):
    out = rows(secrets.digest(make(odd)))
    assert len(out) == len(odd)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["spans"], r["base_sha256"]) for r in out if r["doc_id"] in (1, 2, 3, 4)} == {("", empty)}
    r = random.Random(1)
    blob = "".join(r.choice("ABCDEFGHIJabcdefghij0123456789+/") for _ in range(40_000))
    got = rows(secrets.digest(make([(1, blob, "en", "a")])))[0]["spans"]
    assert got == line(base_spans(blob) + entropy_spans(blob))


def test_no_rows(make):
    assert secrets.digest(make([])).count() == 0 and secrets.scan(make([])).count() == 0


def test_plan_is_one_projection(documents, capsys):
    secrets.digest(documents).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Exchange|Python|Arrow|Pandas", plan)
