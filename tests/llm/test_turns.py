"""Conversation repair against brute force, and its defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from wattloom.llm import turns

FORM = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, at int, fault string, audit string"
EMPTY = hashlib.sha256(b"").hexdigest()


def every_edit(rows):
    """(cost, audit, roles) of all edits that give a legal conversation, with up to one turn put in before each row and three at the end."""
    plans = []

    def step(i, cost, audit, initials):
        if i == len(rows):
            for k in range(4):
                for tail in product("ua", repeat=k):
                    if FORM.fullmatch(initials + "".join(tail)):
                        plans.append((cost + 2 * k, audit + "I" * k))
            return
        initial, fault = rows[i]
        for put in ("", "u", "a"):
            c, a, s = cost + 2 * len(put), audit + "I" * len(put), initials + put
            step(i + 1, c + 3, a + "D", s)
            if fault != turns.MUST_GO:
                extra = fault == turns.SHORT
                step(i + 1, c + extra, a + "K", s + initial)
                for role in "ua":
                    step(i + 1, c + extra + 2, a + "R", s + role)
    step(0, 0, "", "")
    return min(plans)


def table(rows):
    """The same by a table over states, for longer conversations."""
    at = {0: (0, "")}
    for initial, fault in rows:
        ways = [(s, c, a) for s, (c, a) in at.items()]
        for s, c, a in list(ways):
            one = turns.NEXT[s][0]
            ways += [(one, c + 2, a + "I"), (turns.NEXT[one][0], c + 4, a + "II")]
        new = {}
        for s, c, a in ways:
            options = [(s, c + 3, a + "D")]
            if fault != turns.MUST_GO:
                e = fault == turns.SHORT
                options.append((turns.NEXT[s][0], c + e + 2, a + "R"))
                if (s, initial) in turns.STEP:
                    options.append((turns.STEP[s, initial], c + e, a + "K"))
            for t, c2, a2 in options:
                new[t] = min(new.get(t, (c2, a2)), (c2, a2))
        at = new
    return min((c + 2 * len(turns.CLOSE[s]), a + turns.CLOSE[s]) for s, (c, a) in at.items())


def some_rows(r, n):
    return [(r.choice("suauauauax"), r.choice([0, 0, 0, 1, 2])) for _ in range(n)]


def test_search_equals_all_edits():
    r = random.Random(1)
    for _ in range(150):
        rows = some_rows(r, r.randrange(0, 4))
        assert turns.best(rows) == every_edit(rows) == table(rows), rows


def test_search_and_chain_equal_the_table():
    r = random.Random(2)
    for _ in range(600):
        rows = some_rows(r, r.randrange(0, 30))
        assert turns.best(rows) == table(rows), rows
        parts = [rows[i:i + 4] for i in range(0, len(rows), 4)]
        ways = [[{"start": s, "end": t, "cost": x[0], "audit": x[1]} for s in range(4) for t in range(4) if (x := turns.best(p, s, t))] for p in parts]
        assert turns.chain(ways) == table(rows), rows


def test_bounds_never_exceed_the_cost():
    r = random.Random(3)
    for _ in range(300):
        rows = some_rows(r, r.randrange(0, 12))
        low = turns.bounds(rows)
        for s in range(4):
            assert low[0][s] <= turns.best(rows, s)[0]


@pytest.mark.parametrize("mix", ["ua", "s", "suax"])
def test_a_full_stretch_is_searched(mix):
    r = random.Random(4)
    rows = [(r.choice(mix), r.choice([0, 0, 1, 2])) for _ in range(turns.STRETCH)]
    assert turns.best(rows) == table(rows)


def expected(rows):
    """The contract's digest in plain Python."""
    shown = lambda x: " " if x is None else str(x)
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = convs[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2].encode()))
        ts = [t for t, _, _ in kept if t is not None]
        faults, seen = [], set()
        for _, role, text in kept:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        code = {"blank": 1, "duplicate": 1, "truncated": 2, None: 0}
        cost, audit = table([(r[:1], code[f]) for (_, r, _), f in zip(kept, faults)])
        lines, initials, source = [], "", iter(kept)
        for edit in audit:
            want = "a" if initials.endswith("u") else "u"
            if edit == "I":
                lines.append(f"{turns.ROLE[want]}:")
            else:
                _, role, text = next(source)
                if edit == "D":
                    continue
                lines.append(f"{role}:{text}" if edit == "K" else f"{turns.ROLE[want]}:{text}")
            initials += lines[-1][0]
        assert FORM.fullmatch(initials)
        heads = "".join(r[:1] for _, r, _ in kept)
        out[conv] = {"conv_id": conv, "gaps": max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0,
                     **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
                     "illegal": sum(heads[i:i + 2] not in turns.LEGAL for i in range(len(heads) - 1)),
                     "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "f", "a") for x in rows], SCHEMA)


def made(r, convs, length):
    roles, texts = ["user", "assistant", "system", "tool"], ["Fine.", "why", "Yes!  ", "", " \t", "Is it so?\n", "é.", None]
    return [(c, t, r.choice(roles + ["user", "assistant"] * 3 + [None]), r.choice(texts + [f"text {t}."] * 8))
            for c in range(convs) for t in range(r.randrange(1, length))]


def check(out, want):
    assert len(out) == len(want)
    for x in out:
        assert x == want[x["conv_id"]]


def test_digest_equals_brute_force(spark, rows):
    r = random.Random(7)
    data = made(r, 120, 14) + [(None, t, "user", f"t{t}.") for t in range(5)] + [(500, None, "assistant", "A."), (500, None, "user", "B."), (500, 3, "user", "C")]
    data += [(501, t, "user", "same.") for t in range(40)] + [(502, 1, "user", "x."), (502, 1, "user", "x."), (503, 9, None, None)]
    lost = next(i for i in range(10_000, 11_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    data.append((lost, 0, "user", "gone."))
    out = rows(turns.digest(frame(spark, data)))
    want = expected(data)
    want[lost] = {"conv_id": lost, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": EMPTY}
    check(out, want)


def test_long_conversations_are_cut(spark, rows, monkeypatch):
    monkeypatch.setattr(turns, "STRETCH_BITS", 3)
    r = random.Random(8)
    data = made(r, 4, 200) + [(99, t, "assistant", "y." * 40_000) for t in range(4)]
    check(rows(turns.digest(frame(spark, data))), expected(data))


def test_given_tables_in_full(spark, sf, rows):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    check(rows(turns.digest(given)), expected([tuple(x) for x in given.select("conv_id", "turn", "role", "text").collect()]))


def test_repair_gives_legal_turns(spark, rows):
    data = made(random.Random(9), 60, 12)
    out = rows(turns.repair(frame(spark, data)).orderBy("conv_id", "place"))
    by = defaultdict(list)
    for x in out:
        assert x["place"] == len(by[x["conv_id"]])
        by[x["conv_id"]].append(x)
    for lines in by.values():
        assert FORM.fullmatch("".join(x["role"][:1] for x in lines))
        kept = [(x["role"], x["text"]) for x in lines if x["edit"] == "K"]
        assert len(kept) == len(set(kept)) and all(t.strip(" \t\n") for _, t in kept)


def test_no_rows(spark):
    assert turns.digest(frame(spark, [])).count() == 0 and turns.repair(frame(spark, [])).count() == 0
    assert turns.digest(frame(spark, []).withColumn("conv_id", F.col("conv_id").cast("string"))).count() == 0
