"""Conversation structure repair by depth-first branch-and-bound.

The turns of a conversation should read as an optional system turn, then pairs of a user and an
assistant turn. Blank and repeated turns have to go; a turn may change its role, and turns without text may be put in.
``best`` searches the cheapest edits of one stretch of turns: an explicit stack, lower bounds of the rest, an
incumbent (cost, audit) and, per (place, state), the best prefix so far, which eliminates worse ones; it ends when nothing
on the stack can beat the incumbent. Edits are audited by their initials; equal costs go to the ASCII-least audit.

Spark sorts all turns once by conversation and turn, as ranges that cut a long conversation too, and
stores them; the places in that order number the turns. The search sees codes of turns, in stretches of at most ``STRETCH``.
A conversation of one stretch is searched whole. Of a longer one, each stretch is
searched from every state to every state, and ``chain`` adds these up; texts never meet there. Only the digest of a
repaired conversation, which has to read its lines in order, passes through one task, as a stream.

Defined cases: null roles, texts and turns count as one space where they are shown (a null turn sorts first and
is left out of gaps); a null conv_id is a conversation of its own; rows of equal turn stand by role, then text;
an empty role has no legal place and is changed or deleted; repeated rows are duplicates; a conversation that loses all its
rows gives zeros, an empty audit and the hash of nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import durable

STRETCH_BITS = 10
STRETCH = 1 << STRETCH_BITS
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Where a turn of the only possible role leads, its initial and that role.
NEXT = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: What has to be put in after the last turn, by state.
CLOSE = {0: "", 1: "II", 2: "I", 3: ""}
#: The least cost of turning one state into another between two turns.
TURN = {(s, t): 0 if s == t else INSERT * n for (s, t), n in
        {(0, 0): 0, (1, 1): 0, (2, 2): 0, (3, 3): 0, (0, 2): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1, (3, 2): 1}.items()}
MUST_GO, SHORT = 1, 2
#: More than any edits cost.
NEVER = 1 << 40
BLANK = r"[^\x20\x09-\x0D]"


def bounds(turns: list[tuple[str, int]], goal: int | None = None) -> list[list[int]]:
    """A lower bound, by state, of the cost of turns i, i+1, ... for every i, from a relaxed conversation.

    There the state after the system turn counts as one after an assistant turn, so it may end, and audits do
    not matter; three states are left, and one pass from the end adds up their cheapest edits.
    """
    # nothing yet, a user turn stands open, a pair is complete
    after = [0, INSERT, 0] if goal is None else [0 if s == (0, 2, 1, 2)[goal] else NEVER for s in range(3)]
    move = {(0, "s"): 2, (0, "u"): 1, (1, "a"): 2, (2, "u"): 1}
    turn = (1, 2, 1)
    out = [[after[0], after[2], after[1], after[2]]]
    for initial, fault in reversed(turns):
        now = []
        for s in range(3):
            cost = after[s] + DELETE
            if fault != MUST_GO:
                extra = TRUNCATED if fault == SHORT else 0
                for at, spent in ((s, 0), (turn[s], INSERT)):
                    cost = min(cost, spent + extra + REROLE + after[turn[at]])
                    if (at, initial) in move:
                        cost = min(cost, spent + extra + KEEP + after[move[at, initial]])
            now.append(cost)
        after = now
        out.append([after[0], after[2], after[1], after[2]])
    return out[::-1]


def best(turns: list[tuple[str, int]], start: int = 0, goal: int | None = None) -> tuple[int, str] | None:
    """Cheapest (cost, audit) of ``turns`` (initial, fault) from a state to ``goal``; None: to a legal end, which may be put in."""
    n = len(turns)
    rest = bounds(turns, goal)
    incumbent: tuple[int, str] | None = None
    seen: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack: list[tuple[int, int, int, str]] = [(0, start, 0, "")]

    def worse(i: int, state: int, cost: int, audit: str) -> bool:
        if incumbent is not None and (cost + rest[i][state], audit) > incumbent:
            return True
        for other, mark in seen[i].items():
            way = TURN.get((other, state))
            if way is not None and (cost > mark[0] + way or (way == 0 and (cost, audit) > mark)):
                return True
        return False

    while stack:
        i, state, cost, audit = stack.pop()
        if rest[i][state] >= NEVER or worse(i, state, cost, audit):
            continue
        mark = seen[i].get(state)
        if mark == (cost, audit):
            continue
        seen[i][state] = (cost, audit)
        if i == n:
            if goal is None:
                done = (cost + INSERT * len(CLOSE[state]), audit + CLOSE[state])
            elif goal == state:
                done = (cost, audit)
            else:
                continue
            incumbent = done if incumbent is None else min(incumbent, done)
            continue
        initial, fault = turns[i]
        children = [(i + 1, state, cost + DELETE, audit + "D")]
        if fault != MUST_GO:
            extra = TRUNCATED if fault == SHORT else 0
            at, spent, line = state, cost, audit
            for _ in range(2):                  # as it stands, or after one turn put in
                if (at, initial) in STEP:
                    children.append((i + 1, STEP[at, initial], spent + extra + KEEP, line + "K"))
                children.append((i + 1, NEXT[at][0], spent + extra + REROLE, line + "R"))
                at, spent, line = NEXT[at][0], spent + INSERT, line + "I"
        # the most promising child is searched first: least bound, then least audit
        children.sort(key=lambda c: (c[2] + rest[c[0]][c[1]], c[3]), reverse=True)
        stack.extend(children)
    return incumbent


def chain(stretches: list[list[dict]]) -> tuple[int, str]:
    """Cheapest edits of a conversation from the (start, end, cost, audit) of its stretches, in order.

    Of the audits that lead to the states only their mutual order is kept while adding up.
    """
    at: dict[int, tuple[int, int, tuple | None]] = {0: (0, 0, None)}
    for ways in stretches:
        found: dict[int, tuple[tuple[int, int, str], tuple | None]] = {}
        for w in ways:
            if w["start"] in at:
                cost, place, line = at[w["start"]]
                key = (cost + w["cost"], place, w["audit"])
                if w["end"] not in found or key < found[w["end"]][0]:
                    found[w["end"]] = (key, (line, w["audit"]))
        order = sorted(found, key=lambda s: found[s][0][1:])
        at = {s: (found[s][0][0], order.index(s), found[s][1]) for s in found}
    state = min(at, key=lambda s: (at[s][0] + INSERT * len(CLOSE[s]), at[s][1]))
    cost, _, line = at[state]
    parts = [CLOSE[state]]
    while line:
        line, part = line
        parts.append(part)
    return cost + INSERT * len(CLOSE[state]), "".join(reversed(parts))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, as a function of conv_id and turn: conv_id, turn, role, text, sorted and numbered by ``at``."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))

    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    rows = rows.withColumn("kind", kind).filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("once")).drop("once")
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """All turns in one order, stored; ``at`` grows within a conversation, and along a run of neighbours by one."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return durable(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))


def faulty(turns: DataFrame) -> DataFrame:
    """Narrow rows of numbered turns: conv_id, turn, at, initial, fault (blank, duplicate, truncated or null)."""
    print_ = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    first = turns.groupBy("conv_id", print_.alias("print")).agg(F.min("at").alias("first")).select(F.col("first").alias("at"), F.lit(True).alias("new"))
    narrow = turns.select("conv_id", "turn", "at", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(BLANK)).alias("blank"),
                          (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("cut"), "truncated")
    # "at" is a key of either side: no key is hot here
    return durable(narrow.join(first, "at", "left").select("conv_id", "turn", "at", "initial", fault.alias("fault")))


WAYS = "array<struct<start:int,end:int,cost:int,audit:string>>"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = {"blank": MUST_GO, "duplicate": MUST_GO, "truncated": SHORT, None: 0}
    for batch in batches:
        ways = []
        for turns, only in zip(batch.column("turns").to_pylist(), batch.column("only").to_pylist()):
            turns = [(t["initial"], code[t["fault"]]) for t in turns]
            if only:
                cost, audit = best(turns)
                ways.append([{"start": 0, "end": 0, "cost": cost, "audit": audit}])
            else:
                found = ((s, t, best(turns, s, t)) for s in range(4) for t in range(4))
                ways.append([{"start": s, "end": t, "cost": x[0], "audit": x[1]} for s, t, x in found if x])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int32()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("stretch"), batch.column("only"), pa.array(ways, kind)],
                                         names=["conv_id", "stretch", "only", "ways"])


def audits(marked: DataFrame) -> DataFrame:
    """conv_id, cost, audit of each conversation of ``faulty`` rows."""
    conv = marked.schema["conv_id"].dataType.simpleString()
    cut = marked.withColumn("stretch", F.shiftright("at", STRETCH_BITS))
    grouped = cut.groupBy("conv_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("at", "initial", "fault"))).alias("turns"))
    # both sides are stored, so that Spark can split the join where a conversation has many stretches
    grouped = durable(grouped)
    count = durable(grouped.groupBy("conv_id").agg((F.count(F.lit(1)) == 1).alias("only")))
    ways = durable(grouped.join(count, grouped["conv_id"].eqNullSafe(count["conv_id"])).select(
        grouped["conv_id"], "stretch", "only", "turns").mapInArrow(_search, f"conv_id {conv}, stretch long, only boolean, ways {WAYS}"))
    whole = ways.filter("only").select("conv_id", F.col("ways")[0]["cost"].cast("long").alias("cost"), F.col("ways")[0]["audit"].alias("audit"))

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("stretch")
        cost, audit = chain(table.column("ways").to_pylist())
        return pa.table({"conv_id": table.column("conv_id").slice(0, 1).combine_chunks(), "cost": pa.array([cost], pa.int64()), "audit": [audit]})
    long = ways.filter("not only").groupBy("conv_id").applyInArrow(added, f"conv_id {conv}, cost long, audit string")
    return whole.unionByName(long)


def _edited(rows: Iterator[tuple], audit: str) -> Iterator[tuple]:
    """(role, text, edit) of the repaired turns of one conversation from its (role, text) and its audit."""
    state, letters = 0, iter(audit)
    for role, text in rows:
        for edit in letters:
            if edit == "I":
                state, initial = NEXT[state]
                yield ROLE[initial], "", edit
                continue
            if edit == "K":
                state = STEP[state, role[:1]]
                yield role, text, edit
            elif edit == "R":
                state, initial = NEXT[state]
                yield ROLE[initial], text, edit
            break
    for edit in letters:
        state, initial = NEXT[state]
        yield ROLE[initial], "", edit


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, audit, rows) of each run of equal conv_id; ``rows`` has to be used up before the next run."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")))
    source = rows()
    ahead = next(source, None)
    while ahead is not None:
        conv, audit = ahead[0], ahead[3]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                now, ahead = ahead, next(source, None)
                yield now[1], now[2]
        yield conv, audit or "", own()


def _in_order(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Turns by conversation and place; the first one of a conversation carries its audit."""
    first = turns.groupBy("conv_id").agg(F.min("at").alias("at"))
    heads = durable(first.join(found, first["conv_id"].eqNullSafe(found["conv_id"])).select("at", "audit"))
    return turns.join(heads, "at", "left").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "place", "role", "text", "edit"]
    conv_type, out = None, []

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
            (conv_type, pa.int64(), pa.string(), pa.string(), pa.string()))], names=names)

    def typed():
        nonlocal conv_type
        for batch in batches:
            conv_type = batch.column("conv_id").type
            yield batch
    for conv, audit, rows in _conversations(typed()):
        for i, line in enumerate(_edited(rows, audit)):
            out.append((conv, i, *line))
            if len(out) >= 4096:
                yield flushed()
                out.clear()
    if out:
        yield flushed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv_type = None

    def typed():
        nonlocal conv_type
        for batch in batches:
            conv_type = batch.column("conv_id").type
            yield batch

    def watched(rows, tally):
        before = None
        for role, text in rows:
            tally[0] += before is not None and before + role[:1] not in LEGAL
            before = role[:1]
            yield role, text
    out: list[tuple] = []
    for conv, audit, rows in _conversations(typed()):
        tally, digest, lead = [0], hashlib.sha256(), ""
        for role, text, _ in _edited(watched(rows, tally), audit):
            digest.update(f"{lead}{role}:{text}".encode())
            lead = "\n"
        out.append((conv, tally[0], digest.hexdigest()))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (conv_type, pa.int64(), pa.string()))],
                                             names=["conv_id", "illegal", "repaired_sha256"])
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (conv_type, pa.int64(), pa.string()))],
                                         names=["conv_id", "illegal", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I)."""
    turns = numbered(conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                          F.coalesce("text", F.lit(" ")).alias("text")))
    conv = turns.schema["conv_id"].dataType.simpleString()
    return _in_order(turns, audits(faulty(turns))).select("conv_id", "role", "text", "audit").mapInArrow(
        _lines, f"conv_id {conv}, place long, role string, text string, edit string")


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's row of each conversation after its damage."""
    turns = damaged(conversations)
    marked = faulty(turns)
    found = durable(audits(marked))
    conv = turns.schema["conv_id"].dataType.simpleString()
    hashed = _in_order(turns, found).select("conv_id", "role", "text", "audit").mapInArrow(
        _digests, f"conv_id {conv}, illegal long, repaired_sha256 string")

    def count(fault: str):
        return F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    # distinct turns first, so that a long conversation is counted in parts
    spans = marked.groupBy("conv_id", "turn").agg(*[count(f) for f in ("blank", "duplicate", "truncated")]).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    out = conversations.select(F.col("conv_id").alias("id")).distinct()
    for part in (spans, hashed, found):
        out = out.join(part, F.col("id").eqNullSafe(part["conv_id"]), "left").drop("conv_id")
    zero = {c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("id").alias("conv_id"), *[v.alias(c) for c, v in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
