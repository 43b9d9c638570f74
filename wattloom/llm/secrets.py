"""Secrets in texts: fixed patterns, and windows of high Shannon entropy.

Three patterns give the base spans. Beside them every maximal run of a character class that is at least
one window long is a candidate: a window slides over it, the counts of its characters are kept as an array in which
one step changes two entries, and the sum of c log2 c follows from those two. Windows whose entropy reaches the
class's bound are united to spans of kind ``ent_...``, unless the run is on the allow list (words, slugs,
numbers, UUIDs, placeholders, counting sequences). Logarithms are integers in millionths, so that
sums are exact in any order. Everything is one projection of DataFrame functions: no shuffle, no Python.

Spans are counted in code points, the end is exclusive. Defined cases: a null text is empty; an empty text has no
spans; repeated rows are scanned one by one; texts are scanned whole, whatever their length; an empty
table gives an empty result; further columns are ignored by ``digest`` and kept by ``scan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, group whose length counts (0: the match), least length.
BASE = (("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24))
#: Runs of these lengths only, where the match is a maximal run anyway: the same spans, found faster.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: kind, class in a pattern, its characters, window, least bits per character.
CLASSES = (("ent_hex", "0-9a-f", DIGITS + "abcdef", 16, 2.9),
           ("ent_upper", "A-Z0-9", DIGITS + UPPER, 20, 3.55),
           ("ent_mixed", "A-Za-z0-9+/_-", DIGITS + UPPER + LOWER + "+/_-", 20, 3.75))
KINDS = tuple(b[0] for b in BASE) + tuple(c[0] for c in CLASSES)
#: Candidate runs that no one keeps secret.
ALLOWED = (r"^[A-Z]?[a-z]+$|^[A-Z]+$|^[0-9]+$"                                   # a word, a number
           r"|^[A-Z]?[a-z]+([+/_-][A-Za-z]?[a-z]*)+$|^[A-Z]+([+/_-][A-Z]*)+$"    # words joined to a slug or a path
           r"|^[0-9]+([+/_-][0-9]+)+$"                                           # dates, telephone numbers
           r"|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"              # an identifier
           r"|(?i:example|sample|placeholder|dummy|changeme|redacted|xxxx|0000)"
           r"|(?i:0123456|abcdefg)")
SPAN = "array<struct<start:int,kind:int,end:int>>"


def millionths(c: int) -> int:
    """c log2 c in millionths."""
    return round(c * math.log2(c) * 1e6) if c else 0


def most(window: int, bits: float) -> int:
    """The largest sum of c log2 c that leaves ``bits`` of entropy per character of a window."""
    return math.floor(millionths(window) - window * bits * 1e6)


def located(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """(start, kind, end, match) of the matches whose ``group`` satisfies ``keep``.

    What lies between the matches comes from a split, so that starts are sums of lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    asked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    steps = F.zip_with(F.split(text, pattern, -1), F.arrays_zip(hits.alias("hit"), asked.alias("asked")),
                       lambda gap, m: F.struct(F.length(gap).alias("gap"), m["hit"].alias("hit"), m["asked"].alias("asked")))
    kind_of = "array<struct<start:int,kind:int,end:int,hit:string>>"

    def step(at, x):
        start = at["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        own = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))
        wanted = x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["asked"])
        return F.struct(end.alias("at"), F.when(wanted, F.concat(at["out"], F.array(own))).otherwise(at["out"]).cast(kind_of).alias("out"))
    none = F.array().cast(kind_of)
    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda at: at["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def base(text: Column) -> Column:
    """Spans of the fixed patterns, kind by kind."""
    out = []
    for i, (kind, pattern, group, least) in enumerate(BASE):
        found = located(text, FAST.get(kind, pattern), i, lambda x, n=least: F.length(x) >= n, group)
        out.append(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(SPAN))
    return F.concat(*out)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def windows(run: Column, characters: str, window: int, bits: float) -> Column:
    """Start and end of the united high windows of one run."""
    logs = F.array(*[F.lit(millionths(c)) for c in range(window + 2)])
    spans = "array<struct<a:int,b:int>>"
    limit = most(window, bits)

    def over(at: Column) -> Column:
        def step(s, i):
            new, old = F.get(at, i), F.coalesce(F.get(at, i - window), F.lit(0))
            # an entry counts the characters of the window; the new one comes before the old one goes
            had, left = F.get(s["counts"], new), F.get(s["counts"], old) + (new == old).cast("int")
            total = (s["sum"] + F.get(logs, had + 1) - F.get(logs, had)
                     - F.when(old > 0, F.get(logs, left) - F.get(logs, left - 1)).otherwise(0))
            counts = F.transform(s["counts"], lambda n, j: n + (j == new).cast("int") - ((j == old) & (old > 0)).cast("int"))

            def end(t):
                last = F.get(s["out"], F.size(s["out"]) - 1)
                first = i - (window - 1)
                joined = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.struct(last["a"].alias("a"), (i + 1).alias("b"))))
                opened = F.concat(s["out"], F.array(F.struct(first.alias("a"), (i + 1).alias("b"))))
                out = (F.when((first < 0) | (t > limit), s["out"])
                       .when((F.size(s["out"]) > 0) & (last["b"] >= first), joined).otherwise(opened))
                return F.struct(counts.alias("counts"), t.alias("sum"), out.cast(spans).alias("out"))
            return let(total, end)
        start = F.struct(F.array_repeat(F.lit(0), len(characters) + 1).alias("counts"), F.lit(0).alias("sum"),
                         F.array().cast(spans).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), start, step, lambda s: s["out"])
    return let(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(characters), c)), over)


def high_entropy(text: Column) -> Column:
    """Spans of high windows, class by class, without those of allowed runs."""
    def of(i: int, chars: str, characters: str, window: int, bits: float) -> Column:
        runs = located(text, f"[{chars}]{{{window},}}", len(BASE) + i, lambda x: ~x.rlike(ALLOWED))
        return F.flatten(F.transform(runs, lambda r: F.transform(
            windows(r["hit"], characters, window, bits), lambda w: F.struct(
                (r["start"] + w["a"]).alias("start"), r["kind"].alias("kind"), (r["start"] + w["b"]).alias("end"))))).cast(SPAN)
    return F.concat(*[of(i, *c[1:]) for i, c in enumerate(CLASSES)])


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add the column ``out``: kind, start, end and found text of every span, by start, then kind."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_sort(F.concat(base(body), high_entropy(body)))
    return docs.withColumn(out, F.transform(spans, lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.substring(body, s["start"] + 1, s["end"] - s["start"]).alias("found"))))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    body = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", base(body).alias("base"), high_entropy(body).alias("more"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.concat("base", "more")).alias("spans"))


def _sql() -> str:
    """The same rows in one statement; windows are counted one by one there."""
    def hits(i: int, pattern: str, group: int, keep: str) -> str:
        q = pattern.replace("'", "''")
        return f"""
  select row, {i} kind, start + gap_sum as start, start + gap_sum + length(hit) as "end", hit from (
    select row, unnest(hits) hit, unnest(asked) asked,
           unnest(list_transform(range(1, len(hits) + 1), lambda j: coalesce(list_sum(list_transform(hits[1:j - 1], lambda x: length(x))), 0)))::bigint as start,
           unnest(list_transform(range(1, len(hits) + 1), lambda j: list_sum(list_transform(gaps[1:j], lambda x: length(x)))))::bigint gap_sum
    from (select row, regexp_extract_all(text, '{q}') hits, regexp_extract_all(text, '{q}', {group}) asked,
                 string_split_regex(text, '{q}') gaps
          from d where regexp_matches(text, '{q}'))) where {keep}"""
    parts = [hits(i, p, g, f"length(asked) >= {n}") for i, (_, p, g, n) in enumerate(BASE)]
    allowed = ALLOWED.replace("'", "''")
    runs = [hits(len(BASE) + i, f"[{c}]{{{w},}}", 0, f"not regexp_matches(hit, '{allowed}')")
            for i, (_, c, _, w, _) in enumerate(CLASSES)]
    width = "case kind " + " ".join(f"when {len(BASE) + i} then {c[3]}" for i, c in enumerate(CLASSES)) + " end"
    limit = "case kind " + " ".join(f"when {len(BASE) + i} then {most(c[3], c[4])}" for i, c in enumerate(CLASSES)) + " end"
    logs = "[" + ", ".join(str(millionths(c)) for c in range(max(c[3] for c in CLASSES) + 1)) + "]"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    line = f"string_agg({names}[kind + 1] || ':' || start || ':' || \"end\", ',' order by start, kind, \"end\")"
    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
base as ({" union all ".join(parts)}),
runs as ({" union all ".join(runs)}),
wide as (select *, {width} as w, row_number() over () run from runs),
places as (select *, unnest(range(0, length(hit) - w + 1)) j from wide),
letters as (select run, row, kind, start, w, j, unnest(string_split(substr(hit, j + 1, w), '')) c from places),
counted as (select run, row, kind, start, w, j, c, count(*) n from letters group by all),
high as (select run, row, kind, start, w, j from counted group by all having sum({logs}[n + 1]) <= {limit}),
cuts as (select *, case when j - lag(j) over (partition by run order by j) <= w then 0 else 1 end as cut from high),
isles as (select *, sum(cut) over (partition by run order by j) isle from cuts),
more as (select row, kind, start + min(j) as start, start + max(j) + w as "end" from isles group by run, row, kind, start, w, isle),
b as (select row, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
             {line} as txt from base group by row),
a as (select row, {line} as txt from (select row, kind, start, "end" from base union all select * from more) group by row)
select d.doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
       sha256(coalesce(b.txt, '')) base_sha256, coalesce(a.txt, '') spans
from d left join b using (row) left join a using (row)
"""


ORACLE = _sql()
