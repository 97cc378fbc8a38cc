"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meterlens.llm import conversations as C
from meterlens.llm.queries import repaired_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, must go, cut off): all edits of each row are tried
    from the back, and whole audits are compared."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {s: (cost, audit) for s, cost, audit in (("", 0, ""), ("a", 0, ""), ("u", 3, "I"), ("s", 6, "II"))}
    for role, _, gone, cut in reversed(rows):
        before = {}
        for state in follows:
            ways = [(4 + best[state][0], "D" + best[state][1])]
            at, price, made = state, 0, ""
            for _ in range(4):
                if not gone:
                    more = 3 * cut
                    initial = role[:1]
                    if initial and initial in follows[at]:
                        ways.append((price + more + best[initial][0], made + "K" + best[initial][1]))
                    for to in follows[at].replace("s", ""):
                        ways.append((price + 3 + more + best[to][0], made + "R" + best[to][1]))
                ways.append((price + 4 + best[at][0], made + "D" + best[at][1]))
                at, price, made = follows[at][-1], price + 3, made + "I"
            before[state] = min(ways)
        best = before
    cost, audit = best[""]
    lines, state, n = [], "", 0
    for edit in audit:
        role, text = (rows[n][0], rows[n][1]) if edit != "I" else ("", "")
        n += edit != "I"
        if edit == "K":
            state = role[:1]
            lines.append(f"{role}:{text}")
        elif edit in "IR":
            state = follows[state][-1]
            lines.append(f"{NAMES[state]}:{text}")
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute(rows):
    """The result of rows (conv, turn, role, text)."""
    grouped = defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv, found in grouped.items():
        key = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(r)))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in found:
            bare = text.rstrip(" \t\n\r\x0b\x0c")
            faults = [not bare, (role, text) in seen, bare and bare[-1] not in ".!?"]
            first = next((n for n, f in enumerate(faults) if f), None)
            if first is not None:
                counts[first] += 1
            marked.append((role, text, first in (0, 1), first == 2))
            seen.add((role, text))
        turns = {r[0] for r in found} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:], strict=False)]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        cost, audit, digest = cheapest(marked)
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def generated(seed, conversations=60, hot=400):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and so", " \n", "", "Fine. ", "Über?", "文", None, "x.", "y."]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randrange(1, 9) if conv != 7 else hot):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            own = rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}."
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, own))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


def found(spark, rows, **options):
    made = C.Conversations(spark.createDataFrame(rows, SCHEMA), **options).result().collect()
    assert len(made) == len({r.conv for r in made})
    return {r.conv: tuple(r[c] for c in C.RESULT) for r in made}


@pytest.mark.parametrize(
    "options", [{}, {"held_rows": 1, "segment_rows": 1}, {"held_rows": 3, "segment_rows": 7}]
)
def test_equals_the_search_over_all_edits(spark, options):
    rows = generated(len(options) + 1)
    assert found(spark, rows, **options) == brute(rows)


def test_runs_of_any_length():
    rng = random.Random(5)
    for _ in range(300):
        symbols = []
        for _ in range(rng.randrange(0, 5)):
            symbols += [rng.randrange(9)] * rng.choice([1, 1, 2, 3, 8, 21])
        rows = [
            ("xsua"[(s - 1) // 2] if s else "u", "t", s == 0, s > 0 and (s - 1) % 2 == 1) for s in symbols
        ]
        cost, edits = C.repair(symbols)
        assert (cost, "".join(edits)) == cheapest(rows)[:2]


def test_powers_are_products_of_one_row():
    steps = C.steps()
    for sym in range(9):
        matrix = steps.matrix([(sym, 1)])
        for _ in range(12):
            matrix = C.times(matrix, steps.matrix([(sym, 1)]))
        assert (matrix == steps.matrix([(sym, 13)])).all()


def test_a_hot_conversation_is_cut_into_segments(spark):
    rows = [(1, n % 3000, ("user", "assistant")[n % 2], f"{n % 2500}.") for n in range(4000)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    made = C.Conversations(table, held_rows=50, segment_rows=100)
    segments = made.pieces.groupBy("conv").count().collect()
    assert segments[0]["count"] >= 40
    got = {r.conv: tuple(r[c] for c in C.RESULT) for r in made.result().collect()}
    assert got == brute(rows)


def test_empty_extra_columns_and_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.Conversations(empty).result().count() == 0
    rows = [("a", 1, "user", "Hi.", 5, "x"), ("a", 2, "assistant", "Yes.", 6, "y")]
    odd = spark.createDataFrame(rows, "c string, t int, who string, what string, part int, key string")
    got = C.Conversations(odd, "c", "t", "who", "what").result().collect()
    assert [(r.conv, r.audit, r.cost) for r in got] == [("a", "KK", 0)]
    long = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000 + ".")], SCHEMA)
    assert C.Conversations(long).result().first().audit == "KI"


def harmed(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        place = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(place.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_query(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    given = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    more = [(None, None, None, None), (None, 3, "user", "So."), *[(10**6 + n, 0, "user", "A.") for n in range(60)]]
    both = spark.createDataFrame(given + more, SCHEMA)
    both.write.parquet(f"{tmp_path}/conversations.parquet")
    got = repaired_conversations(spark, str(tmp_path)).collect()
    want = brute(harmed(given + more))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r.conv_id for r in got} == {r[0] for r in given + more} and len(got) == len({r.conv_id for r in got})
    names = [*C.RESULT[:-1], "repaired_sha256"]
    assert {r.conv_id: tuple(r[c] for c in names) for r in got} == {
        r.conv_id: want.get(r.conv_id, nothing) for r in got
    }
    assert any(c not in want for c in (r.conv_id for r in got))
    assert both.where(F.col("conv_id").isNull()).count() == 2
