"""Conversation repair against exhaustive search, SQL and awkward rows."""

import hashlib
import itertools
import random
import re

from heatloom.llm import conversations
from heatloom.llm.conversation_queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits of all rows with up to three inserts at each place."""
    marks = faults(rows)
    options = []
    for (role, text), fault in zip(rows, marks):
        gone, extra = fault in ("blank", "duplicate"), 3 if fault == "truncated" else 0
        own = [(4, "D", [])]
        if not gone:
            own += [(extra, "K", [f"{role}:{text}"])] + [(3 + extra, "R", [f"{r}:{text}"]) for r in ("user", "assistant")]
        options.append(own)
    inserts = [(3 * n, "I" * n, [f"{r}:" for r in rs]) for n in range(4) for rs in itertools.product(("user", "assistant"), repeat=n)]
    steps = [inserts]
    for own in options:
        steps += [own, inserts]
    bound, found = 4 * len(rows), []
    partial = [(0, "", [])]
    for step in steps:
        partial = [(c + c2, a + a2, o + o2) for c, a, o in partial for c2, a2, o2 in step if c + c2 <= bound]
    for c, a, o in partial:
        if LEGAL.match("".join(x[0] if not x.startswith(":") else "" for x in o)) and all(not x.startswith(":") for x in o):
            found.append((c, a, "\n".join(o)))
    return min(found)


def test_least_repair_is_found():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant", ""]), rng.choice(["a.", "b", "c!", " ", "d? \n"]))
                for _ in range(rng.randrange(0, 5))]
        state = conversations.Repair(spill_rows=2)
        for k, ((role, text), fault) in enumerate(zip(rows, faults(rows))):
            state.add(k, role, text, fault)
        got = state.result()
        cost, audit, text = cheapest(rows)
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
        assert got["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)


def test_long_conversation_spills():
    rows = [("user" if k % 2 == 0 else "assistant", f"text {k}.") for k in range(20_001)]
    small, large = conversations.Repair(spill_rows=64), conversations.Repair()
    for k, (role, text) in enumerate(rows):
        small.add(k, role, text, None)
        large.add(k, role, text, None)
    assert small.way.blocks > 300 and len(small.way.rows) < 4 * 64
    got = small.result()
    assert got == large.result()
    assert got["audit"] == "K" * 20_001 + "I" and got["cost"] == 3
    text = "\n".join(f"{r}:{t}" for r, t in rows) + "\nassistant:"
    assert got["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def awkward_conversations():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(-2, 60)]:
        for turn in [None, None, *range(rng.randrange(0, 9))]:
            if rng.random() < 0.2:
                continue
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "", "User", "tool: x", "usher"]),
                         rng.choice([None, "", " \t\n", "x.", "y", "é!\x0b", "z? ", "w" * 30_000 + ".", "a:b", "c. "])))
    rows += [(7, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(400)]
    rows += [(8, -(2**40), "user", "far."), (8, 2**40, "assistant", "away.")]
    return rows + rows[3:30] + rows[3:10]


def test_awkward_rows(spark, both):
    rows = awkward_conversations()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6).selectExpr(
        "*", "text AS key", "1 AS alive", "'c' AS conv", "turn AS again", "role AS fault", "2 AS plan", "text AS name", "1 AS copy")
    got, want = both("op12_conversation_repair", conversations=frame)
    assert got == want and len(got[1]) == len({r[0] for r in rows})


def test_no_rows(spark, both):
    got, want = both("op12_conversation_repair", conversations=spark.createDataFrame([], SCHEMA))
    assert got == want


def test_one_shuffle_and_state_across_batches(spark):
    rows = [(k % 3, k, "user" if k % 2 else "assistant", f"t {k}.") for k in range(900)]
    frame = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = sorted(conversations.repair(frame, spill_rows=16).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = conversations.repair(frame)
    assert small == sorted(out.collect()) and len(small) == 3
    plan = conversations.repair(damaged(frame), alive_col="alive")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
