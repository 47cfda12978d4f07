"""Conversation repair against the cheapest and least path over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from orientlake.llm import conversations
from orientlake.llm.queries import QUERIES, damaged_turns, table

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    """rows of (turn, role, text) in order; Dijkstra over (cost, letters), which settles a state by its cheapest and least letters."""
    said, faults = set(), []
    for _, role, text in rows:
        last = text.strip(BLANK)[-1:]
        faults.append("b" if not last else "d" if (role, text) in said else "-" if last in ".!?" else "t")
        said.add((role, text))
    heap, done = [(0, "", 0, "^", ())], set()
    while heap:
        cost, letters, at, end, out = heapq.heappop(heap)
        if (at, end) in done:
            continue
        done.add((at, end))
        if at == len(rows) and end in "^a":
            break
        speaker = "assistant" if end == "u" else "user"
        heapq.heappush(heap, (cost + 3, letters + "I", at, speaker[0], (*out, f"{speaker}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, letters + "D", at + 1, end, out))
            if faults[at] in "-t":
                more = 3 * (faults[at] == "t")
                heapq.heappush(heap, (cost + 3 + more, letters + "R", at + 1, speaker[0], (*out, f"{speaker}:{text}")))
                if (end, role[:1]) in {("^", "s"), ("^", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    heapq.heappush(heap, (cost + more, letters + "K", at + 1, role[:1], (*out, f"{role}:{text}")))
    turns = sorted({t for t, _, _ in rows if t is not None})
    return ((turns[-1] - turns[0] + 1 - len(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def told(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest")) for r in df.collect()}


def conversation(rnd, n):
    out = []
    for i in range(n):
        role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]) if rnd.random() < 0.4 else ("user", "assistant")[i % 2]
        text = rnd.choice(["", " \n", "Yes.", "cut short", "Ends well!", "Ends. \t", f"turn {i}.", f"turn {i}", f"turn {i}?"])
        out.append((i + (i > 3) * 2, role, text))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_the_cheapest_and_least_letters(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        rows = conversation(rnd, rnd.randint(1, 9))
        want = brute(rows)
        said, faults = set(), ""
        for _, role, text in rows:
            last = text.strip(BLANK)[-1:]
            faults += "b" if not last else "d" if (role, text) in said else "-" if last in ".!?" else "t"
            said.add((role, text))
        search = conversations.EditSearch("".join(r[:1] if r[:1] in tuple("sua") else "x" for _, r, _ in rows), faults, conversations.CLOSING)
        letters, cost = search.best(conversations.START)
        end = search.end_of(conversations.START, letters)
        assert (cost, letters + "I" * (conversations.CLOSING[end] // 3)) == (want[5], want[6])


def test_repair_equals_brute_force(spark):
    rnd = random.Random(5)
    talks = {k: conversation(rnd, rnd.randint(1, 12)) for k in range(60)}
    talks[None] = conversation(rnd, 5)
    talks[1000] = conversation(rnd, 3000)  # a third of all rows and more, cut into segments
    talks[1001] = [(i, "system", f"say {i}.") for i in range(150)] + [(200 + i, "tool", "") for i in range(80)]
    talks[1002] = [(i, "user", "") for i in range(70)]
    rows = [(k, *r) for k, talk in talks.items() for r in talk]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({c: F.lit("?") for c in ("place", "seg", "letters", "fault", "_key", "_text", "state", "given", "v", "block")})
    plan = conversations.plan_repair(df)
    assert told(conversations.repair_report(plan)) == {k: brute(talk) for k, talk in talks.items()}
    lines: dict = {}
    for r in sorted(conversations.repaired_turns(plan).collect(), key=lambda r: (r["place"], r["step"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for k, talk in talks.items():
        assert hashlib.sha256("\n".join(lines.get(k, [])).encode()).hexdigest() == brute(talk)[7]


def test_repair_edges(spark):
    shape = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, None, "user", "One."), (1, None, None, None), (1, 3, "assistant", "x" * 300_000), (2, None, None, "Yes."), (3, 5, "user", "Same."), (3, 5, "user", "Same."),
            (None, 1, "user", None), (4, 7, "assistant", "A b."), (4, 2, "user", "Q?")]
    got = told(conversations.repair_report(conversations.plan_repair(spark.createDataFrame(rows, shape))))
    want = {1: [(None, " ", " "), (None, "user", "One."), (3, "assistant", "x" * 300_000)], 2: [(None, " ", "Yes.")], 3: [(5, "user", "Same.")] * 2,
            None: [(1, "user", " ")], 4: [(2, "user", "Q?"), (7, "assistant", "A b.")]}
    assert got == {k: brute(v) for k, v in want.items()}
    assert got[None][5:] == (4, "D", hashlib.sha256(b"").hexdigest()) and got[4][:7] == (4, 0, 0, 0, 0, 0, "KK")
    none = conversations.plan_repair(spark.createDataFrame([], shape))
    assert none.collect() == [] and conversations.repair_report(none).collect() == [] and conversations.repaired_turns(none).collect() == []


def test_query_damages_and_repairs_every_conversation(spark):
    talks: dict = {}
    for r in table(spark, SF, "conversations").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    want = {}
    for k, talk in talks.items():
        rows = []
        for turn, role, text in sorted(talk):
            kind = zlib.crc32(f"{k}:{turn}".encode()) % 20
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        want[k] = brute(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert got == want
    assert damaged_turns(spark.createDataFrame([(None, None, None, None)], "conv_id bigint, turn bigint, role string, text string")).count() == (zlib.crc32(b" : ") % 20 != 0)
