"""Repair of conversations whose turns are blank, repeated, cut short or out of order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from orientlake.llm.common import Scratch, keep_columns, map_rows
from orientlake.session import shuffle_width

# Fixed values of the repair: costs of the edits and of a cut turn that stays.
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: What has been read so far: nothing, a system turn, ... up to a user turn, ... up to an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Cost of the inserts that close a conversation from each of these.
CLOSING = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40
_SEGMENT_BITS = 5  # 32 turns are searched at a time
_FAN = 64  # segments that are combined at a time
_BLANKS = " \t\n\x0b\x0c\r"


def _next_speaker(state: int) -> int:
    """The only speaker that an inserted turn or a new role can give."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


class EditSearch:
    """Iterative-deepening A* over the edits of one segment of turns.

    ``initials`` has the role's first letter of each turn (anything but s, u
    and a fits nowhere) and ``faults`` one of ``b`` or ``d`` (blank, duplicate:
    must go), ``t`` (cut short) and ``-``. ``ends`` is what remains to be paid
    after the last turn from each state; ``NEVER`` forbids a state.

    Edits are tried in ASCII order of their letters D, I, K, R, so the first
    path within the bound that reaches the end is the least of the cheapest.
    The table holds for (place, state) the least budget that is not known to
    fail; it starts from the costs no edit can avoid, and what one bound has
    shown to fail is not tried again under that budget.
    """

    def __init__(self, initials: str, faults: str, ends: Sequence[int]):
        self.initials, self.faults, self.ends = initials, faults, ends
        # from a user or assistant turn no state before leads back, and only a system turn leads from the start behind one
        spoken, must, low_start = min(ends[USER:]), 0, min(ends[START], *ends[USER:])
        self.need = [list(ends)]
        for initial, fault in zip(reversed(initials), reversed(faults)):
            must += DELETE if fault in "bd" else min(DELETE, (CUT if fault == "t" else 0) + (0 if initial in "sua" else REROLE))
            if initial == "s" and fault not in "bd":
                low_start = min(low_start, ends[SYSTEM])
            self.need.append([must + low_start, must + min(ends[SYSTEM:]), must + spoken, must + spoken])
        self.need.reverse()

    def edits(self, place: int, state: int) -> list[tuple[str, int, int, int]]:
        """(letter, cost, next place, next state) in ASCII order."""
        fault, initial, speaker = self.faults[place], self.initials[place], _next_speaker(state)
        out = [("D", DELETE, place + 1, state), ("I", INSERT, place, speaker)]
        if fault not in "bd":
            extra = CUT if fault == "t" else 0
            kept = _kept(state, initial)
            if kept is not None:
                out.append(("K", extra, place + 1, kept))
            out.append(("R", REROLE + extra, place + 1, speaker))
        return out

    def _within(self, state: int, bound: int) -> str | None:
        """The first path in letter order that costs at most ``bound``."""
        need, n = self.need, len(self.initials)
        if need[0][state] > bound:
            return None
        if n == 0:
            return ""
        # (place, state, budget, edits left to try, least budget seen to be needed); the path holds one letter per step
        stack = [[0, state, bound, iter(self.edits(0, state)), NEVER]]
        path: list[str] = []
        while stack:
            top = stack[-1]
            place, now, budget, left, least = top
            for letter, cost, to, then in left:
                wants = cost + need[to][then]
                if wants > budget:
                    least = min(least, wants)
                    continue
                path.append(letter)
                if to == n:
                    return "".join(path)
                top[4] = least
                stack.append([to, then, budget - cost, iter(self.edits(to, then)), NEVER])
                break
            else:
                need[place][now] = max(need[place][now], least)
                stack.pop()
                if stack:
                    before = stack[-1]
                    path.pop()
                    # what this state needs now counts for the state before it
                    before[4] = min(before[4], before[2] - budget + need[place][now])
        return None

    def best(self, state: int) -> tuple[str, int] | None:
        """Letters and cost (with ``ends``) of the cheapest edits from ``state``, or None if there are none."""
        while self.need[0][state] < NEVER:
            bound = self.need[0][state]
            path = self._within(state, bound)
            if path is not None:
                return path, bound
        return None

    def end_of(self, state: int, path: str) -> int:
        place = 0
        for letter in path:
            _, _, place, state = next(e for e in self.edits(place, state) if e[0] == letter)
        return state


def _crossing(initials: str, faults: str) -> list[int]:
    """Cheapest cost from each state before a segment to each state after it, row by row."""
    out = [NEVER] * 16
    for after in range(4):
        search = EditSearch(initials, faults, [0 if q == after else NEVER for q in range(4)])
        for before in range(4):
            found = search.best(before)
            out[4 * before + after] = found[1] if found else NEVER
    return out


def _joined(one: list[int], two: list[int]) -> list[int]:
    return [min(NEVER, *(one[4 * a + b] + two[4 * b + c] for b in range(4))) for a in range(4) for c in range(4)]


def _all_joined(costs: list[list[int]]) -> list[int]:
    out = costs[0]
    for c in costs[1:]:
        out = _joined(out, c)
    return out


def _rests(costs: list[list[int]], end: list[int]) -> list[list[int]]:
    """What remains after each of the segments in a row, given what remains after the last."""
    out = [end]
    for c in reversed(costs[1:]):
        out.insert(0, [min(NEVER, *(c[4 * a + b] + out[0][b] for b in range(4))) for a in range(4)])
    return out


def _all_passed(ends: list[list[int]]) -> list[int]:
    out = ends[0]
    for e in ends[1:]:
        out = [e[q] if q >= 0 else -1 for q in out]
    return out


def _entries(ends: list[list[int]], start: list[int]) -> list[list[int]]:
    out = [start]
    for e in ends[:-1]:
        out.append([e[out[-1][0]]])
    return out


def _over_segments(scratch: Scratch, leaves: DataFrame, widest: int, joined: Callable, spread: Callable, top: list[int]) -> DataFrame:
    """Values handed down a tree over the numbered segments (``_key``, ``seg``, ``v``) of each conversation, as ``given``.

    Runs of ``_FAN`` neighbours are joined until one is left; ``top`` belongs
    to that one, and ``spread`` gives each member of a run its own share. No
    task sees more than ``_FAN`` members at once.
    """
    kind = leaves.schema["_key"].dataType.simpleString()
    runs, level = [], leaves
    while widest > 1:
        grouped = level.groupBy("_key", F.expr(f"seg div {_FAN}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("seg", "v"))).alias("all"))
        runs.append(scratch.cut(grouped, "runs"))
        level = map_rows(runs[-1].select("_key", "run", F.col("all.v").alias("all")),
                         lambda batches: ({"_key": b["_key"], "seg": b["run"], "v": [joined(a) for a in b["all"]]} for b in batches),
                         f"_key {kind}, seg bigint, v array<bigint>")
        widest = -(-widest // _FAN)
    given = level.select("_key", "seg", F.lit(top).cast("array<bigint>").alias("given"))
    for run in reversed(runs):
        both = run.alias("r").join(given.alias("g"), F.col("r._key").eqNullSafe(F.col("g._key")) & (F.col("r.run") == F.col("g.seg"))).select(
            F.col("r._key").alias("_key"), F.col("all.seg").alias("segs"), F.col("all.v").alias("all"), "given")
        shared = map_rows(both, lambda batches: ({"_key": b["_key"], "segs": b["segs"], "given": [spread(a, g) for a, g in zip(b["all"], b["given"])]} for b in batches),
                          f"_key {kind}, segs array<bigint>, given array<array<bigint>>")
        given = scratch.cut(shared.select("_key", F.explode(F.arrays_zip("segs", "given")).alias("s")).select(
            "_key", F.col("s.segs").alias("seg"), F.col("s.given").alias("given")), "given")
    return given


def _solve(batches):
    """Edits of a segment from each state before it: letters and the state after it."""
    for b in batches:
        out = {"_key": b["_key"], "seg": b["seg"], "letters": [], "v": []}
        for initials, faults, ends, seg in zip(b["initials"], b["faults"], b["given"], b["seg"]):
            search = EditSearch(initials, faults, ends)
            found = [search.best(q) if seg or q == START else None for q in range(4)]
            out["letters"].append([f[0] if f else "" for f in found])
            out["v"].append([search.end_of(q, f[0]) if f else -1 for q, f in enumerate(found)])
        yield out


def _per_turn(batches):
    """One row per turn: inserted speakers before it, its letter, its new role, inserted speakers after it."""
    names = {USER: "user", ASSISTANT: "assistant"}
    for b in batches:
        out = {"place": [], "fault": [], "before": [], "letter": [], "role": [], "after": []}
        for initials, faults, first, letters, state, last in zip(b["initials"], b["faults"], b["first"], b["letters"], b["state"], b["last"]):
            search, at, before = EditSearch(initials, faults, CLOSING), 0, []
            for letter in letters:
                _, _, to, state = next(e for e in search.edits(at, state) if e[0] == letter)
                if letter == "I":
                    before.append(names[state])
                    continue
                out["place"].append(first + at)
                out["fault"].append(faults[at])
                out["before"].append(before)
                out["letter"].append(letter)
                out["role"].append(names[state] if letter == "R" else None)
                out["after"].append([])
                at, before = to, []
            while last and CLOSING[state]:
                state = _next_speaker(state)
                out["after"][-1].append(names[state])
        yield out


def plan_repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                scratch: Scratch | None = None) -> DataFrame:
    """The cheapest edits that make every conversation a system turn at most, then pairs of user and assistant, or nothing.

    General: the particle records hold no conversations. Turns come in the
    order of ``turn`` (nulls first; ties by role, then by a hash of the text,
    then by the text). A null role or text counts as one space, a null key is
    a conversation like any other, repeated rows are turns of their own.

    A turn is *blank* (no character but ASCII white space), a *duplicate* (its
    role and text stood in the conversation before) or *truncated* (its last
    character that is no white space is none of ``.!?``); the first that holds
    counts. Edits: K keeps a turn, R gives it the role user or assistant, D
    deletes it (blank and duplicate turns must go), I inserts an empty turn of
    either. Roles are told by their first letter. Of equally cheap edits the
    ASCII-least letters win.

    Returns one row per turn: the given columns under their names, ``place``
    (its order), ``fault`` (b, d, t or -), ``letter``, ``new_role`` (null unless
    R), and the roles inserted ``before`` and ``after`` it (the latter only at
    the end of a conversation). No rows: an empty result.

    Searched by iterative-deepening A* (``EditSearch``), at most 32 turns at a
    time: a longer conversation is cut into segments, of which first only the
    costs from each state to each state are found and joined over a tree; each
    segment is then searched with what remains to be paid after it. So a
    conversation that holds a third of all rows is still spread; only one
    narrow row per 32 turns is numbered by conversation.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    spark = turns.sparkSession
    rows = keep_columns(turns, key, turn, role, text, where="turns").select(
        F.col(key).alias("_key"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit(" ")).alias("_role"), F.coalesce(text, F.lit(" ")).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    order = [F.col("_key").asc_nulls_first(), F.col("_turn").asc_nulls_first(), F.col("_role").asc(), F.xxhash64("_text").asc()]
    placed = scratch.cut(rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order, "_text").withColumn(
        "place", F.monotonically_increasing_id()), "turns")

    first_said = placed.groupBy("_key", "_role", F.sha2(F.col("_text").cast("binary"), 256).alias("said")).agg(F.min("place").alias("place")).select("place")
    trimmed = F.rtrim("_text", F.lit(_BLANKS))
    fault = F.when(trimmed == "", "b").when(F.col("new").isNull(), "d").when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    initial = F.substring("_role", 1, 1)
    marked = placed.select("_key", "place", initial.alias("_i"), trimmed.alias("_text")).select(
        "_key", "place", F.when(F.col("_i").isin("s", "u", "a"), F.col("_i")).otherwise("x").alias("i"),
        F.when(F.col("_text") == "", "").otherwise(F.substring("_text", -1, 1)).alias("_text")).join(
        first_said.withColumn("new", F.lit(True)), "place", "left").select("_key", "place", "i", fault.alias("f"))
    block = F.shiftright("place", _SEGMENT_BITS)
    segments = marked.groupBy("_key", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "i", "f"))).alias("all")).select(
        "_key", "block", F.col("all")[0]["place"].alias("first"), F.array_join("all.i", "").alias("initials"), F.array_join("all.f", "").alias("faults"))
    numbered = scratch.cut(segments.withColumns({
        "seg": F.row_number().over(Window.partitionBy("_key").orderBy("block")).cast("bigint") - 1,
        "segs": F.count(F.lit(1)).over(Window.partitionBy("_key"))}), "segments")

    widest = numbered.agg(F.max("segs")).first()[0] or 0
    closing = F.lit(list(CLOSING)).cast("array<bigint>")
    alone = numbered.where("segs = 1").withColumn("given", closing)
    if widest > 1:
        many = numbered.where("segs > 1")
        costs = scratch.cut(map_rows(many.select("_key", "seg", "initials", "faults"), lambda batches: (
            {"_key": b["_key"], "seg": b["seg"], "v": [_crossing(i, f) for i, f in zip(b["initials"], b["faults"])]} for b in batches),
            f"_key {kind}, seg bigint, v array<bigint>"), "costs")
        rests = _over_segments(scratch, costs, widest, _all_joined, _rests, list(CLOSING))
        asked = many.alias("s").join(rests.alias("g"), F.col("s._key").eqNullSafe(F.col("g._key")) & (F.col("s.seg") == F.col("g.seg"))).select("s.*", "given")
    else:
        asked = alone.limit(0)
    found = map_rows(alone.unionByName(asked).select("_key", "seg", "initials", "faults", "given"), _solve,
                     f"_key {kind}, seg bigint, letters array<string>, v array<bigint>")
    solved = scratch.cut(numbered.alias("s").join(found.alias("f"), F.col("s._key").eqNullSafe(F.col("f._key")) & (F.col("s.seg") == F.col("f.seg"))).select(
        "s.*", "letters", "v"), "solved")
    entered = solved.where("segs = 1").withColumn("state", F.lit(START).cast("bigint"))
    if widest > 1:
        given = _over_segments(scratch, solved.where("segs > 1").select("_key", "seg", "v"), widest, _all_passed, _entries, [START])
        entered = entered.unionByName(solved.where("segs > 1").alias("s").join(
            given.alias("g"), F.col("s._key").eqNullSafe(F.col("g._key")) & (F.col("s.seg") == F.col("g.seg"))).select("s.*", F.col("given")[0].alias("state")))
    edits = map_rows(entered.select("initials", "faults", "first", F.element_at("letters", F.col("state").cast("int") + 1).alias("letters"),
                                    "state", (F.col("seg") + 1 == F.col("segs")).alias("last")), _per_turn,
                     "place bigint, fault string, before array<string>, letter string, role string, after array<string>")
    return placed.join(edits.withColumnRenamed("role", "new_role"), "place").select(
        F.col("_key").alias(key), F.col("_turn").alias(turn), F.col("_role").alias(role), F.col("_text").alias(text),
        "place", "fault", "letter", "new_role", "before", "after")


def repaired_turns(plan: DataFrame, key: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """The turns after the edits of ``plan_repair``: ``key``, ``place``, ``step`` (order among turns of one place), ``role``, ``text``.

    Inserted turns have an empty text. A plan without rows gives none.
    """
    def added(roles):
        return F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))

    own = F.when(F.col("letter") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(
        F.array(F.struct(F.coalesce("new_role", F.col(role)).alias("role"), F.col(text).alias("text"))))
    return plan.select(F.col(key).alias("_key"), "place", F.posexplode(F.concat(added("before"), own, added("after"))).alias("step", "_turn")).select(
        F.col("_key").alias(key), "place", "step", F.col("_turn.role").alias(role), F.col("_turn.text").alias(text))


def _fold(batches):
    """Streams the turns of each conversation in order; holds sums and the letters of one conversation at a time."""
    now, told = None, False
    sums: dict = {}

    def closed():
        distinct = sums["distinct"]
        return {"_key": [now], "gaps": [sums["high"] - sums["low"] + 1 - distinct if distinct else 0], "blank": [sums["b"]], "duplicate": [sums["d"]],
                "truncated": [sums["t"]], "illegal": [sums["illegal"]], "cost": [sums["cost"]], "audit": ["".join(sums["audit"])],
                "digest": [sums["sha"].hexdigest()]}

    for b in batches:
        for key, turn, role, text, fault, letter, new_role, before, after in zip(*(b[c] for c in (
                "_key", "_turn", "_role", "_text", "fault", "letter", "new_role", "before", "after"))):
            if not told or key != now:
                if told:
                    yield closed()
                now, told = key, True
                sums = {"distinct": 0, "low": 0, "high": 0, "b": 0, "d": 0, "t": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "lines": 0,
                        "initial": None}
            if turn is not None:
                sums["low"] = turn if not sums["distinct"] else sums["low"]
                sums["distinct"] += not sums["distinct"] or turn != sums["high"]
                sums["high"] = turn
            if fault != "-":
                sums[fault] += 1
            if sums["initial"] is not None:
                sums["illegal"] += sums["initial"] + role[:1] not in ("su", "ua", "au")
            sums["initial"] = role[:1]
            inserted = len(before) + len(after)
            sums["audit"].append("I" * len(before) + letter + "I" * len(after))
            sums["cost"] += INSERT * inserted + (DELETE if letter == "D" else (REROLE if letter == "R" else 0) + (CUT if fault == "t" else 0))
            lines = [f"{r}:" for r in before] + ([] if letter == "D" else [f"{new_role if letter == 'R' else role}:{text}"]) + [f"{r}:" for r in after]
            for line in lines:
                if sums["lines"]:
                    sums["sha"].update(b"\n")
                sums["sha"].update(line.encode("utf-8", "surrogatepass"))
                sums["lines"] += 1
    if told:
        yield closed()


def repair_report(plan: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of a plan: ``gaps`` (turn numbers missing between the first and the last), ``blank``, ``duplicate``,
    ``truncated``, ``illegal`` (neighbours that may not follow each other), ``cost``, ``audit`` (the letters in order) and
    ``digest`` (SHA-256 of the repaired ``role:text`` lines).

    A digest has to read the lines of a conversation one after the other, so
    they stream through one task, sorted; it holds one turn at a time and the
    letters. Null turns count for no gap. No rows: an empty result.
    """
    rows = plan.select(F.col(key).alias("_key"), F.col(turn).cast("bigint").alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"),
                       "place", "fault", "letter", "new_role", "before", "after")
    kind = rows.schema["_key"].dataType.simpleString()
    ordered = rows.repartition(shuffle_width(plan.sparkSession), "_key").sortWithinPartitions("_key", "place")
    return map_rows(ordered.drop("place"), _fold, f"_key {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                    "cost bigint, audit string, digest string").withColumnRenamed("_key", key)
