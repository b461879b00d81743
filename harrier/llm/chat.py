"""Chat formatting with minimum-cost role repair.

A legal conversation is a word of an automaton: an optional ``system`` turn, then
``user`` and ``assistant`` in turn, starting with ``user`` and ending with
``assistant``. A conversation is repaired at the least cost by choosing for each turn
a role (its own, or another: a *relabel*), whether it opens a turn or joins the one
before it (a *merge*), and whether an empty turn goes in before it (an *insertion*);
an empty turn may also close the conversation.

The choice is a dynamic programme over the automaton's states. A stretch of turns
acts on the states as a matrix of least costs, and such matrices combine
associatively (min, +). So a conversation of any length is cut into stretches of at
most ``stretch`` turns, in three steps: the matrix of each stretch; for each
conversation, the states at the ends of its stretches on the cheapest path; and the
path inside each stretch, given its ends. No task holds a conversation's turns (the
second step holds sixteen numbers for each stretch), and no row holds a whole
rendering: each turn carries its *fragment*, and the fragments in the
order of ``(conv_id, seq, part)`` are the rendered conversation.

Turns are ordered by ``turn``, then role and text; null turns come first. Roles are
compared without case and outer white space; null, empty and unknown roles fit every
role at ``unknown`` cost. A null text is empty. Repeated rows are turns of their own.
Of equal costs, the first in the order keep, merge, relabel, insert wins. A null
``conv_id`` is a conversation of its own. Columns beyond the four are left out, whatever
their names. Empty tables give no rows; a text of any length is rendered whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import map_rows, materialize

ROLES = ("system", "user", "assistant")
#: States: before any turn, and after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: What each step costs.
COSTS = {"merge": 1, "unknown": 1, "relabel": 3, "insert": 4}
#: Turns of a stretch, and characters of its texts (one turn at least), that a task holds at a time.
STRETCH = 16_384
STRETCH_CHARS = 4_000_000
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
_FAR = 10**12

#: A step: cost, state after it, role, inserted role (0: none), does it merge?
Step = tuple[int, int, int, int, bool]


def role_state(role: str | None) -> int:
    """The state of a role's name; 0 where it has none."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def steps(role: int, state: int) -> list[Step]:
    """What may be done with a turn of ``role`` in ``state``, cheapest first."""
    out = []
    for new in (SYSTEM, USER, ASSISTANT):
        named = 0 if new == role else COSTS["unknown"] if role == 0 else COSTS["relabel"]
        if (state, new) in LEGAL:
            out.append((named, 0, new, 0, False))
        if state == new:
            out.append((named + COSTS["merge"], 1, new, 0, True))
        for between in (SYSTEM, USER, ASSISTANT):
            if (state, between) in LEGAL and (between, new) in LEGAL:
                out.append((named + COSTS["insert"], 2, new, between, False))
    out.sort(key=lambda x: (x[0], x[1], x[2] != role, x[2], x[3]))
    return [(cost, new, new, between, merge) for cost, _, new, between, merge in out]


STEPS = {(role, state): steps(role, state) for role in range(4) for state in range(4)}
#: What it costs to end in a state: an empty turn of the assistant after the user's.
CLOSING = {START: 0, SYSTEM: 2 * COSTS["insert"], USER: COSTS["insert"], ASSISTANT: 0}


def costs_from(roles: list[int], start: int) -> list[int]:
    """The least cost of each state after the turns, from ``start``."""
    now = [_FAR] * 4
    now[start] = 0
    for role in roles:
        after = [_FAR] * 4
        for state, cost in enumerate(now):
            if cost < _FAR:
                for extra, new, *_ in STEPS[role, state]:
                    if cost + extra < after[new]:
                        after[new] = cost + extra
        now = after
    return now


def matrix(roles: list[int]) -> list[list[int]]:
    return [costs_from(roles, start) for start in range(4)]


def path(roles: list[int], start: int, end: int) -> list[Step]:
    """The cheapest steps from ``start`` to ``end``; of equals, the first."""
    tables = [[_FAR] * 4]
    tables[0][end] = 0
    for role in reversed(roles):
        later = tables[-1]
        tables.append([min((extra + later[new] for extra, new, *_ in STEPS[role, state]), default=_FAR) for state in range(4)])
    tables.reverse()
    state, out = start, []
    for role, later in zip(roles, tables[1:], strict=True):
        step = min(STEPS[role, state], key=lambda s: s[0] + later[s[1]])
        out.append(step)
        state = step[1]
    return out


def through(matrices: list[list[list[int]]]) -> tuple[list[int], int]:
    """The states between the stretches on the cheapest path from ``START``, its ends
    included, and the whole cost with the closing."""
    tables = [[CLOSING[state] for state in range(4)]]
    for m in reversed(matrices):
        tables.append([min(m[a][b] + tables[-1][b] for b in range(4)) for a in range(4)])
    tables.reverse()
    states = [START]
    for m, later in zip(matrices, tables[1:], strict=True):
        a = states[-1]
        states.append(min(range(4), key=lambda b: (m[a][b] + later[b], b)))
    return states, tables[0][START]


def opening(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


CLOSE = "<|end|>\n"


def repair(conversations: DataFrame, stretch: int = STRETCH, stretch_chars: int = STRETCH_CHARS) -> DataFrame:
    """``(conv_id, seq, turn, role_in, role, action, inserted, cost, text, fragment)``:
    a row for each turn, in the order of ``seq``; the last one's fragment closes the
    conversation."""
    ordered = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    # a range partition cuts a conversation of any length over many tasks
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def number(values: Iterator[tuple]) -> Iterator[tuple]:
        for (part, conv), turns in groupby(values, key=lambda r: (r[0], r[1])):
            block, pos, chars = 0, 0, 0
            for _, _, turn, role, text in turns:
                if pos == stretch or (pos and chars + len(text) > stretch_chars):
                    block, pos, chars = block + 1, 0, 0
                yield part, conv, block, pos, turn, role, role_state(role), text
                pos, chars = pos + 1, chars + len(text)

    numbered = map_rows(ordered, ["part", *keys], number, f"part int, conv_id {kind}, block long, pos int, turn long, role string, state int, text string")
    numbered = materialize(numbered, "turns")

    def weigh(values: Iterator[tuple]) -> Iterator[tuple]:
        for key, turns in groupby(values, key=lambda r: r[:3]):
            roles = [state for *_, state in turns]
            yield *key, len(roles), [c for row in matrix(roles) for c in row]

    where = ["conv_id", "part", "block"]
    dealt = numbered.select(*where, "pos", "state").repartition(*where).sortWithinPartitions(*where, "pos")
    stretches = map_rows(dealt, [*where, "pos", "state"], weigh, f"conv_id {kind}, part int, block long, n long, costs array<long>")

    def route(values: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(values, key=lambda r: r[0]):
            parts = list(own)
            states, cost = through([[flat[4 * a : 4 * a + 4] for a in range(4)] for *_, flat in parts])
            total, first = sum(n for _, _, _, n, _ in parts), 0
            for (_, part, block, n, _), enter, leave in zip(parts, states[:-1], states[1:], strict=True):
                yield conv, part, block, first, total, enter, leave, cost
                first += n

    ends = stretches.repartition("conv_id").sortWithinPartitions(*where)
    routed = map_rows(ends, stretches.columns, route, f"c {kind}, p int, b long, first long, n_turns long, enter int, leave int, cost long")
    joined = numbered.join(routed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
    rows = joined.repartition(*where).sortWithinPartitions(*where, "pos")

    def render(values: Iterator[tuple]) -> Iterator[tuple]:
        for (conv, _, _), own in groupby(values, key=lambda r: r[:3]):
            turns = list(own)
            state, leave = turns[0][-3], turns[0][-2]
            for row, step in zip(turns, path([r[4] for r in turns], state, leave), strict=True):
                yield conv, *_rendered(row, step, state)
                state = step[1]

    schema = f"conv_id {kind}, seq long, turn long, role_in string, role string, action string, inserted string, cost long, text string, fragment string"
    return map_rows(rows, [*where, "pos", "state", "turn", "role", "text", "first", "n_turns", "enter", "leave", "cost"], render, schema)


def _rendered(row: tuple, step: Step, state: int) -> tuple:
    """A turn's output row but its conversation: ``state`` is the one before it."""
    _, _, _, pos, said, turn, role, text, first, n_turns, _, _, cost = row
    _, new, _, between, merge = step
    lead = "\n\n" if merge else (CLOSE if state else "") + (opening(between) + CLOSE if between else "") + opening(new)
    tail = ""
    if first + pos == n_turns - 1:
        missing = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(new, ())
        tail = CLOSE + "".join(opening(s) + CLOSE for s in missing)
    acts = [*(["insert"] if between else []), *(["merge"] if merge else []), *([] if new == said else ["relabel"])]
    return first + pos, turn, role, ROLES[new - 1], "+".join(acts) or "keep", ROLES[between - 1] if between else None, cost, text, lead + text + tail
