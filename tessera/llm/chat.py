"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in turn, the
user first. Dynamic programming over that automaton finds the cheapest repair: a turn keeps
its role, is relabelled (cost 2), is merged into the turn before it (1, and 2 more if their
roles differ), or gets one empty turn of the missing role inserted before it (3). The repaired
sequence is then rendered turn by turn. The repair depends on the roles alone, so a process
remembers some of the short sequences it has solved.

Plan: one shuffle by conv_id gathers the turns of a conversation, which become one text in the
result anyway. Defined cases: rows without conv_id are conversations of one turn each; a null or
unknown role fits none and must be relabelled or merged; null text is empty; equal turns are
ordered by role, then text; repeated rows are turns each; an empty table gives no rows;
extra columns are ignored. Of repairs of equal cost the one with fewer insertions, then
fewer relabelled turns, is taken; then the one that, at the first turn where they part, keeps rather than
merges, merges rather than relabels, and relabels rather than inserts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import lean

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 2, 3
#: From a state (the last role, None before the first turn) to the roles that may follow.
NEXT: dict[str | None, tuple[str, ...]] = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def _choices(state: str | None, own: str | None) -> Iterator[tuple[tuple[int, int, int], int, str, tuple[tuple[str, str], ...]]]:
    """(cost, inserts, relabels), rank, next state and steps of each way to take a turn of role ``own``."""
    for role in NEXT[state]:
        same = role == own
        yield (0 if same else RELABEL, 0, int(not same)), 0 if same else 2, role, (("keep" if same else "relabel", role),)
        if role == "system":
            continue  # an empty system turn helps nothing
        for then in NEXT[role]:
            same = then == own
            yield (INSERT + (0 if same else RELABEL), 1, int(not same)), 3, then, (("insert", role), ("keep" if same else "relabel", then))
    if state is not None:
        same = state == own
        yield (MERGE + (0 if same else RELABEL), 0, int(not same)), 1, state, (("merge", state),)


_CHOICES = {(state, own): tuple(_choices(state, own)) for state in NEXT for own in (*ROLES, None)}


def repair(roles: tuple[str | None, ...]) -> tuple[int, tuple[tuple[str, str, int], ...]]:
    """(cost, steps): a step is (action, role, index of the turn), with -1 for an inserted turn.

    Costs to go are found from the end, one row of the automaton's states a turn; a walk from
    the start then takes the first of the cheapest ways. Time and memory are linear in the turns.
    """
    rest: list[dict[str | None, tuple[int, int, int]]] = [dict.fromkeys(NEXT, (0, 0, 0))]
    for own in reversed(roles):
        after = rest[-1]
        rest.append({state: min((c + x, n + y, r + z) for (c, n, r), _, then, _ in _CHOICES[state, own] for x, y, z in (after[then],)) for state in NEXT})
    rest.reverse()
    steps: list[tuple[str, str, int]] = []
    state: str | None = None
    for i, own in enumerate(roles):
        best = rest[i][state]
        ways = [(rank, then, way) for (c, n, r), rank, then, way in _CHOICES[state, own] if (c + rest[i + 1][then][0], n + rest[i + 1][then][1], r + rest[i + 1][then][2]) == best]
        _, state, way = min(ways)
        steps += [(action, role, -1 if action == "insert" else i) for action, role in way]
    return rest[0][None][0], tuple(steps)


_SHORT = 64
_repair_short = lru_cache(maxsize=16_384)(repair)


def render(steps: tuple[tuple[str, str, int], ...], texts: list[str], turn: str = "<|im_start|>{role}\n{text}<|im_end|>\n", joint: str = "\n") -> tuple[int, str]:
    """(number of turns, text) of a repaired conversation."""
    out: list[list[str]] = []
    for action, role, i in steps:
        if action == "merge":
            out[-1][1] += joint + texts[i]
        else:
            out.append([role, "" if i < 0 else texts[i]])
    return len(out), "".join(turn.replace("{role}", r).replace("{text}", t) for r, t in out)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "cost", "n_merged", "n_relabelled", "n_inserted", "n_turns_out", "rendered"]
    for batch in batches:
        rows = []
        for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            roles = tuple(t["role"] for t in turns)
            cost, steps = _repair_short(roles) if len(roles) <= _SHORT else repair(roles)
            n, text = render(steps, [t["text"] or "" for t in turns])
            moved = sum(i >= 0 and role != roles[i] for _, role, i in steps)
            rows.append((conv, len(turns), cost, sum(s[0] == "merge" for s in steps), moved, sum(s[0] == "insert" for s in steps), n, text))
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text)``: what was repaired, and the rendered text."""
    turn = F.struct("turn", F.when(F.col("role").isin(*ROLES), F.col("role")).alias("role"), "text")
    whole = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    single = turns.where("conv_id is null").select(F.lit(None).cast("long").alias("conv_id"), F.array(turn).alias("turns"))
    schema = "conv_id long, n_turns long, cost long, n_merged long, n_relabelled long, n_inserted long, n_turns_out long, rendered string"
    return whole.unionByName(single).mapInArrow(lean(_format), schema)
