"""Operator 7: chat formatting with minimum-cost role repair.

A legal conversation is a walk through an automaton of turns: an optional
system turn, then user and assistant in alternation, with tool turns between
assistant turns, and an assistant turn last. Dynamic programming over its
states finds the cheapest of merges into the turn before, relabels and empty
insertions that make a conversation legal, and the result is rendered.

Turns are range-partitioned by conversation and order, so one that holds most
rows is spread over many tasks. A conversation inside one partition is solved
there. One that crosses partitions is a chain of chunks, at most two a
partition: each gives its min-plus matrix of costs between states (25 numbers);
one scan per conversation over these gives the costs before each chunk, the
chunks then report where their traceback enters for each exit, and a scan back
gives each chunk its exit and its first position. All of it runs on executors
and joins back to the chunks; nothing is collected. The choice among equal
costs is that of an undivided traceback, so the result doesn't depend on the
partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, require

#: States: nothing yet, or the role of the last turn.
ROLES = ("system", "user", "assistant", "tool")
SYSTEM, USER, ASSISTANT, TOOL = range(1, 5)
NEXT = {0: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER, TOOL), TOOL: (ASSISTANT, TOOL)}
STATES = range(5)
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system", "function": "tool"}
MERGE, RELABEL, INSERT = 1, 2, 3
NEVER = 1 << 40

#: Cheapest insertions from one state to another, as roles.
_PATHS: list[list[tuple[int, ...] | None]] = [[() if a == b else None for b in STATES] for a in STATES]
for _ in STATES:
    for a in STATES:
        for b in STATES:
            if _PATHS[a][b] is not None:
                for c in NEXT[b]:
                    if _PATHS[a][c] is None or len(_PATHS[a][c]) > len(_PATHS[a][b]) + 1:
                        _PATHS[a][c] = (*_PATHS[a][b], c)


def _moves(role: int) -> list[list[tuple[int, int, str, tuple[int, ...]]]]:
    """For each end state: (cost, from, action, inserted roles), cheapest first for each from."""
    out = []
    for to in STATES[1:]:
        relabel = 0 if to == role else RELABEL
        best = {}
        for a in STATES:
            options = [(MERGE + relabel, a, "merge", ())] if a == to else []
            for before in STATES:
                path = _PATHS[a][before]
                if path is not None and to in NEXT[before]:
                    options.append((INSERT * len(path) + relabel, a, "turn", path))
            if options:
                best[a] = min(options, key=lambda o: (o[0], o[2] == "merge", len(o[3]), o[3]))
        out.append(sorted(best.values(), key=lambda o: o[1]))
    return [[], *out]


#: By role; 0 is an unknown role, which has to be relabelled.
MOVES = [_moves(r) for r in range(5)]
_LAST = [NEVER if _PATHS[s][ASSISTANT] is None else INSERT * len(_PATHS[s][ASSISTANT]) for s in STATES]


def role_of(name: str | None) -> int:
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def step(costs: list[int], role: int) -> tuple[list[int], list]:
    """Costs after a turn, and the move that gives each."""
    new, moves = [NEVER] * 5, [None] * 5
    for to in STATES[1:]:
        for move in MOVES[role][to]:
            c = costs[move[1]] + move[0]
            if c < new[to]:
                new[to], moves[to] = c, move
    return new, moves


def matrix(roles: list[int]) -> list[list[int]]:
    """Costs from each state to each over these turns."""
    out = []
    for a in STATES:
        costs = [0 if s == a else NEVER for s in STATES]
        for r in roles:
            costs, _ = step(costs, r)
        out.append(costs)
    return out


def traceback(roles: list[int], costs: list[int], end: int) -> tuple[int, list]:
    """State before the first turn and the moves, for costs before it and a state at the end."""
    found = []
    for r in roles:
        costs, moves = step(costs, r)
        found.append(moves)
    path = []
    for moves in reversed(found):
        path.append((end, moves[end]))
        end = moves[end][1]
    return end, path[::-1]


START = [0, NEVER, NEVER, NEVER, NEVER]


def best_end(costs: list[int]) -> int:
    return min(STATES, key=lambda s: (costs[s] + _LAST[s], s))


def segments(turns: list[tuple[int, str]], path: list, entry: int, last: bool) -> Iterator[tuple[str, str, str]]:
    """(role, action, rendered) of a stretch of turns; joined they are the conversation."""
    opened = lambda after, role: ("<|im_end|>\n" if after else "") + f"<|im_start|>{ROLES[role - 1]}\n"
    state = entry
    for (role, text), (to, (_, _, action, inserted)) in zip(turns, path):
        for x in inserted:
            yield ROLES[x - 1], "insert", opened(state, x)
            state = x
        text = text.replace("<|im_", "< |im_")
        name = action if role == to else ("relabel" if action == "turn" else "relabel+merge")
        yield ROLES[to - 1], name, ("\n" if action == "merge" else opened(state, to)) + text
        state = to
    if last:
        for x in _PATHS[state][ASSISTANT]:
            yield ROLES[x - 1], "insert", opened(state, x)
            state = x
        yield ROLES[state - 1], "end", "<|im_end|>\n"


def format_chats(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Return (id_col, position, role, action, rendered): repaired conversations in segments.

    Segments in the order of position, joined, are a conversation's text. action is
    turn, merge, relabel, relabel+merge, insert or end. Turns are ordered by
    turn_col (null first), then role and text; repeated rows are repeated
    turns, which merge. Unknown and null roles are relabelled, null texts are
    empty, very long ones stay whole; rows with a null id are one conversation.
    What looks like a marker in a text gets a space. An empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    require(turns, id_col, turn_col, role_col, text_col)
    kind = turns.select(id_col).dtypes[0][1]
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The last key parts repeated rows, whose order doesn't matter.
    order = ["conv", "turn", "role", "text"]
    ordered = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order, "place").sortWithinPartitions(*order)

    columns = ["conv", "part", "seq", "code", "text", "position", "role", "action", "rendered", "costs"]
    schema = f"conv {kind}, part int, seq long, code int, text string, position long, role string, action string, rendered string, costs array<long>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv_type = TaskContext.get().partitionId(), None
        first, run, name = True, [], None

        def pack(out: list[tuple]) -> pa.RecordBatch:
            kinds = (conv_type, pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=columns)

        def closed() -> list[tuple]:
            costs = START
            for r, _ in run:
                costs, _ = step(costs, r)
            entry, path = traceback([r for r, _ in run], START, best_end(costs))
            return [(name, part, None, None, None, i, *s, None) for i, s in enumerate(segments(run, path, entry, True))]

        def left_open() -> list[tuple]:
            rows = [(name, part, i, r, t, None, None, None, None, None) for i, (r, t) in enumerate(run)]
            return [*rows, (name, part, -1, None, None, None, None, None, None, [c for a in matrix([r for r, _ in run]) for c in a])]

        out: list[tuple] = []
        for batch in batches:
            conv_type = batch.column(0).type
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if run and conv != name:
                    out += left_open() if first else closed()
                    first, run = False, []
                    if len(out) >= 2000:
                        yield pack(out)
                        out = []
                name = conv
                run.append((role_of(role), text))
        if run:
            out += left_open()
        if out:
            yield pack(out)

    solved = materialise(ordered.select(*order).mapInArrow(solve, schema), "chats")
    # At most two conversations of each partition are open: the first and the last.
    from pyspark.sql.pandas.types import to_arrow_type

    open_type = to_arrow_type(solved.schema["conv"].dataType)
    long, int_ = pa.int64(), pa.int32()

    def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
        """Rows of one key after the other; the key is the first columns."""
        name, run = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if run and row[:keys] != name:
                    yield name, run
                    run = []
                name = row[:keys]
                run.append(row[keys:])
        if run:
            yield name, run

    def table(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), parts in runs(batches, 1):
            costs, out = START, []
            for part, m in parts:
                out.append((conv, part, costs, None))
                costs = [min(min(costs[a] + m[5 * a + b] for a in STATES), NEVER) for b in STATES]
            out[-1] = (*out[-1][:3], best_end(costs))
            yield table(["conv", "part", "before", "end"], [open_type, int_, pa.list_(long), long], out)

    chunks = solved.filter("seq = -1").select("conv", "part", "costs").repartition("conv").sortWithinPartitions("conv", "part")
    before = materialise(chunks.mapInArrow(forward, f"conv {kind}, part int, before array<long>, end long"), "before")
    open_rows = solved.filter("seq >= 0").select("conv", "part", "seq", "code", "text")

    def told(rows: DataFrame, what: DataFrame, *names: str) -> DataFrame:
        """Rows of chunks in order, the first of each with what is known of the chunk."""
        what = what.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), *names)
        both = rows.join(what, (F.col("seq") == 0) & (F.col("part") == F.col("_p")) & F.col("conv").eqNullSafe(F.col("_c")), "left")
        return both.select("part", "conv", "seq", "code", "text", *names).repartition("part", "conv").sortWithinPartitions("part", "conv", "seq")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, conv), run in runs(batches, 2):
            costs, end, codes, ways = run[0][3], run[0][4], [r[1] for r in run], []
            reached = costs
            for r in codes:
                reached, _ = step(reached, r)
            for state in STATES:
                if reached[state] >= NEVER:
                    ways += [-1, 0]
                else:
                    entry, path = traceback(codes, costs, state)
                    ways += [entry, len(run) + sum(len(m[3]) for _, m in path)]
            yield table(["conv", "part", "end", "ways"], [open_type, int_, long, pa.list_(long)], [(conv, part, end, ways)])

    ways = told(open_rows.withColumn("text", F.lit("")), before, "before", "end").mapInArrow(entries, f"conv {kind}, part int, end long, ways array<long>")

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), parts in runs(batches, 1):
            state, at, out = parts[0][1], 0, []
            for part, end, found in parts:  # the last chunk first
                out.append((part, state, end is not None, found[2 * state + 1]))
                state = found[2 * state]
            rows = []
            for part, exit_, last, n in reversed(out):
                rows.append((conv, part, exit_, last, at))
                at += n
            yield table(["conv", "part", "exit", "last", "at"], [open_type, int_, long, pa.bool_(), long], rows)

    exits = ways.repartition("conv").sortWithinPartitions("conv", F.desc("part")).mapInArrow(backward, f"conv {kind}, part int, exit long, last boolean, at long")
    exits = materialise(exits.join(before.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), "before"), (F.col("part") == F.col("_p")) & F.col("conv").eqNullSafe(F.col("_c"))).select("conv", "part", "exit", "last", "at", "before"), "exits")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, conv), run in runs(batches, 2):
            end, last, at, costs = run[0][3:]
            turns = [(code, text) for _, code, text, *_ in run]
            entry, path = traceback([r for r, _ in turns], costs, end)
            out = list(segments(turns, path, entry, last))
            yield table(["conv", "position", "role", "action", "rendered"], [open_type, long, pa.string(), pa.string(), pa.string()], [(conv, i, *s) for i, s in enumerate(out, at)])

    done = solved.filter("seq is null").select("conv", "position", "role", "action", "rendered")
    rest = told(open_rows, exits, "exit", "last", "at", "before").mapInArrow(finish, f"conv {kind}, position long, role string, action string, rendered string")
    return done.unionByName(rest).select(F.col("conv").alias(id_col), "position", "role", "action", "rendered")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
