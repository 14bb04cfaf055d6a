"""Conversation structure repair: cheapest edits to a system turn and user/assistant pairs.

A conversation's rows stand in order of turn (NULL first), then role and text. Its
role initials shall read ``(s?(ua)+)?``. Keeping a row costs 0, giving it the role user
or assistant 3, deleting it 4, and an empty user or assistant row can be inserted
anywhere for 3. Blank and repeated rows have to go; a truncated row that stays adds 3.
Among the cheapest edits the one whose initials (D, I, K, R) read least is taken.

The method is a Viterbi pass that runs in parallel over parts of a conversation. Rows are
dealt out by range of (conversation, turn, role, text), so a conversation of any length
is cut into parts of bounded rows and bytes that are solved side by side:

1. every part runs backwards from a guessed cost vector, one cost for each of the four
   states the repaired roles can be in; its true one is known only to the last part;
2. fix-up passes: a part whose successor came out with another vector, other than by a
   constant, runs again from that vector, beside its earlier run, and stops where the
   two differ by a constant only, as from there on nothing changes;
3. rows that must be deleted change a vector by a constant alone and never delay this.
   Some runs (users only, say) keep two vectors apart for good: after ``passes`` passes
   what is left is settled by the parts' min-plus matrices, folded in one stream;
4. with the stitched costs each part is traced forwards, least letter first, from the
   state the part before it ends in.

Conversations that lie whole in one part, nearly all, need neither passes nor joins.

Defined results: NULL role or text counts as one space; an empty role has no initial
that fits. A NULL conversation id is a conversation. Equal rows are counted first and
never gathered. An empty table has no result; other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.operators.scale import bounded_broadcast, same, stored, written

#: A part ends before it has more rows or bytes of text than this, or has one row.
PART_ROWS = 4096
PART_BYTES = 4 << 20
#: Fix-up passes before matrices settle what still differs.
PASSES = 4
#: Characters of a text that decide where a range of rows is cut.
HEAD = 64

# States: nothing yet, after the system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted or renamed row; such a row is a user's except after a user.
STEP = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
INSERT, RENAME, DELETE, TRUNCATED = 3, 3, 4, 3
#: Costs where no row is left.
END = (0, 2 * INSERT, INSERT, 0)
GUESS = (0, 0, 0, 0)
FAR = 1 << 50
#: Kinds of rows: 2 * initial + truncated for those that may stay.
INITIALS = "sua"
BLANK, REPEATED = 8, 9
BLANKS = " \t\n\x0b\x0c\r"

_PART = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("whole", T.BooleanType()),
        T.StructField("rows", T.LongType()),
        T.StructField("turn_low", T.LongType()),
        T.StructField("turn_high", T.LongType()),
        T.StructField("turns", T.LongType()),
        T.StructField("initial_first", T.StringType()),
        T.StructField("initial_last", T.StringType()),
        T.StructField("illegal", T.LongType()),
    ]
)
_FIXED = T.StructType(
    [
        T.StructField("blank", T.LongType()),
        T.StructField("duplicate", T.LongType()),
        T.StructField("truncated", T.LongType()),
        T.StructField("cost", T.LongType()),
        T.StructField("audit", T.StringType()),
        T.StructField(
            "repaired",
            T.ArrayType(
                T.StructType(
                    [T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
                )
            ),
        ),
    ]
)
_ROWS = T.StructType(
    [
        T.StructField("kinds", T.BinaryType()),
        T.StructField("copies", T.ArrayType(T.LongType())),
        T.StructField("digests", T.ArrayType(T.BinaryType())),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("texts", T.ArrayType(T.StringType())),
    ]
)
_VECTOR = T.ArrayType(T.LongType())


# --- the lattice: one row at a time -------------------------------------------------


def _after_keep(state: int, kind: int) -> int | None:
    """State after keeping a row of ``kind``, or None where it can't stay as it is."""
    initial = kind >> 1
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


@lru_cache(maxsize=1 << 16)
def _back(costs: tuple, kind: int) -> tuple[tuple, int]:
    """Costs before a row from those after it, less their least; and that least."""
    extra = TRUNCATED * (kind & 1)
    best = []
    for state in range(4):
        options = [DELETE + costs[state], RENAME + extra + costs[STEP[state]]]
        kept = _after_keep(state, kind)
        if kept is not None:
            options.append(extra + costs[kept])
        best.append(min(options))
    user = min(best[USER], INSERT + best[ASSISTANT])
    assistant = min(best[ASSISTANT], INSERT + best[USER])
    raw = (min(best[NOTHING], INSERT + user), min(best[SYSTEM], INSERT + user), user, assistant)
    return _level(raw)


def _level(raw: tuple) -> tuple[tuple, int]:
    least = min(raw)
    return tuple(c - least if c < FAR // 2 else FAR for c in raw), least


@lru_cache(maxsize=1 << 16)
def _forward(costs: tuple, kind: int, state: int) -> tuple[str, tuple, str | None, int, int]:
    """Letters, inserted roles, new role, next state and cost of the least best edits.

    ``costs`` are those after the row. The new role is "" where the row is kept.
    """
    extra = TRUNCATED * (kind & 1)
    letters, inserted, paid = "", (), 0
    while True:
        aim = _total(costs, kind, state)
        if DELETE + costs[state] == aim:
            return letters + "D", inserted, None, state, paid + DELETE
        onward = STEP[state]
        if len(inserted) < 2 and INSERT + _total(costs, kind, onward) == aim:
            letters, inserted, paid = letters + "I", (*inserted, ROLE[onward]), paid + INSERT
            state = onward
            continue
        kept = _after_keep(state, kind)
        if kept is not None and extra + costs[kept] == aim:
            return letters + "K", inserted, "", kept, paid + extra
        return letters + "R", inserted, ROLE[onward], onward, paid + RENAME + extra


def _total(costs: tuple, kind: int, state: int) -> int:
    before, least = _back(costs, kind)
    return before[state] + least


def backwards(kinds: bytes, after: tuple) -> tuple[list[tuple], tuple, int]:
    """Cost vectors after every row, the one before all rows, and its constant."""
    seen, constant = [after] * len(kinds), 0
    for at in range(len(kinds) - 1, -1, -1):
        seen[at] = after
        if kinds[at] < BLANK:
            after, least = _back(after, kinds[at])
            constant += least
    return seen, after, constant


def rerun(kinds: bytes, earlier: tuple, result: tuple, after: tuple) -> tuple:
    """The vector before all rows from ``after``, given the ``result`` of ``earlier``.

    Both runs go on side by side until their vectors differ by a constant only.
    """
    for kind in reversed(kinds):
        if after == earlier:
            return result
        if kind < BLANK:
            after, earlier = _back(after, kind)[0], _back(earlier, kind)[0]
    return after


def matrix(kinds: bytes) -> list[int]:
    """Least costs from each state before the rows (row) to each after them (column)."""
    columns = []
    for state in range(4):
        unit = tuple(0 if s == state else FAR for s in range(4))
        _, before, constant = backwards(kinds, unit)
        columns.append([c + constant if c < FAR else FAR for c in before])
    return [columns[j][i] for i in range(4) for j in range(4)]


def through(costs: list[int], after: tuple) -> tuple:
    """The vector before the rows of a ``matrix``, up to a constant."""
    return _level(tuple(min(costs[4 * i + j] + after[j] for j in range(4)) for i in range(4)))[0]


def states_after(kinds: bytes, seen: list[tuple]) -> list[int]:
    """The state each state leads to."""
    out = []
    for state in range(4):
        for at, kind in enumerate(kinds):
            if kind < BLANK:
                state = _forward(seen[at], kind, state)[3]
        out.append(state)
    return out


def traced(kinds: bytes, copies: list[int], roles: list, texts: list, seen: list[tuple],
           state: int, last: bool) -> tuple:
    """Counts, cost, audit letters and repaired rows from a state onwards."""
    blank = repeated = cut = cost = 0
    audit, new_roles, new_texts = [], [], []
    for at, kind in enumerate(kinds):
        n = copies[at]
        if kind >= BLANK:
            blank, repeated = blank + n * (kind == BLANK), repeated + n * (kind == REPEATED)
            audit.append("D" * n)
            cost += DELETE * n
            continue
        letters, inserted, role, state, paid = _forward(seen[at], kind, state)
        cut, repeated = cut + (kind & 1), repeated + n - 1
        cost += paid + DELETE * (n - 1)
        audit.append(letters + "D" * (n - 1))
        new_roles += inserted
        new_texts += [""] * len(inserted)
        if role is not None:
            new_roles.append(role or roles[at])
            new_texts.append(texts[at])
    while last and END[state]:
        state = STEP[state]
        audit.append("I")
        new_roles.append(ROLE[state])
        new_texts.append("")
        cost += INSERT
    return blank, repeated, cut, cost, "".join(audit), new_roles, new_texts


# --- parts --------------------------------------------------------------------------


class _Run:
    """Consecutive rows of one conversation."""

    def __init__(self, conversation, part: int, first: bool):
        self.conversation, self.part, self.whole = conversation, part, not first
        self.kinds, self.copies = bytearray(), []
        self.roles, self.texts, self.seen = [], [], set()
        self.rows = self.turns = self.illegal = self.bytes = 0
        self.turn_low = self.turn_high = self.first = self.last = None

    def full(self, text: str, most_rows: int, most_bytes: int) -> bool:
        return len(self.kinds) >= most_rows or bool(self.kinds) and self.bytes + len(text) > most_bytes

    def add(self, turn, role: str, text: str, copies: int, blank: bool, cut: bool) -> None:
        initial = role[:1]
        if turn is not None and turn != self.turn_high:
            self.turn_low = turn if self.turn_low is None else self.turn_low
            self.turn_high, self.turns = turn, self.turns + 1
        if self.rows:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last, self.rows = initial, self.rows + copies
        self.illegal += copies - 1
        if blank:
            kind = BLANK
        elif (role, text) in self.seen:
            kind = REPEATED
        else:
            self.seen.add((role, text))
            place = INITIALS.find(initial) if initial else -1
            kind = 2 * (place if place >= 0 else 3) + cut
        self.kinds.append(kind)
        self.copies.append(copies)
        self.roles.append(role)
        self.texts.append(text if kind < BLANK else "")
        self.bytes += len(text)

    def facts(self) -> tuple:
        return (self.part, self.whole, self.rows, self.turn_low, self.turn_high, self.turns,
                self.first, self.last, self.illegal)

    def digests(self) -> list[bytes | None]:
        return [
            hashlib.sha256(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).digest() if k < BLANK else None
            for k, r, t in zip(self.kinds, self.roles, self.texts)
        ]

    def solved(self) -> tuple:
        kinds = bytes(self.kinds)
        seen, _, _ = backwards(kinds, END)
        return traced(kinds, self.copies, self.roles, self.texts, seen, NOTHING, True)


def _lists(rows: list[tuple], kind: pa.DataType) -> pa.Array:
    """A list column; one of (role, text) structs is built from its two flat columns."""
    if not pa.types.is_struct(kind.value_type):
        return pa.array(rows, kind)
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row[0]) if row else offsets[-1])
    flat = [[v for row in rows if row for v in row[i]] for i in (0, 1)]
    structs = pa.StructArray.from_arrays([pa.array(f, pa.string()) for f in flat], ["role", "text"])
    missing = pa.array([row is None for row in rows])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, mask=missing)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for field, values in zip(schema, zip(*rows)):
        make = _lists if pa.types.is_list(field.type) else pa.array
        columns.append(make(list(values), field.type))
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _arrow(df_schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def _emitted(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes."""
    held, size = [], 0
    for row, n_bytes in rows:
        held.append(row)
        size += n_bytes + 200
        if size > PART_BYTES // 2:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _packed(units: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Whole conversations solved, and the parts of those that a range border cuts."""
    schema = T.StructType([units.schema["conv_id"], *_PART, *_FIXED, *_ROWS])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
        base, run, count = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                conversation, turn, role, text, copies, blank, cut = row
                other = run is None or conversation != run.conversation
                if other or (run.full(text, most_rows, most_bytes) and copies):
                    first = run is None
                    if run is not None:
                        run.whole = run.whole and other
                        yield run
                    # A run that is cut isn't whole, nor is what follows the cut.
                    run = _Run(conversation, base + count, first or not other)
                    count += 1
                if copies:
                    run.add(turn, role, text, copies, blank, cut)
        if run is not None:
            run.whole = False
            yield run

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[tuple, int]]:
            for run in runs(batches):
                fixed, held = (None,) * 6, (None,) * 5
                if run.whole:
                    *counts, roles, texts = run.solved()
                    fixed = (*counts, (roles, texts))
                else:
                    held = (bytes(run.kinds), run.copies, run.digests(), run.roles, run.texts)
                yield (run.conversation, *run.facts(), *fixed, *held), run.bytes
        yield from _emitted(rows(), _arrow(schema))

    return units.mapInArrow(pack, schema)


def _with_late_repeats(cut: DataFrame) -> DataFrame:
    """(conv_id, part, kinds): rows whose role and text stand in an earlier part marked."""
    rows = cut.select("conv_id", "part", F.posexplode("digests").alias("at", "digest"))
    rows = rows.filter(F.col("digest").isNotNull())
    first = rows.groupBy("conv_id", "digest").agg(F.min("part").alias("first_part"))
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first_part")
    late = rows.join(first, same(rows, first, [("conv_id", "c"), ("digest", "d")])).filter(
        "part > first_part"
    )
    late = late.groupBy("part").agg(F.collect_list("at").alias("late"))
    late = late.select(F.col("part").alias("p"), "late")
    slim = cut.select("conv_id", "part", "kinds")
    schema = slim.schema

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for value, places in zip(batch["kinds"].to_pylist(), batch["late"].to_pylist()):
                value = bytearray(value)
                for at in places or []:
                    value[at] = REPEATED
                kinds.append(bytes(value))
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["part"], pa.array(kinds, pa.binary())], names=schema.names
            )

    return slim.join(late, F.col("part") == F.col("p"), "left").drop("p").mapInArrow(mark, schema)


def _by_rows(df: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """``df`` with columns that ``make`` derives from each row's values by name."""
    schema = T.StructType([*df.schema, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            made = [make(row) for row in batch.to_pylist()]
            extra = [pa.array(list(v), arrow.field(f.name).type) for f, v in zip(fields, zip(*made))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return df.mapInArrow(run, schema)


def _folded(df: DataFrame, field: T.StructField, start, make, backward: bool) -> DataFrame:
    """A value carried along each conversation's parts: (part, ``field``).

    Only a few numbers a part pass by, as a stream.
    """
    order = F.col("part").desc() if backward else F.col("part").asc()
    dealt = df.repartition("conv_id").sortWithinPartitions("conv_id", order)
    schema = T.StructType([df.schema["part"], field])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conversation, carried = False, None, None
        arrow = _arrow(schema)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conversation:
                    begun, conversation, carried = True, row["conv_id"], start
                out.append((row["part"], carried))
                carried = make(row, carried)
            if out:
                parts, values = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.int64()), pa.array(list(values), arrow[1].type)], names=schema.names
                )

    return dealt.mapInArrow(fold, schema)


def _settled(kinds: DataFrame, passes: int) -> DataFrame:
    """(part, after): the true cost vector after each part, up to a constant."""
    following = Window.partitionBy("conv_id").orderBy("part")
    end = F.array(*[F.lit(c).cast("long") for c in END])
    guess = F.array(*[F.lit(c).cast("long") for c in GUESS])
    ready = kinds.withColumn("after", F.when(F.col("last"), end).otherwise(guess))
    first = _by_rows(
        ready,
        [T.StructField("before", _VECTOR)],
        lambda r: (list(backwards(r["kinds"], tuple(r["after"]))[1]),),
    )
    # From here on a few numbers a part move; the rows' kinds are read where they lie.
    state = stored(first.select("conv_id", "part", "after", "before"))
    wanted = F.coalesce(F.lead("before").over(following), end)
    for _ in range(passes):
        state = stored(state.withColumn("wanted", wanted))
        stale = state.filter("wanted != after")
        if stale.isEmpty():
            return state.select("part", "after")
        again = kinds.select(F.col("part").alias("p"), "kinds")
        again = again.join(bounded_broadcast(stale), F.col("p") == F.col("part")).drop("p")
        again = _by_rows(
            again,
            [T.StructField("fixed", _VECTOR)],
            lambda r: (list(rerun(r["kinds"], *[tuple(r[c]) for c in ("after", "before", "wanted")])),),
        )
        again = again.select(
            "conv_id", "part", F.col("wanted").alias("after"), F.col("fixed").alias("before")
        )
        state = state.filter("wanted = after").select("conv_id", "part", "after", "before")
        state = stored(state.unionByName(again))
    state = stored(state.withColumn("wanted", wanted))
    open_ones = state.filter("wanted != after").select(F.col("conv_id").alias("c")).distinct()
    pairs = [("conv_id", "c")]
    done = state.join(open_ones, same(state, open_ones, pairs), "left_anti").select("part", "after")
    rest = kinds.join(open_ones, same(kinds, open_ones, pairs), "left_semi")
    rest = _by_rows(rest, [T.StructField("costs", _VECTOR)], lambda r: (matrix(r["kinds"]),))
    exact = _folded(
        rest.select("conv_id", "part", "costs"),
        T.StructField("after", _VECTOR),
        list(END),
        lambda r, after: list(through(r["costs"], tuple(after))),
        True,
    )
    return stored(done.unionByName(exact))


def _stitched(cut: DataFrame, passes: int) -> DataFrame:
    """The parts of conversations that lie in several, traced."""
    kinds = written(_with_late_repeats(cut), "parts")
    ends = kinds.groupBy("conv_id").agg(F.max("part").alias("e")).select("e")
    kinds = kinds.join(bounded_broadcast(ends), F.col("part") == F.col("e"), "left")
    kinds = kinds.withColumn("last", F.col("e").isNotNull()).drop("e")
    after = _settled(kinds, passes)
    after = after.select(F.col("part").alias("p"), "after")
    ready = kinds.join(bounded_broadcast(after), F.col("part") == F.col("p")).drop("p")

    def leads(r):
        seen, _, _ = backwards(r["kinds"], tuple(r["after"]))
        return (states_after(r["kinds"], seen),)

    ready = written(_by_rows(ready, [T.StructField("leads", _VECTOR)], leads), "costs")
    begin = _folded(
        ready.select("conv_id", "part", "leads"), T.StructField("state", T.LongType()), NOTHING,
        lambda r, state: r["leads"][state], False,
    ).select(F.col("part").alias("s"), "state")
    route = ready.join(bounded_broadcast(begin), F.col("part") == F.col("s")).select(
        F.col("part").alias("p"), F.col("kinds").alias("settled"), "after", "state", "last")
    facts = [f.name for f in _PART]
    rows = cut.select("conv_id", *facts, "copies", "roles", "texts").join(
        route, F.col("part") == F.col("p")
    ).drop("p")
    schema = T.StructType([cut.schema["conv_id"], *_PART, *_FIXED])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for r in batch.to_pylist():
                    seen, _, _ = backwards(r["settled"], tuple(r["after"]))
                    *counts, roles, texts = traced(
                        r["settled"], r["copies"], r["roles"], r["texts"], seen, r["state"], r["last"]
                    )
                    yield (
                        (r["conv_id"], *[r[f] for f in facts], *counts, (roles, texts)),
                        sum(map(len, texts)),
                    )
        yield from _emitted(out(), _arrow(schema))

    return rows.mapInArrow(trace, schema)


def repair(
    rows: DataFrame, copies: str | None = None, passes: int = PASSES,
    part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Parts of repaired conversations: one row each, several for very long ones.

    ``rows`` has conv_id, turn, role and text. ``copies`` names a column of how often a
    row stands there; with 0 it only names its conversation. Returns conv_id, part (in
    order), whole (the only part), facts of the rows as they came (rows, turn_low,
    turn_high, turns, initial_first, initial_last, illegal), blank, duplicate, truncated,
    cost, audit and ``repaired``, the rows after the edits as an array of (role, text).
    """
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    stays = n > 0
    units = rows.select(
        "conv_id",
        F.when(stays, F.col("turn").cast("long")).alias("turn"),
        F.when(stays, F.coalesce("role", F.lit(" "))).otherwise("").alias("role"),
        F.when(stays, F.coalesce("text", F.lit(" "))).otherwise("").alias("text"),
        n.alias("copies"),
    )
    units = units.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    visible = F.rtrim("text", F.lit(BLANKS))
    units = units.withColumns(
        {
            "blank": visible == "",
            "cut": ~F.right(visible, F.lit(1)).isin(".", "!", "?"),
            "head": F.left("text", F.lit(HEAD)),
        }
    )
    dealt = units.repartitionByRange("conv_id", "turn", "role", "head").drop("head")
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = written(_packed(dealt, part_rows, part_bytes), "conversations")
    names = ["conv_id", *[f.name for f in _PART], *[f.name for f in _FIXED]]
    whole = parts.filter("whole").select(*names)
    return whole.unionByName(_stitched(parts.filter("NOT whole"), passes))


def lines(repaired: str = "repaired"):
    """The repaired rows of a part as ``role:text`` lines."""
    return F.array_join(
        F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"
    )


def summaries(parts: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``: counts, cost, audit and digest.

    A digest of a conversation is one chain of bytes by its nature: the parts of a long
    one pass through one task as a stream, a part at a time in memory.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.when(F.col("turns") > 0, F.col("turn_high") - F.col("turn_low") + 1 - F.col("turns"))
    whole = parts.filter("whole").select(
        "conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *counts, "audit",
        F.sha2(lines(), 256).alias("repaired_sha256"),
    )
    rest = parts.filter("NOT whole").withColumn("text", lines()).withColumn("n_lines", F.size("repaired"))
    rest = rest.drop("repaired").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = whole.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(state: dict) -> tuple:
            low, high = state["low"], state["high"]
            gaps = 0 if low is None else high - low + 1 - state["turns"]
            return (state["id"], gaps, *[state[c] for c in counts], "".join(state["audit"]),
                    state["sha"].hexdigest())

        def out() -> Iterator[tuple[tuple, int]]:
            state = None
            for batch in batches:
                for r in batch.to_pylist():
                    if state is None or state["id"] != r["conv_id"]:
                        if state:
                            yield done(state), sum(map(len, state["audit"]))
                        state = dict.fromkeys([*counts, "turns", "lines"], 0) | {
                            "id": r["conv_id"], "low": None, "high": None, "initial": None,
                            "audit": [], "sha": hashlib.sha256(),
                        }
                    for c in counts:
                        state[c] += r[c]
                    if r["rows"]:
                        pair = (state["initial"] or "") + r["initial_first"]
                        if state["initial"] is not None and pair not in ("su", "ua", "au"):
                            state["illegal"] += 1
                        state["initial"] = r["initial_last"]
                    if r["turns"]:
                        state["turns"] += r["turns"] - (r["turn_low"] == state["high"])
                        state["low"] = r["turn_low"] if state["low"] is None else state["low"]
                        state["high"] = r["turn_high"]
                    state["audit"].append(r["audit"])
                    if r["n_lines"]:
                        if state["lines"]:
                            state["sha"].update(b"\n")
                        state["sha"].update(r["text"].encode("utf-8", "surrogatepass"))
                        state["lines"] += r["n_lines"]
            if state:
                yield done(state), 0

        yield from _emitted(out(), _arrow(schema))

    return whole.unionByName(rest.mapInArrow(fold, schema))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` modulo 20, and ``copies`` of each.

    0 drops a row (copies 0), 1 empties its text, 2 takes its full stops, exclamation and
    question marks, 3 doubles it, 4 makes it a user's. NULLs count as one space.
    """
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(filled["conv_id"], F.lit(":"), filled["turn"])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(filled["text"], ".!?", "")).otherwise(filled["text"])
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(filled["role"]).alias("role"),
        text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
