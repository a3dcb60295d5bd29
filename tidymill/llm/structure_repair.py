"""Cheapest repair of damaged conversations, with an audit of the edits.

A repaired conversation reads, by the initials of its roles, ``(s?(ua)+)?``. Each row is kept,
given another role or deleted, and empty turns may be inserted anywhere; among the cheapest edits
those count whose letters come first in ASCII order.

The search is a shortest path in a graph without cycles: its nodes are the states of the pattern
before each row. A path's weight is one whole number. Its high digits are the cost, the low digits
of fixed width are the letters of the edits in order, from the highest digit down, with zeros behind
the last, so the plain minimum of integers decides cost and ties. Rows are gone through from the
last to the first: an edit in front shifts the letters behind it by one digit and keeps their order.

On Spark: damaged rows are sorted in ranges of even size and written once. A conversation that lies
within a range and is not too long is finished where its rows pass by. What crosses a range, or
is longer, is cut into segments of some hundred rows. A segment is solved for each pair of states
at its borders; the small tables of all segments of a conversation are then gone through from the
last to the first, where the letters of what follows are one more digit, their rank. Rows of a
segment are the same whatever the path, and a segment ends with a row, so no segment's letters are
the start of another solution's and the order within it holds for the whole.
"""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import write_out
from . import _turns
from .prefix_trie import CRC_TABLE_SQL, crc_sql

SEGMENT_ROWS = 256
LETTERS = " DIKR"  # the digit of a letter is its place here: ASCII order
_DIGIT = 3  # bits of a digit
_D, _I, _K, _R = 1, 2, 3, 4

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)  # first fault of a row
# States of the pattern: nothing yet, after the system turn, after a user's, after an assistant's.
STATES = range(4)
EXPECTED = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
LEGAL = {"su", "ua", "au"}


@dataclasses.dataclass(frozen=True)
class Costs:
    """What the edits cost; keeping a row costs nothing."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # for a truncated row that is not deleted


def tails(costs: Costs) -> list[tuple[int, str]]:
    """Cost and letters of the insertions that end a conversation in each state."""
    return [(0, ""), (2 * costs.insert, "II"), (costs.insert, "I"), (0, "")]


def solve(rows: list[tuple[str, int]], after: list[tuple[int, int] | None], costs: Costs) -> list[tuple | None]:
    """For each state before the rows the least (cost, letters, state after them), None without a way.

    ``rows`` are (initial, first fault); ``after`` gives for each state behind the last row the cost of
    what follows and the rank of its letters among the four states, or None where there is no way. The
    cost includes what follows, the letters do not.
    """
    width = 3 * len(rows) + 1  # two insertions and an edit a row at most, and the rank behind them
    low, top = _DIGIT * width, _DIGIT * (width - 1)
    mask = (1 << low) - 1

    def before(letter: int, cost: int, weight: int) -> int:
        return ((weight >> low) + cost << low) | letter << top | (weight & mask) >> _DIGIT

    # (weight, last state); the state decides nothing, as equal weights have equal letters and ranks.
    ways = [None if a is None else (a[0] << low | a[1] << top, state) for state, a in enumerate(after)]
    for initial, fault in reversed(rows):
        more = costs.truncated if fault == TRUNCATED else 0
        edited: list[tuple[int, int] | None] = []
        for state in STATES:
            found = []
            if ways[state] is not None:
                found.append((before(_D, costs.delete, ways[state][0]), ways[state][1]))
            if fault in (NONE, TRUNCATED):
                kept, named = ways[KEPT[state, initial]] if (state, initial) in KEPT else None, ways[NEXT[state]]
                if kept is not None:
                    found.append((before(_K, more, kept[0]), kept[1]))
                if named is not None:
                    found.append((before(_R, costs.rerole + more, named[0]), named[1]))
            edited.append(min(found, default=None))
        ways = []
        for state in STATES:  # a third insertion would lead where the first did
            found, one, two = [edited[state]], edited[NEXT[state]], edited[NEXT[NEXT[state]]]
            if one is not None:
                found.append((before(_I, costs.insert, one[0]), one[1]))
            if two is not None:
                found.append((before(_I, costs.insert, before(_I, costs.insert, two[0])), two[1]))
            ways.append(min((f for f in found if f is not None), default=None))
    return [None if w is None else (w[0] >> low, _letters(w[0] & mask, top, len(rows)), w[1]) for w in ways]


def _letters(digits: int, top: int, n_rows: int) -> str:
    """The letters from the highest digit down, until each row has had its edit."""
    found = []
    while n_rows:
        letter = digits >> top & 7
        found.append(LETTERS[letter])
        n_rows -= letter != _I
        top -= _DIGIT
    return "".join(found)


def ranks(texts: list) -> list[int]:
    order = sorted({t for t in texts if t is not None})
    return [0 if t is None else order.index(t) for t in texts]


def at_the_end(costs: Costs) -> list[tuple[int, int]]:
    ends = tails(costs)
    return [(cost, rank) for (cost, _), rank in zip(ends, ranks([letters for _, letters in ends]))]


def repaired_lines(rows: list[tuple[str, str]], letters: str, state: int) -> list[str]:
    """``role:text`` of what the edits leave, the first row met in the given state."""
    lines, at = [], 0
    for letter in letters:
        if letter != "I":
            role, text = rows[at]
            at += 1
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = KEPT[state, role[0]]
        elif letter != "D":
            lines.append(f"{EXPECTED[state]}:{text if letter == 'R' else ''}")
            state = NEXT[state]
    return lines


@dataclasses.dataclass
class Counts:
    """What is counted of rows in a row; two such put together are one."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0  # distinct ones
    least: int | None = None
    most: int | None = None
    first: str | None = None  # initials
    last: str | None = None

    def add(self, other: Counts) -> Counts:
        """This and what follows it. Turns rise, so only the border can hold one twice."""
        border = int(self.last is not None and other.first is not None and self.last + other.first not in LEGAL)
        same = int(self.most is not None and self.most == other.least)
        return Counts(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + border, self.turns + other.turns - same,
            other.least if self.least is None else self.least, self.most if other.most is None else other.most,
            other.first if self.first is None else self.first, self.last if other.last is None else other.last,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def count(turn: int | None, initial: str, fault: int) -> Counts:
    return Counts(int(fault == BLANK), int(fault == DUPLICATE), int(fault == TRUNCATED), 0, int(turn is not None),
                  turn, turn, initial, initial)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows that damage leaves, before their texts are changed: ``conv_id, turn, role, text, code``.

    The code is the checksum of ``conv_id:turn`` modulo 20: 0 drops a row and 3 doubles it (both done
    here), 1 empties its text, 2 takes out its ``[.!?]``, 4 makes it the user's. Nulls read as a space."""
    turns = _turns.columns(conversations, " ")
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    copies = F.explode(F.array_repeat(F.lit(True), F.when(F.col("code") == 3, 2).otherwise(1)))
    return turns.withColumn("code", code.cast("int")).where("code != 0").withColumn("__c", copies).drop("__c")


def _after_damage() -> tuple[Column, Column]:
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return role.alias("role"), text.alias("text")


def in_order(rows: DataFrame) -> DataFrame:
    """Damaged rows by turn (null first), then by role and text as they were, written once.

    A text without its white space at the end tells faults: nothing left is blank, and truncated is
    what then does not end in one of ``.!?``."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    placed = _turns.in_order(rows, keys, "damaged-turns")
    return placed.select("part", "place", "conv_id", "turn", *_after_damage())


def repeats(placed: DataFrame) -> DataFrame:
    """``part, place`` of the rows whose role and text occur earlier in their conversation.

    Texts are told apart by 256-bit digests; the first places combine before the shuffle, so a turn that
    is said over and over is a row a task."""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = placed.select("part", "place", "conv_id", F.unhex(F.sha2(whole, 256)).alias("digest"))
    firsts = turns.groupBy(F.col("conv_id").alias("__conv"), F.col("digest").alias("__digest")).agg(
        F.min(F.struct("part", "place")).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("digest") == F.col("__digest"))
    return turns.join(firsts, same).where(F.struct("part", "place") != F.col("first")).select("part", "place")


_FOUND = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ("costs", pa.list_(pa.int64())), ("letters", pa.list_(pa.string())), ("sha256", pa.string()),
])
_FOUND_DDL = (
    "conv_id long, part long, place long, whole boolean, n long, blank long, duplicate long, truncated long, "
    "illegal long, turns long, least long, most long, first string, last string, costs array<long>, "
    "letters array<string>, sha256 string"
)


def _segments(rows: Iterator[tuple]) -> Iterator[tuple[bool, list[tuple]]]:
    """Rows of a part as (whole, rows of one conversation); ``whole`` if it surely has no others."""
    held: list[tuple] = []
    cut, at_start = False, True
    for row in rows:
        if held and row[2] != held[0][2]:
            yield not cut and not at_start, held
            held, cut, at_start = [], False, False
        elif len(held) == SEGMENT_ROWS:
            yield False, held
            held, cut = [], True
        held.append(row)
    if held:
        yield False, held


def pass_by(placed: DataFrame, costs: Costs) -> DataFrame:
    """Whole conversations solved, and segments solved between all states; written once."""
    fault = (
        F.when(F.col("cut") == "", BLANK).when(~F.substring("cut", -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    )
    rows = placed.withColumn("cut", F.rtrim("text", F.lit(" \t\n\x0b\f\r"))).select(
        "part", "place", "conv_id", "turn", "role", "text", fault.alias("fault")
    )
    marks = repeats(placed).select("part", "place", *[
        F.lit(None).cast(kind).alias(c)
        for c, kind in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "int"))
    ])
    # A mark comes just before its row.
    merged = rows.withColumn("kind", F.lit(1)).union(marks.withColumn("kind", F.lit(0)))
    merged = merged.repartition("part").sortWithinPartitions("part", "place", "kind")

    def marked(stream):
        repeated = False
        for part, place, conv, turn, role, text, fault, kind in stream:
            if kind:
                yield part, place, conv, turn, role, text, DUPLICATE if repeated and fault != BLANK else fault
            repeated = not kind

    def run(batches):
        end = at_the_end(costs)

        def records():
            for _, part in itertools.groupby(marked(_turns.rows(batches)), key=lambda row: row[0]):
                for whole, rows in _segments(part):
                    counts = Counts()
                    for row in rows:
                        counts = counts.add(count(row[3], row[4][:1], row[6]))
                    steps = [(row[4][:1], row[6]) for row in rows]
                    digest = None
                    if whole:
                        cost, letters, last = solve(steps, end, costs)[0]
                        lines = repaired_lines([row[4:6] for row in rows], letters, 0)
                        tail = tails(costs)[last][1]
                        lines += inserted(last, tail)
                        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
                        table = [(cost, letters + tail)]
                    else:
                        ways = [solve(steps, [(0, 0) if s == to else None for s in STATES], costs) for to in STATES]
                        table = [ways[to][s] or (None, None) for s in STATES for to in STATES]
                    yield (
                        rows[0][2], rows[0][0], rows[0][1], whole, len(rows), *dataclasses.astuple(counts),
                        [t[0] for t in table], [t[1] for t in table], digest,
                    )

        yield from _turns.batches_of(records(), _FOUND, 1024)

    return write_out(merged.mapInArrow(run, _FOUND_DDL), "repairs")


def inserted(state: int, letters: str) -> list[str]:
    lines = []
    for _ in letters:
        lines.append(f"{EXPECTED[state]}:")
        state = NEXT[state]
    return lines


_CHOSEN = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("state", pa.int64()),
    ("letters", pa.string()), ("tail", pa.bool_()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
])
_CHOSEN_DDL = (
    "conv_id long, part long, place long, n long, state long, letters string, tail boolean, gaps long, blank long, "
    "duplicate long, truncated long, illegal long, cost long, audit string"
)


def choose(found: DataFrame, costs: Costs) -> DataFrame:
    """The edits of each segment, by way of the segments of a conversation from the last to the first.

    A task holds a letter a row and state of the conversation at hand, as long as the audit that it
    returns; the first segment carries what is told of the whole conversation."""
    segments = found.where("NOT whole").repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc(), F.col("part").desc(), F.col("place").desc()
    )

    def run(batches):
        ends = tails(costs)

        def records():
            for conv, rows in itertools.groupby(_turns.rows(batches), key=lambda row: row[0]):
                after, counts, held = at_the_end(costs), Counts(), []
                for row in rows:
                    table = list(zip(row[14], row[15]))
                    counts = Counts(*row[5:14]).add(counts)
                    best = []
                    for state in STATES:
                        ways = [
                            (cost + after[to][0], letters, after[to][1], to)
                            for to, (cost, letters) in enumerate(table[4 * state : 4 * state + 4])
                            if cost is not None and after[to] is not None
                        ]
                        best.append(min(ways, default=None))
                    order = ranks([None if b is None else b[1:3] for b in best])
                    after = [None if b is None else (b[0], rank) for b, rank in zip(best, order)]
                    held.append((row[1], row[2], row[4], [None if b is None else (b[1], b[3]) for b in best]))
                state, cost, chosen = 0, after[0][0], []
                for part, place, n, best in reversed(held):
                    letters, to = best[state]
                    chosen.append((part, place, n, state, letters))
                    state = to
                tail = ends[state][1]
                whole = "".join(c[4] for c in chosen) + tail
                for i, (part, place, n, begin, letters) in enumerate(chosen):
                    told = (counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, whole)
                    last = i == len(chosen) - 1
                    yield (conv, part, place, n, begin, letters + tail * last, last, *(told if i == 0 else [None] * 7))

        yield from _turns.batches_of(records(), _CHOSEN, 1024)

    return write_out(segments.mapInArrow(run, _CHOSEN_DDL), "chosen")


def repaired_texts(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """``conv_id, part, place, piece``: the lines that a segment leaves, null if none.

    Only the rows of conversations with segments are read on; each segment's edits come before its rows."""
    wanted = chosen.select("part", F.col("conv_id").alias("__conv")).distinct()
    same = (placed["part"] == wanted["part"]) & F.col("conv_id").eqNullSafe(F.col("__conv"))
    nothing = [F.lit(None).cast("long").alias("state"), F.lit(None).cast("string").alias("letters")]
    rows = placed.join(wanted, same, "left_semi").select("part", "place", F.lit(1).alias("kind"), "conv_id", "role", "text",
                                                         *nothing)
    empty = [F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")]
    edits = chosen.select("part", "place", F.lit(0).alias("kind"), "conv_id", *empty, "state", "letters")
    merged = edits.union(rows.select(*edits.columns)).repartition("part").sortWithinPartitions("part", "place", "kind")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("piece", pa.string())])

    def run(batches):
        def finished(edit, rows):
            lines = repaired_lines(rows, edit[7], edit[6])
            return edit[3], edit[0], edit[1], "\n".join(lines) if lines else None

        def records():
            edit, rows = None, []
            for row in _turns.rows(batches):
                if row[2] == 0:
                    if edit is not None:
                        yield finished(edit, rows)
                    edit, rows = row, []
                else:
                    rows.append(row[4:6])
            if edit is not None:
                yield finished(edit, rows)

        yield from _turns.batches_of(records(), schema, 16)

    return merged.mapInArrow(run, "conv_id long, part long, place long, piece string")


def text_digests(pieces: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` from the pieces in order. A digest is read from its start, so a
    conversation's pieces meet in one task, one after the other."""
    together = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        def records():
            for conv, rows in itertools.groupby(_turns.rows(batches), key=lambda row: row[0]):
                hashed, begun = hashlib.sha256(), False
                for *_, piece in rows:
                    if piece is not None:
                        hashed.update(b"\n" * begun + piece.encode())
                        begun = True
                yield conv, hashed.hexdigest()

        yield from _turns.batches_of(records(), schema)

    return together.mapInArrow(run, "conv_id long, repaired_sha256 string")


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text, code`` as from ``damaged``): its
    ``gaps``, rows by first fault (``blank, duplicate, truncated``), ``illegal`` neighbours, least
    ``cost``, ``audit`` and ``repaired_sha256``.

    A role without a first character fits nowhere, so such a row is deleted or given another role.
    Rows without ``conv_id`` are a conversation of their own; an empty table gives an empty one.
    """
    if costs.insert <= 0:
        raise ValueError("insertions must cost something")
    placed = in_order(rows)
    found = pass_by(placed, costs)
    chosen = choose(found, costs)
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = found.where("whole").select(
        "conv_id", gaps, "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"),
        F.col("letters")[0].alias("audit"), F.col("sha256").alias("repaired_sha256"),
    )
    digests = text_digests(repaired_texts(placed, chosen)).withColumnRenamed("conv_id", "__conv")
    parts = chosen.where("cost IS NOT NULL").join(digests, F.col("conv_id").eqNullSafe(F.col("__conv")))
    return whole.unionByName(parts.select(*RESULT))


def damage_and_repair(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Damage the rows and repair what is left; one row for every ``conv_id`` there was, null among them.
    A conversation without rows after the damage has zeros, no letters and the digest of nothing. Other
    columns are not read."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("__id")).distinct()
    repaired = repair(damaged(conversations), costs)
    joined = ids.join(repaired, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    nothing = {c: F.coalesce(c, F.lit(0)) for c in RESULT[1:7]} | {
        "audit": F.coalesce("audit", F.lit("")),
        "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())),
    }
    return joined.withColumns(nothing).withColumn("conv_id", F.col("__id")).select(*RESULT)


def repair_sql() -> str:
    """The same as SQL, with the solutions as pairs of cost and letters; for small tables."""
    c = Costs()
    inserts = ", ".join(
        f"({s}, {s}, 0, ''), ({s}, {NEXT[s]}, {c.insert}, 'I'), ({s}, {NEXT[NEXT[s]]}, {2 * c.insert}, 'II')" for s in STATES
    )
    kept = ", ".join(f"({s}, '{initial}', {to})" for (s, initial), to in KEPT.items())
    named = ", ".join(f"({s}, {NEXT[s]})" for s in STATES)
    ends = ", ".join(f"({s}, {cost}, '{letters}')" for s, (cost, letters) in enumerate(tails(c)))
    white = r"e' \t\n\x0b\f\r'"
    return f"""
WITH RECURSIVE source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named FROM conversations
), coded AS (
    SELECT s.*, {crc_sql("named")} % 20 AS code FROM source s, {CRC_TABLE_SQL}
), changed AS (
    SELECT conv_id, turn, role AS old_role, text AS old_text, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded WHERE code <> 0
), numbered AS (
    SELECT *, coalesce(conv_id::VARCHAR, ' ') AS k, rtrim(text, {white}) AS cut,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, old_role, old_text, copy) AS i
    FROM changed
), faults AS (
    SELECT *, CASE WHEN cut = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS last_role
    FROM numbered
), counts AS (
    SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE left(last_role, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY k
), inserts(state, via, price, letters) AS (VALUES {inserts}
), kept(state, initial, next) AS (VALUES {kept}
), named(state, next) AS (VALUES {named}
), tails(state, price, letters) AS (VALUES {ends}
), steps AS (
    SELECT k, i, state, state AS next, {c.delete} AS price, 'D' AS letter FROM faults, named
    UNION ALL
    SELECT k, i, state, next, CASE WHEN fault = 'truncated' THEN {c.truncated} ELSE 0 END, 'K'
    FROM faults JOIN kept ON initial = left(role, 1) WHERE fault IN ('', 'truncated')
    UNION ALL
    SELECT k, i, state, next, {c.rerole} + CASE WHEN fault = 'truncated' THEN {c.truncated} ELSE 0 END, 'R'
    FROM faults, named WHERE fault IN ('', 'truncated')
), paths AS (
    SELECT k, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM counts
    UNION ALL
    SELECT p.k, p.i + 1, s.next, min({{'cost': p.best.cost + n.price + s.price, 'audit': p.best.audit || n.letters || s.letter}})
    FROM paths p JOIN inserts n ON n.state = p.state JOIN steps s ON s.k = p.k AND s.i = p.i + 1 AND s.state = n.via
    GROUP BY p.k, p.i, s.next
), solved AS (
    SELECT p.k, min({{'cost': p.best.cost + t.price, 'audit': p.best.audit || t.letters}}) AS best
    FROM paths p JOIN counts c ON c.k = p.k AND c.n = p.i JOIN tails t ON t.state = p.state GROUP BY p.k
), letters AS (
    SELECT k, pos, substr(best.audit, pos::INT, 1) AS letter,
        length(replace(left(best.audit, pos::INT), 'I', '')) AS i
    FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS pos FROM solved)
), lines AS (
    SELECT l.k, pos, letter, role, text, row_number() OVER w AS m,
        max(CASE WHEN letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.k) AS headed
    FROM letters l LEFT JOIN numbered r ON r.k = l.k AND r.i = l.i AND letter <> 'I' WHERE letter <> 'D'
    WINDOW w AS (PARTITION BY l.k ORDER BY pos)
), repaired AS (
    SELECT k, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS text
    FROM lines GROUP BY k
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.best.cost, 0) AS cost,
    coalesce(s.best.audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k FROM conversations) o
LEFT JOIN counts c ON c.k = o.k LEFT JOIN solved s ON s.k = o.k LEFT JOIN repaired r ON r.k = o.k
"""
