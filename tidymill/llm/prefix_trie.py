"""Trie of the prefixes that rebuilt conversations share.

Conversation c is rebuilt from the first h turns of its base, c - c % 100, and its own turns after
its first h; h comes from the checksum of c. No rebuilt conversation is ever put together:

1. Turns are sorted by base, base conversation first, in ranges of even size, and written once. A
   turn is stored there and nowhere else; from now on its place (part, place) stands for it.
2. The fingerprint of a sequence of turns is the pair of its length n and of the sum of x(i) * r**i
   modulo a prime, x(i) being the digest of turn i. Such pairs form a monoid:
   (n, u)(m, v) = (n + m, u + r**n * v). So the fingerprint of a rebuilt prefix is that of the base's
   head times that of a run of own turns, both of which the sorted turns give in passing.
3. What a range needs from those before it are the head of the last base and the last conversation's
   product. Each range is summed up as three runs at most, in one small row; the driver multiplies these.
4. Members with equal depth and fingerprint are a node. A node that more than one stored turn leads to
   is verified: the turns referred to must be equal, and so must the parents. If any node fails,
   everything is done anew with other digests and another r, so the result is exact.
5. Sums over subtrees need no walk over depths: every node belongs to its smallest member, and the
   nodes of a conversation are the lower end of its path. So the sum under a node is the rest of its
   owner's own path plus the whole own paths of all members that own no node down to there.
"""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
import random
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import write_out
from . import _turns

MEMBERS = 100  # conversations with the same c - c % MEMBERS share a base
HEADS = 6  # h is a checksum modulo this
PRIMES = ((1 << 127) - 1,)  # of the first, second, ... try; the last holds for all further ones
IDS_TOGETHER = 4096  # ids of ends that are joined before they meet the rest of their node
DEPTHS_TOGETHER = 1024


@dataclasses.dataclass
class Ring:
    """Products of digests modulo a prime."""

    prime: int
    base: int

    def __post_init__(self):
        self.powers = [pow(self.base, i, self.prime) for i in range(HEADS)]

    def product(self, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
        power = self.powers[left[0]] if left[0] < HEADS else pow(self.base, left[0], self.prime)
        return left[0] + right[0], (left[1] + power * right[1]) % self.prime


def ring(attempt: int, primes: tuple[int, ...] = PRIMES) -> Ring:
    prime = primes[min(attempt, len(primes) - 1)]
    return Ring(prime, random.Random(attempt).randrange(prime // 3, prime))


def base_of(conv: int) -> int:
    """c - c % 100 with the sign of the remainder following c, as in SQL."""
    return conv - (conv % MEMBERS if conv >= 0 else -(-conv % MEMBERS))


def head_size(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % HEADS


@dataclasses.dataclass
class Run:
    """Turns of one conversation in a row: the first few, one by one, and the product of the others."""

    conv: int
    turns: list[tuple]  # (digest, characters, part, place), HEADS - 1 at most
    rest: tuple[int, int] = (0, 0)


@dataclasses.dataclass
class State:
    """What the turns so far leave for those that follow."""

    conv: int | None = None
    count: int = 0  # own turns so far
    own: tuple[int, int] = (0, 0)  # product of the own turns after the first h
    head_of: int | None = None
    head: list[tuple] = dataclasses.field(default_factory=list)  # first turns of the base

    def start(self, conv: int) -> None:
        self.conv, self.count, self.own = conv, 0, (0, 0)
        if conv == base_of(conv):
            self.head_of, self.head = conv, []

    def known_head(self) -> list[tuple]:
        """The turns taken over from the base; the base itself is rebuilt from its own turns alone."""
        base = base_of(self.conv)
        return [] if base == self.conv or base != self.head_of else self.head[: head_size(self.conv)]

    def skipped(self) -> int:
        return 0 if self.conv == base_of(self.conv) else head_size(self.conv)

    def add(self, turn: tuple, in_ring: Ring) -> bool:
        """Take the next own turn; whether it is part of the rebuilt conversation."""
        if self.conv == self.head_of and len(self.head) < HEADS - 1:
            self.head.append(turn)
        self.count += 1
        if self.count <= self.skipped():
            return False
        self.own = in_ring.product(self.own, (1, turn[0] % in_ring.prime))
        return True

    def add_run(self, run: Run, in_ring: Ring) -> None:
        if run.conv != self.conv:
            self.start(run.conv)
        for turn in run.turns:
            self.add(turn, in_ring)
        self.own = in_ring.product(self.own, run.rest)
        self.count += run.rest[0]


def summary(turns: Iterator[tuple], in_ring: Ring) -> list[Run]:
    """The runs of a part that matter to those after it: the first, the last base's, the last."""
    first = base = last = None
    power = 1
    for conv, turn in turns:
        if last is None or last.conv != conv:
            last = Run(conv, [])
            first = first or last
            base = last if conv == base_of(conv) else base
            power = 1
        if len(last.turns) < HEADS - 1:
            last.turns.append(turn)
        else:  # the product with one more turn, with the power at hand
            last.rest = last.rest[0] + 1, (last.rest[1] + power * turn[0]) % in_ring.prime
            power = power * in_ring.base % in_ring.prime
    found: list[Run] = []
    for run in (first, base, last):
        if run is not None and all(run is not other for other in found):
            found.append(run)
    return found


_MEMBERS = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()),
    ("chars", pa.int64()), ("own", pa.bool_()), ("end", pa.bool_()), ("part", pa.int64()), ("place", pa.int64()),
])
MEMBERS_SCHEMA = (
    "conv_id long, depth long, key binary, parent binary, chars long, own boolean, end boolean, part long, place long"
)
_RUNS = pa.schema([("part", pa.int64()), ("run", pa.int64()), ("conv_id", pa.int64()), ("turns", pa.binary()),
                   ("rest_length", pa.int64()), ("rest", pa.binary())])


def _wide(value: int) -> bytes:
    return value.to_bytes(16, "big")


def memberships(turns: Iterator[tuple], state: State, following: int | None, in_ring: Ring) -> Iterator[tuple]:
    """A record per rebuilt conversation and depth, and one for its end, of a part's turns in order.

    ``following`` is the conversation that the next part begins with. A depth taken from the base
    refers to the base's stored turn.
    """
    key = parent = b""
    started = False  # a conversation that the part before ended is not ended again

    def opened() -> Iterator[tuple]:
        nonlocal key, parent
        product, parent, key = (0, 0), None, _wide(0)
        yield state.conv, 0, key, None, 0, False, False, None, None
        for turn in state.known_head():
            product = in_ring.product(product, (1, turn[0] % in_ring.prime))
            parent, key = key, _wide(product[1])
            yield state.conv, product[0], key, parent, turn[1], False, False, turn[2], turn[3]

    def head_product() -> tuple[int, int]:
        product = (0, 0)
        for turn in state.known_head():
            product = in_ring.product(product, (1, turn[0] % in_ring.prime))
        return product

    def closed() -> tuple:
        length, value = in_ring.product(head, state.own)
        return state.conv, length, _wide(value), None, 0, False, True, None, None

    head = (0, 0)
    if state.conv is not None:
        head = head_product()
        key = _wide(in_ring.product(head, state.own)[1])
    power = pow(in_ring.base, state.own[0], in_ring.prime)
    for conv, turn in turns:
        if conv != state.conv:
            if started:
                yield closed()
            state.start(conv)
            yield from opened()
            head, power = head_product(), 1
        started = True
        if state.conv == state.head_of and len(state.head) < HEADS - 1:
            state.head.append(turn)
        state.count += 1
        if state.count > state.skipped():
            state.own = state.own[0] + 1, (state.own[1] + power * turn[0]) % in_ring.prime
            power = power * in_ring.base % in_ring.prime
            length, value = in_ring.product(head, state.own)
            parent, key = key, _wide(value)
            yield state.conv, length, key, parent, turn[1], True, False, turn[2], turn[3]
    if started and state.conv != following:
        yield closed()


def stored_turns(conversations: DataFrame) -> DataFrame:
    """Turns in the order of step 1, with digests. Turns of a conversation with equal ``turn`` are ordered
    by role and text; rows without ``conv_id`` belong to no conversation and are left out."""
    turns = _turns.columns(conversations).where(F.col("conv_id").isNotNull())
    base = F.col("conv_id") - F.col("conv_id") % MEMBERS
    keys = [base.asc(), (F.col("conv_id") != base).asc(), F.col("conv_id").asc(), F.col("turn").asc_nulls_first(),
            F.col("role").asc(), F.col("text").asc()]
    return _turns.in_order(turns.withColumn("digest", _digest(0)), keys, "turns")


def _digest(attempt: int):
    whole = F.concat_ws(":", F.lit(str(attempt)), F.length("role").cast("string"), F.col("role"), F.col("text"))
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def _passing(stored: DataFrame, attempt: int) -> DataFrame:
    digest = F.col("digest") if attempt == 0 else _digest(attempt)
    return _turns.part_by_part(stored.select(
        "part", "place", "conv_id", digest.alias("digest"), F.length("text").cast("long").alias("chars"),
    ))


def _turns_of(rows: Iterator[tuple], in_ring: Ring) -> Iterator[tuple[int, tuple]]:
    for part, place, conv, digest, chars in rows:
        yield conv, (int.from_bytes(digest, "big") % in_ring.prime, chars, part, place)


def _by_part(rows: Iterator[tuple]) -> Iterator[tuple[int, Iterator[tuple]]]:
    return itertools.groupby(rows, key=lambda row: row[0])


def members(stored: DataFrame, attempt: int = 0, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """The written table of memberships (see ``memberships``)."""
    passing = _passing(stored, attempt)

    def sum_up(batches):
        in_ring = ring(attempt, primes)

        def records():
            for part, rows in _by_part(_turns.rows(batches)):
                for i, run in enumerate(summary(_turns_of(rows, in_ring), in_ring)):
                    packed = b"".join(_wide(t[0]) + b"".join(x.to_bytes(8, "big") for x in t[1:]) for t in run.turns)
                    yield part, i, run.conv, packed, run.rest[0], _wide(run.rest[1])

        yield from _turns.batches_of(records(), _RUNS)

    schema = "part long, run long, conv_id long, turns binary, rest_length long, rest binary"
    runs: dict[int, list[Run]] = {}
    for r in sorted(passing.mapInArrow(sum_up, schema).collect(), key=lambda r: (r.part, r.run)):
        packed, turns = bytes(r.turns), []
        for at in range(0, len(packed), 40):
            turns.append((int.from_bytes(packed[at : at + 16], "big"),
                          *(int.from_bytes(packed[at + 16 + 8 * i : at + 24 + 8 * i], "big") for i in range(3))))
        runs.setdefault(r.part, []).append(Run(r.conv_id, turns, (r.rest_length, int.from_bytes(bytes(r.rest), "big"))))

    # One small state a part, for the parts of the range shuffle.
    state, in_ring, before, order = State(), ring(attempt, primes), {}, sorted(runs)
    for i, part in enumerate(order):
        following = runs[order[i + 1]][0].conv if i + 1 < len(order) else None
        before[part] = dataclasses.replace(state, head=list(state.head)), following
        for run in runs[part]:
            state.add_run(run, in_ring)

    def emit(batches):
        in_ring = ring(attempt, primes)

        def records():
            for part, rows in _by_part(_turns.rows(batches)):
                known, following = before[part]
                known = dataclasses.replace(known, head=list(known.head))
                yield from memberships(_turns_of(rows, in_ring), known, following, in_ring)

        yield from _turns.batches_of(records(), _MEMBERS)

    return write_out(passing.mapInArrow(emit, MEMBERS_SCHEMA), "members")


def group_nodes(found: DataFrame) -> DataFrame:
    """The written table of nodes: one row per depth and fingerprint."""
    nodes = found.where(~F.col("end")).groupBy("depth", "key").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"),
        F.max("parent").alias("other_parent"), F.min("chars").alias("chars"), F.max("chars").alias("other_chars"),
        F.sum(F.col("own").cast("long")).alias("n_stored"),
    )
    return write_out(nodes, "nodes")


def clashes(found: DataFrame, nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Nodes whose members differ: in their parents, or in the stored turns that lead to them.

    Turns taken from a base refer to the base's own, so each stored turn is looked at once."""
    apart = nodes.where((F.col("parent") != F.col("other_parent")) | (F.col("chars") != F.col("other_chars")))
    shared = nodes.where("n_stored > 1").select("depth", "key")
    turn = F.struct("role", "text")
    unequal = (
        found.where("own").select("depth", "key", "part", "place").join(shared, ["depth", "key"], "left_semi")
        .join(stored.select("part", "place", "role", "text"), ["part", "place"])
        .groupBy("depth", "key").agg(F.min(turn).alias("least"), F.max(turn).alias("most"))
        .where(F.col("least") != F.col("most"))
    )
    return apart.select("depth", "key").union(unequal.select("depth", "key"))


def _suffix_sums(df: DataFrame, names: list[str]) -> DataFrame:
    """Add ``<name>_down``: the sum over the rows of the same ``conv_id`` at this depth or below.

    Depths of a conversation come without gaps. Windows hold DEPTHS_TOGETHER rows, or one row for as many."""
    df = df.withColumn("__block", F.floor(F.col("depth") / DEPTHS_TOGETHER).cast("long"))
    down = Window.partitionBy("conv_id", "__block").orderBy(F.desc("depth"))
    blocks = df.where("__block > 0").groupBy("conv_id", "__block").agg(*[F.sum(n).alias(n) for n in names])
    over = Window.partitionBy("conv_id").orderBy(F.desc("__block"))
    after = blocks.select(
        "conv_id", (F.col("__block") - 1).alias("__block"), *[F.sum(n).over(over).alias(f"__{n}") for n in names]
    )
    summed = df.withColumns({f"{n}_down": F.sum(n).over(down) for n in names}).join(after, ["conv_id", "__block"], "left")
    sums = {f"{n}_down": F.col(f"{n}_down") + F.coalesce(f"__{n}", F.lit(0)) for n in names}
    return summed.withColumns(sums).drop("__block", *[f"__{n}" for n in names])


def ends(found: DataFrame) -> DataFrame:
    """``depth, key, ends_sha256``: digest of the sorted ids of the conversations that end at a node.

    A digest of a text is read from its start, so the ids of a node meet in one task; they come there
    as texts of some thousand ids each and are not held together."""
    keys = ["depth", "key", "conv_id"]
    sorted_ends = found.where("end").select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def join_ids(batches):
        def records():
            node, first, ids = None, None, []
            for depth, key, conv in _turns.rows(batches):
                if node != (depth, key) or len(ids) == IDS_TOGETHER:
                    if ids:
                        yield *node, first, ",".join(ids)
                    node, first, ids = (depth, key), conv, []
                ids.append(str(conv))
            if ids:
                yield *node, first, ",".join(ids)

        schema = pa.schema([("depth", pa.int64()), ("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
        yield from _turns.batches_of(records(), schema, 64)

    def digest(batches):
        def records():
            node = hashed = None
            for depth, key, _, ids in _turns.rows(batches):
                if node == (depth, key):
                    hashed.update(b"," + ids.encode())
                else:
                    if node:
                        yield *node, hashed.hexdigest()
                    node, hashed = (depth, key), hashlib.sha256(ids.encode())
            if node:
                yield *node, hashed.hexdigest()

        schema = pa.schema([("depth", pa.int64()), ("key", pa.binary()), ("ends_sha256", pa.string())])
        yield from _turns.batches_of(records(), schema)

    joined = sorted_ends.mapInArrow(join_ids, "depth long, key binary, first long, ids string")
    together = joined.repartition("depth", "key").sortWithinPartitions("depth", "key", "first")
    return together.mapInArrow(digest, "depth long, key binary, ends_sha256 string")


def trie(conversations: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Null roles and texts count as empty, turns that are null come first, repeated rows are turns of
    their own, and a conversation may be rebuilt to nothing (it then ends at the root). An empty table,
    or one without ids, has no nodes. Other columns are not read.
    """
    stored = stored_turns(conversations)
    attempt = 0
    while True:
        found = members(stored, attempt, primes)
        nodes = group_nodes(found)
        if clashes(found, nodes, stored).isEmpty():
            break
        attempt += 1
    at = ["depth", "key"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"),
                           F.col("conv_id").alias("parent_conv_id"))
    weighed = nodes.drop("other_parent", "other_chars", "n_stored").join(children, at, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("chars"),
    }).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    weighed = write_out(_suffix_sums(weighed, ["saved", "leaf"]), "weighed")
    owners = weighed.groupBy("conv_id").agg(
        F.min("depth").alias("from_depth"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")
    ).where("saved > 0 OR leaf > 0")
    above = (
        found.where(~F.col("end")).select("conv_id", *at).join(owners, "conv_id").where("depth < from_depth")
        .groupBy(*at).agg(F.sum("saved").alias("saved_above"), F.sum("leaf").alias("leaf_above"))
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        weighed.join(parents, ["depth", "parent"], "left").join(above, at, "left").join(ends(found), at, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            (F.col("leaf_down") + F.coalesce("leaf_above", F.lit(0))).alias("n_leaves"),
            (F.col("saved_down") + F.coalesce("saved_above", F.lit(0))).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


# The checksum of the decimal digits of a number, by a table of 256 entries computed in place.
CRC_TABLE_SQL = """(SELECT list_transform(range(256), lambda i: list_reduce(
    list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_table)"""


def crc_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of an ASCII text, next to ``crc_table``."""
    characters = f"list_transform(range(length({text})), lambda i: ascii(substr({text}, (i + 1)::INT, 1))::BIGINT)"
    step = "lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {characters}), {step}), 4294967295)"


def trie_sql() -> str:
    """The same by the prefixes themselves as keys; for small tables."""
    return f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, n, conv_id - conv_id % {MEMBERS} AS base, {crc_sql("conv_id::VARCHAR")} % {HEADS} AS h
    FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), {CRC_TABLE_SQL}
), rebuilt AS (
    SELECT c.conv_id, t.i AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
    UNION ALL
    SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.i - c.h, role, text
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h LEFT JOIN convs b ON b.conv_id = c.base
), whole AS (
    SELECT c.conv_id, coalesce(r.path, []) AS path
    FROM convs c LEFT JOIN (
        SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY depth) AS path FROM rebuilt GROUP BY conv_id
    ) r USING (conv_id)
), prefixes AS (
    SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path FROM whole
), nodes AS (
    SELECT path[1:depth] AS path, depth, count(*) AS n_convs, min(conv_id) AS conv_id,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len(path)), '') AS ends
    FROM prefixes GROUP BY ALL
), children AS (
    SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), weighed AS (
    SELECT n.*, coalesce(k.n_children, 0) AS n_children,
        CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.path[n.depth].text) END AS saved
    FROM nodes n LEFT JOIN children k ON k.path = n.path
), under AS (
    SELECT path[1:a] AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(depth + 1)) AS a FROM weighed) GROUP BY ALL
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves,
    u.saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM weighed w JOIN under u ON u.path = w.path
LEFT JOIN nodes p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.path = w.path[1:w.depth - 1]
"""
