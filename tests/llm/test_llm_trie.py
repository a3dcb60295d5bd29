"""The prefix trie against plain Python over rebuilt conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidymill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, part int"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, final = defaultdict(list), defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        final[path].append(conv)
    found = []
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = {p for p in under if len(p) == len(path) + 1}
        leaves = sum(not any(q[:-1] == p for q in under if len(q) == len(p) + 1) for p in under)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        ids = ",".join(map(str, sorted(final.get(path, []))))
        found.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids), leaves,
                      saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(found, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.trie(df, **kw).collect()), key=str)


def made(seed, convs, longest, words=2):
    rng = random.Random(seed)
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, longest)):
            rows.append((conv, rng.choice([turn, turn, None, 7]), rng.choice(["user", "assistant", None, ""]),
                         rng.choice(["a", "bé", None, "", "👍c"][:words + 1])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations(spark, seed):
    convs = random.Random(seed).sample([*range(0, 12), *range(100, 110), 201, 202, 203, -5, -100, -101, -105], 24)
    rows = made(seed, convs, 9, words=seed)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, 1, "user", "x"), (305, 0, "user", "only own"), (0, 3, "user", "late"),
            (0, None, "system", ""), (2, 0, "system", ""), (2, 1, "user", "late")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_one_conversation_over_many_ranges(spark):
    rows = [(0, i, "user", f"t{i % 3}") for i in range(700)] + [(7, i, "user", f"t{i % 3}") for i in range(699)]
    rows += [(c, 0, "user", "t0") for c in range(8, 60)] + [(100, 1, "user", "same")] * 300 + [(103, 1, "user", "same")] * 299
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r[0] for r in got}) > 1
    want_root = [r for r in got if r[1] == 0]
    assert want_root[0][3] == 56
    assert got == sorted(fast(rows), key=str)


def fast(rows):
    """As ``brute``, with sums from the ends of the paths up."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, role, text))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    nodes, child = {}, defaultdict(dict)
    nodes[0], count = [[], [], 0, None, ""], 1
    for conv in sorted(own):
        h, base = zlib.crc32(str(conv).encode()) % 6, conv - conv % 100
        at = 0
        nodes[0][0].append(conv)
        for turn in own.get(base, [])[:h] + own[conv][h:]:
            if turn not in child[at]:
                child[at][turn] = count
                nodes[count] = [[], [], nodes[at][2] + 1, at, turn[1]]
                count += 1
            at = child[at][turn]
            nodes[at][0].append(conv)
        nodes[at][1].append(conv)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=lambda n: -nodes[n][2]):
        kids = child[n].values()
        leaves[n] = sum(leaves[k] for k in kids) or 1
        saved[n] = sum(saved[k] for k in kids) + (len(nodes[n][0]) - 1) * len(nodes[n][4])
    return [(min(m), d, None if up is None else min(nodes[up][0]), len(m), len(child[n]), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for n, (m, e, d, up, _) in nodes.items()]


def test_equal_fingerprints_of_unequal_turns_are_found(spark):
    rows = made(3, range(0, 30), 6)
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)
    stored = prefix_trie.stored_turns(df)
    found = prefix_trie.members(stored, 0, (3,))
    assert not prefix_trie.clashes(found, prefix_trie.group_nodes(found), stored).isEmpty()
    assert run(spark, rows, primes=(3, 5, prefix_trie.PRIMES[0])) == brute(rows)


def test_products_compose():
    ring = prefix_trie.ring(0)
    a, b, c = (1, 5), (3, 12345), (8, 99)
    assert ring.product(ring.product(a, b), c) == ring.product(a, ring.product(b, c))


def test_stored_turns_are_written_once(spark):
    df = spark.createDataFrame([(c, t, "user", "x" * 50) for c in range(20) for t in range(3)], "conv_id long, turn long, role string, text string")
    stored = prefix_trie.stored_turns(df)
    assert stored.count() == 60 and stored.agg(F.count_distinct("part", "place")).collect()[0][0] == 60
