"""Jaccard self-join of documents on word n-grams: rare-first prefixes, length, positional and suffix
filters, each pair verified once.

A document's set holds a 64-bit hash of each distinct run of ``words`` words (of all words, if there
are fewer). Documents with one set are one class, found by a 128-bit digest of the set and named
after its smallest document. Similar classes share an n-gram in their prefixes: with the n-grams in
one order over all sets, the first ``n - ceil(t n) + 1`` of a set of ``n``. The order is rare first,
so that prefixes are made of n-grams that hardly any other set has.

1. *Rarity.* Blocks of documents send each distinct n-gram once, in packs by hash slot. The slots
   answer how many n-grams of each document occur elsewhere. An n-gram that stands in a third of all
   documents is one entry per block. A set whose prefix has only n-grams that no other set has cannot
   have a partner; as rare ones come first, that is every set with fewer than ``t n`` shared ones.
2. *Prefixes.* The sets that are left are written once, their frequencies counted in the same way,
   and the shared n-grams of their prefixes become postings, with the set's size, the n-gram's place
   and the number of n-grams after it in each of eight hash ranges.
3. *Candidates.* Only components are wanted, so a posting list need not give all its pairs. First
   every class meets the smallest of each of its lists. Where a list then spans several components,
   its classes outside the list's commonest component meet all those in other components; those
   within one component need no comparison. As long as that would be many more pairs than postings
   and links keep turning up, lists first meet one more leader. The length filter, the positional
   filter (n-grams before and after the shared one, without those no other set has) and the suffix filter (the ranges after it)
   bound a pair's overlap before any set is moved.
4. *Verification.* The two sets of each candidate pair are joined by class and intersected.

All intermediate tables are written in the shared folder. Joins are on n-gram or class and have
nothing above them that forbids splitting hot partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import connected_components
from ..scratch import write_out
from ._arrow import id_and_text, pieces

WORDS = 5
PERCENT = 80
UNNAMED = 1 << 62  # what stands for an id where there is none is not below this
BLOCK_DOCS = 4096  # documents of a block, fewer than 65,535
BLOCK_SHINGLES = 1_000_000
RANGES = 8
PAIRS_PER_POSTING = 256

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MULTIPLIERS = np.random.default_rng(4).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHARED_HERE = 0xFFFF  # in place of a document: two or more documents of the block have it


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased and split at ASCII white space, and the
    number of words of each text."""
    raws = [(text or "").encode().lower() for text in texts]
    joined = b"\n".join(raws) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends_of_text = np.cumsum([len(r) + 1 for r in raws])
    space = _SPACE[data]
    filled = np.flatnonzero(~space)
    if not len(filled):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = filled[np.flatnonzero(np.diff(filled, prepend=-2) != 1)]
    first = np.searchsorted(filled, starts)
    lengths = np.diff(np.append(first, len(filled)))
    place = (filled - np.repeat(starts, lengths) + 1).astype(np.uint64)
    mixed = (data[filled] + np.uint64(257) * place) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.diff(np.searchsorted(starts, ends_of_text), prepend=0)
    return _mix(np.add.reduceat(mixed, first)), counts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; empty for texts without words."""
    hashes, counts = word_hashes(texts)
    width = max(0, len(hashes) - words + 1)
    runs = np.zeros(width, np.uint64)
    for k in range(words):
        runs += hashes[k : k + width] * _MULTIPLIERS[k]
    runs = _mix(runs)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= words:
            sets.append(np.unique(runs[at : at + n - words + 1]))
        elif n:
            whole = (hashes[at : at + n] * _MULTIPLIERS[:n]).sum(keepdims=True, dtype=np.uint64)
            sets.append(_mix(whole + _MULTIPLIERS[63:] * np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Slot of each hash, rising with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _block_name(number: int) -> int:
    return (TaskContext.get().partitionId() << 32) + number


def _rows(schema: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema)


_PACK = ["slot", "block", "info", "payload"]
_PACK_TYPES = [pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
_PACK_SCHEMA = "slot int, block long, info boolean, payload binary"
_INFO = np.dtype([("doc_id", "<i8"), ("digest", "V16"), ("n", "<i4"), ("shared", "<i4")])
_COUNT = np.dtype([("doc", "<u2"), ("count", "<u4")])


def _pack_block(block: int, ids: list[int], sets: list[np.ndarray], slots: int) -> list[tuple]:
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
    runs = np.diff(np.append(first, len(flat)))
    info = np.zeros(len(ids), _INFO)
    info["doc_id"], info["n"] = ids, sizes
    info["digest"] = np.array([digest(s) for s in sets], "V16")
    info["shared"] = np.bincount(owner[np.repeat(runs > 1, runs)], minlength=len(ids))
    distinct, holder = flat[first], np.where(runs > 1, _SHARED_HERE, owner[first])
    slot = _slots(distinct, slots)
    order = np.argsort((slot << 16) | holder, kind="stable")  # by document within a slot: compresses well
    slot, low = slot[order], distinct[order].astype(np.uint32)  # the lower half tells them apart in a slot
    holder = holder[order].astype(np.uint16)
    rows = [(block % slots, block, True, info.tobytes())]
    cuts = np.flatnonzero(np.diff(slot, prepend=-1))
    for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slot)]):
        rows.append((int(slot[start]), block, False, low[start:stop].tobytes() + holder[start:stop].tobytes()))
    return rows


def _blocks(batches, finish):
    """Blocks of bounded size over all batches of a task; ``finish(number, ids, sets)``."""
    ids, sets, size, number = [], [], 0, 0
    for batch in batches:
        for part in pieces(batch):
            for doc_id, found in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist())):
                ids.append(doc_id)
                sets.append(found)
                size += len(found)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_SHINGLES:
                    yield finish(number, ids, sets)
                    ids, sets, size, number = [], [], 0, number + 1
    if ids:
        yield finish(number, ids, sets)


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n, shared`` of every row with an id: the size of its set and how many of its
    n-grams other documents (or, for a few, by a clash of half hashes, none) have as well."""
    source = id_and_text(docs).where(F.col("doc_id").isNotNull())
    spark = docs.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * source.rdd.getNumPartitions())

    def send(batches):
        for rows in _blocks(batches, lambda k, ids, sets: _pack_block(_block_name(k), ids, sets, slots)):
            yield _rows(_PACK, rows, _PACK_TYPES)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        packs = frame[~frame["info"]]
        lows, holders, blocks = [], [], []
        for i, payload in enumerate(packs["payload"]):
            n = len(payload) // 6
            lows.append(np.frombuffer(payload, "<u4", n))
            holders.append(np.frombuffer(payload, "<u2", n, 4 * n))
            blocks.append(np.full(n, i, np.int64))
        rows = [(b, True, p) for b, p in zip(frame["block"][frame["info"]], frame["payload"][frame["info"]])]
        if lows:
            low, holder, block = np.concatenate(lows), np.concatenate(holders), np.concatenate(blocks)
            order = np.argsort(low, kind="stable")
            ordered = low[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            runs = np.diff(np.append(first, len(low)))
            shared = np.empty(len(low), bool)
            shared[order] = np.repeat(runs > 1, runs)
            told = shared & (holder != _SHARED_HERE)
            keys, counts = np.unique((block[told] << 16) | holder[told], return_counts=True)
            names = packs["block"].to_numpy()
            of = keys >> 16
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                part = np.zeros(stop - start, _COUNT)
                part["doc"], part["count"] = keys[start:stop] & 0xFFFF, counts[start:stop]
                rows.append((int(names[of[start]]), False, part.tobytes()))
        return pd.DataFrame(rows, columns=["block", "info", "payload"])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        info = np.frombuffer(frame["payload"][frame["info"]].iloc[0], _INFO).copy()
        for payload in frame["payload"][~frame["info"]]:
            part = np.frombuffer(payload, _COUNT)
            info["shared"][part["doc"]] += part["count"].astype(np.int32)
        return pd.DataFrame({
            "doc_id": info["doc_id"], "digest": [bytes(d) for d in info["digest"]],
            "n": info["n"].astype(np.int64), "shared": info["shared"].astype(np.int64),
        })

    packs = source.mapInArrow(send, _PACK_SCHEMA)
    answers = packs.groupBy("slot").applyInPandas(answer, "block long, info boolean, payload binary")
    found = answers.groupBy("block").applyInPandas(gather, "doc_id long, digest binary, n long, shared long")
    return write_out(found, "shingles")


_SETS = ["block", "class_ids", "sizes", "hashes"]


def class_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Blocks of the sets of ``classes`` (class_id, digest), read anew from the texts."""
    source = id_and_text(docs).join(classes, F.col("doc_id") == F.col("class_id")).select("doc_id", "text", "digest")

    def run(batches):
        # A repeated id with another text is another class: the digest tells.
        waiting: dict[int, tuple[int, bytes]] = {}

        def numbered():
            at = 0
            for batch in batches:
                rows = range(at, at + batch.num_rows)
                waiting.update(zip(rows, zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(1)], names=["row", "text"])
                at += batch.num_rows

        def finish(number, rows, sets):
            asked = [waiting.pop(row) for row in rows]
            kept = [(i, s) for (i, wanted), s in zip(asked, sets) if digest(s) == bytes(wanted)]
            own = np.array([i for i, _ in kept], "<i8")
            sizes = np.array([len(s) for _, s in kept], "<i4")
            flat = np.concatenate([s for _, s in kept]) if kept else np.zeros(0, np.uint64)
            return (_block_name(number), own.tobytes(), sizes.tobytes(), flat.astype("<u8").tobytes())

        for row in _blocks(numbered(), finish):
            yield _rows(_SETS, [row], [pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    blocks = source.mapInArrow(run, "block long, class_ids binary, sizes binary, hashes binary")
    return write_out(blocks, "sets")


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Places of the prefix of a set of ``n``: all but the least overlap with a similar set, and one."""
    return n - -(-n * percent // 100) + 1


def postings(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``gram, class_id, n, place, before, after``: the shared n-grams of each class's rare-first prefix.
    ``before`` and ``after`` count the shared n-grams on either side, the latter by hash range."""
    slots = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sets.rdd.getNumPartitions())

    def send(batches):
        for batch in batches:
            for block, _, _, hashes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                grams, counts = np.unique(np.frombuffer(hashes, "<u8"), return_counts=True)
                slot = _slots(grams, slots)
                cuts = np.flatnonzero(np.diff(slot, prepend=-1))
                rows = [
                    (int(slot[a]), block, grams[a:b].tobytes(), counts[a:b].astype("<u4").tobytes())
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slot)])
                ]
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield _rows(["slot", "block", "grams", "counts"], rows, types)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(g, "<u8") for g in frame["grams"]]
        flat = np.concatenate(grams)
        distinct, place = np.unique(flat, return_inverse=True)
        totals = np.bincount(place, np.concatenate([np.frombuffer(c, "<u4") for c in frame["counts"]]))
        rows, at = [], 0
        for block, own in zip(frame["block"], grams):
            total = totals[place[at : at + len(own)]]
            at += len(own)
            often = total > 1
            if often.any():
                rows.append((block, own[often].tobytes(), total[often].astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=["block", "grams", "counts"])

    def prefixes(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["gram", "class_id", "n", "place", "before", "after"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=names)
        grams = np.concatenate([np.frombuffer(g, "<u8") for g in right["grams"]])
        counts = np.concatenate([np.frombuffer(c, "<i8") for c in right["counts"]])
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        rows = []
        ids, sizes = np.frombuffer(left["class_ids"].iloc[0], "<i8"), np.frombuffer(left["sizes"].iloc[0], "<i4")
        flat, at = np.frombuffer(left["hashes"].iloc[0], "<u8"), 0
        for class_id, n in zip(ids.tolist(), sizes.tolist()):
            own = flat[at : at + n]
            at += n
            found = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            frequency = np.where(grams[found] == own, counts[found], 1)
            order = np.lexsort((own, frequency))  # rare first, then by hash: one order for all sets
            ordered, length = own[order], prefix_length(n, percent)
            lone = int((frequency == 1).sum())
            if lone >= length:
                continue
            ranges = (ordered >> np.uint64(61)).astype(np.int64)
            after = np.bincount(ranges[lone:], minlength=RANGES)
            for place in range(lone, length):
                after[ranges[place]] -= 1
                rows.append((int(ordered[place].astype(np.int64)), class_id, n, place, place - lone, after.copy()))
        return pd.DataFrame(rows, columns=names)

    packs = sets.mapInArrow(send, "slot int, block long, grams binary, counts binary")
    counted = packs.groupBy("slot").applyInPandas(count, "block long, grams binary, counts binary")
    schema = "gram long, class_id long, n int, place int, before int, after array<int>"
    found = sets.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(prefixes, schema)
    return write_out(found, "postings")


def _may_link(a: str, b: str, percent: int):
    """The length, positional and suffix filters on two postings of one n-gram."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    # 100 o >= p (n + m - o), so the overlap is at least p (n + m) / (100 + p).
    enough = lambda overlap: overlap * (100 + percent) >= (n + m) * percent
    length = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    # N-grams that no other set has come first and match nothing: they count for the sizes only.
    before = F.least(f"{a}.before", f"{b}.before") + 1
    rest = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place")) - 1
    ranges = sum(
        (F.least(F.col(f"{a}.after")[k], F.col(f"{b}.after")[k]) for k in range(RANGES)), F.lit(0)
    )
    return length & enough(before + rest) & enough(before + ranges)


def _pairs(left: DataFrame, right: DataFrame, extra=None, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs ``a < b`` of the two sides' postings of one n-gram that pass the filters."""
    on = (F.col("l.gram") == F.col("r.gram")) & (F.col("l.class_id") != F.col("r.class_id"))
    on = on & _may_link("l", "r", percent)
    joined = left.alias("l").join(right.alias("r"), on if extra is None else on & extra)
    return joined.select(
        F.least("l.class_id", "r.class_id").alias("a"), F.greatest("l.class_id", "r.class_id").alias("b")
    ).distinct()


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets are similar enough, by intersecting them."""

    def single(batches):
        for batch in batches:
            for class_ids, sizes, hashes in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                ids, counts = np.frombuffer(class_ids, "<i8").tolist(), np.frombuffer(sizes, "<i4")
                ends = (np.cumsum(counts) * 8).tolist()
                rows = [(i, hashes[e - 8 * n : e]) for i, e, n in zip(ids, ends, counts.tolist())]
                for at in range(0, len(rows), 500):
                    yield _rows(["class_id", "own"], rows[at : at + 500], [pa.int64(), pa.binary()])

    def check(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append((a[i], b[i]))
            yield _rows(["a", "b"], kept, [pa.int64(), pa.int64()])

    singles = sets.mapInArrow(single, "class_id long, own binary")
    first = singles.select(F.col("class_id").alias("a"), F.col("own").alias("set_a"))
    second = singles.select(F.col("class_id").alias("b"), F.col("own").alias("set_b"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(check, "a long, b long")


def similar_components(found: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, component`` of the classes that are linked, from their postings."""
    leaders = found.groupBy("gram").agg(F.min(F.struct("class_id", "n", "place", "before", "after")).alias("lead"))
    pairs = write_out(_pairs(leaders.select("gram", "lead.*"), found, percent=percent), "pairs")
    links = write_out(verify(pairs, sets, percent), "links")
    compared, linked = pairs, links.count()
    while True:
        groups = connected_components(links)
        placed = found.join(groups, F.col("class_id") == F.col("node"), "left").select(
            "gram", "class_id", "n", "place", "before", "after", F.coalesce("component", "class_id").alias("component")
        )
        sizes = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("rows"))
        lists = sizes.groupBy("gram").agg(
            F.count(F.lit(1)).alias("components"), F.sum("rows").alias("rows"),
            F.max(F.struct("rows", "component")).alias("main"),
        ).where(F.col("components") > 1)
        lists = lists.select(F.col("gram").alias("list"), "rows", F.col("main.component").alias("main"),
                             (F.col("rows") - F.col("main.rows")).alias("others"))
        open_lists = write_out(placed.join(lists, F.col("gram") == F.col("list")).drop("list"), "lists")
        work = open_lists.where(F.col("component") != F.col("main")).agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("pairs")).first()["pairs"]
        if not work:
            return groups
        outside = open_lists.where(F.col("component") != F.col("main"))
        apart = F.col("l.component") != F.col("r.component")
        whole = work <= PAIRS_PER_POSTING * open_lists.count() or not linked
        if whole:  # every pair of the list's other components; both sides outside: once
            once = (F.col("r.component") == F.col("r.main")) | (F.col("l.class_id") < F.col("r.class_id"))
            fresh = _pairs(outside, open_lists, apart & once, percent)
        else:  # one more leader of each list meets all others
            lead = outside.groupBy("gram").agg(
                F.min(F.struct("class_id", "n", "place", "before", "after", "component")).alias("lead"))
            fresh = _pairs(lead.select("gram", "lead.*"), open_lists, apart, percent)
        fresh = write_out(fresh.join(compared, ["a", "b"], "left_anti"), "pairs")
        more = write_out(verify(fresh, sets, percent), "links")
        links = links.unionByName(more)
        if whole:
            return connected_components(links)
        linked = more.count()
        compared = compared.unionByName(fresh)


def _joined_by_ids(groups: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The components, and as one those of classes that hold texts of the same id."""
    names = classes.select(F.col("digest").alias("named"), "class_id")
    held = rows.where("n > 0").join(names, F.col("digest") == F.col("named")).select("doc_id", "class_id")
    several = held.groupBy(F.col("doc_id").alias("id")).agg(
        F.min("class_id").alias("a"), F.max("class_id").alias("last")
    ).where(F.col("a") < F.col("last")).select("id", "a")
    several = write_out(several, "ids")
    if several.isEmpty():
        return groups
    same = held.join(several, F.col("doc_id") == F.col("id")).select("a", F.col("class_id").alias("b"))
    edges = groups.select(F.col("component").alias("a"), F.col("node").alias("b"))
    return connected_components(edges.unionByName(same).distinct())


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` of every row.

    ``component_id`` is the smallest id reachable by links of at least ``percent`` Jaccard similarity,
    the row's own included; ``class_id`` the smallest id with the very same set. Null texts and texts
    without words have no n-gram and link with nothing. Repeated rows are rows of one class each; an id
    with several texts is one document that links by any of them. A row without an id links like any other
    but names no component or class, so both are null if it hangs together with no id; ids are taken to be
    below 2**62. Other columns are not read, an empty table gives an empty one.
    """
    found = _components(docs.select(_named(F.col("doc_id"), F.col("text")).alias("doc_id"), "text"), percent)
    ids = {c: F.when(F.col(c) < UNNAMED, F.col(c)) for c in ("doc_id", "component_id", "class_id")}
    return found.withColumns(ids)


def _named(doc_id: Column, text: Column) -> Column:
    """The id, or for a row without one a number above all ids that its text gives."""
    by_text = F.xxhash64(text.cast("string")).bitwiseAND(UNNAMED - 1).bitwiseOR(UNNAMED)
    return F.coalesce(doc_id.cast("long"), by_text)


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """What ``near_duplicates`` returns, of rows that all have an id."""
    rows = document_sets(docs)
    classes = rows.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.max("shared").alias("shared")
    )
    # With fewer shared n-grams, the prefix holds none, and there is no candidate.
    hopeful = classes.where(F.col("shared") * 100 >= F.col("n") * percent).select("class_id", "digest")
    sets = class_sets(docs, hopeful)
    groups = similar_components(postings(sets, percent), sets, percent)
    groups = _joined_by_ids(groups, rows, classes)
    named = classes.select("digest", "class_id").join(
        groups, F.col("class_id") == F.col("node"), "left"
    ).select(F.col("digest").alias("named"), "class_id", F.coalesce("component", "class_id").alias("component"))
    joined = rows.join(named, (F.col("digest") == F.col("named")) & (F.col("n") > 0), "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of similar documents, the one with the smallest id; all columns kept.

    Repeated rows are copies, of which one stays. An id with several texts stays or goes with all of
    them. Rows without an id count as documents after all others, told apart by a hash of their text;
    those without words are like nothing, and all stay.
    """
    text = F.col("text").cast("string")
    named = F.col("doc_id").isNotNull() | text.rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.withColumn("__key", F.when(named, _named(F.col("doc_id"), text)))
    groups = _components(keyed.where(named).select(F.col("__key").alias("doc_id"), "text"), percent)
    # A row without words is a component of its own, but the document goes with its other texts.
    kept = groups.groupBy(F.col("doc_id").alias("__kept")).agg(F.min("component_id").alias("first"))
    kept = kept.where(F.col("__kept") == F.col("first")).select("__kept")
    first = keyed.join(kept, F.col("__key") == F.col("__kept"), "left_semi")
    whole = [F.col(f"`{c}`") for c in keyed.columns]
    told = [F.col(f"`{f.name}`") for f in keyed.schema.fields if "map<" not in f.dataType.simpleString()]
    # Of rows alike in id and text the one with the smallest hash, whichever task comes first.
    first = first.groupBy(F.col("__key").alias("__k"), F.col("text").alias("__t")).agg(
        F.min_by(F.struct(*whole), F.xxhash64(*told)).alias("__row")
    ).select("__row.*")
    return first.unionByName(keyed.where(F.col("__key").isNull())).drop("__key")
