"""Similar spellings: pairs, groups and a suggested unification, on the distinct values of a column.

Pairs are found by joining on rare shared bigrams (prefix filtering: Chaudhuri et al., 2006;
Bayardo et al., 2007), never by comparing all values. The prefix lengths below follow from the
scores, so no pair that reaches the wanted score is lost:

* If two bigram sets share at least o members, and both are sorted by one order, their first
  (size - o + 1) members have one in common. Sorted from rare to common, a hot bigram is joined
  on only for values that have too few rare ones.
* Dice, with A and B bigrams and score t: at least t(A+B)/2 of the first text's bigrams are in
  the second. Of these at most e repeat another (e = repeats in the first text), so at least
  t(A+B)/2 - e distinct ones are shared, and B is at least (tA/2 - e) / (1 - t/2). Seen from
  the second text and e = 0 the bound is tB/(2-t). For e > 0 the second text takes part with all
  its bigrams, in a join of its own.
* The bounds for the two texts at hand are closer than for either alone, so the places of a
  bigram in both rule most pairs out before anything is compared.
* Edit similarity s, with the longer text of length L: at most (1-s)L edits, each breaking two
  bigrams, leave at least (2s-1)L - 1 in common, repeats included. Above s = 2/3 that is never
  less than one when an edit is possible at all.

Where only groups are wanted, short texts are linked without any pair: see ``_short_links``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.refs import require
from ..functions.similarity import bigram_codes, bigram_similarity, collapsed_root, edit_similarity
from ..functions.text import upper_trim
from ..scratch import in_background, write_out
from .aggregate import distinct_values
from .components import FEW_EDGES, connected_components, plain_value, small_table
from .order import global_row_index, running_total

# The score of an equal collapsed root and of 2, 3 or 4 equal first characters.
ROOT_SCORE = 0.95
PREFIX_SCORES = {2: 0.75, 3: 0.80, 4: 0.85}

# Values of one bigram that one join key holds at most.
BLOCK_VALUES = 2000

# Texts of so many bigrams at most are linked by the sets of bigrams that they share.
SHORT = 8

# Characters of a text that one row of the search for shared bigrams holds.
PIECE = 64

# So few values are compared without chaining them first.
FEW_VALUES = 2000
# Characters at the end of a value that its place among the endings depends on.
ENDING = 64
# Mean length of runs from which on their first values are chained again.
LONG_RUN = 4

_ROUNDING = 1e-9


def text_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): the distinct trimmed upper-case texts of each column with their counts.

    Written out, because everything below reads it several times and the table only here.
    """
    require(df, *columns)
    return write_out(distinct_values(df, columns, clean=upper_trim), "values")


def _ceil(c: Column) -> Column:
    return F.ceil(c - F.lit(_ROUNDING))


def _sized(values: DataFrame) -> DataFrame:
    """The values with their bigrams, all (``bag``) and ``distinct``, and how many there are and repeat."""
    # as a generated row the bigrams are built once, not again in each expression that uses them
    bags = F.inline(F.array(F.struct(bigram_codes(F.col("value")).alias("bag"))))
    sized = values.select("*", bags).withColumn("distinct", F.array_distinct("bag"))
    return sized.withColumns({"total": F.size("bag"), "repeats": F.size("bag") - F.size("distinct")})


def _least_shared(dice: float | None, edit: float | None) -> Column:
    """How many distinct bigrams a value must share with any partner that reaches a score."""
    total, repeats = F.col("total"), F.col("repeats")
    bounds = []
    if dice is not None:
        partner = F.greatest(F.lit(1.0), (total * dice / 2 - repeats) / (1 - dice / 2))
        bounds.append(_ceil((total + partner) * dice / 2) - repeats)
        bounds.append(_ceil(total * dice / (2 - dice)))
    if edit is not None:
        bounds.append(_ceil((total + 1) * (2 * edit - 1) - 1) - repeats)
    lowest = F.least(*bounds) if len(bounds) > 1 else bounds[0]
    return F.greatest(F.lit(1), lowest).cast("int")


def _postings(
    values: DataFrame, dice: float | None, edit: float | None, other_nodes: bool, linked: int = 0, few: bool = False
) -> DataFrame:
    """One row per value: its bigrams from rare to common, and those to look for partners by.

    A bigram of one value only, or with ``other_nodes`` of one node only, leads to no partner. Values
    of up to ``linked`` bigrams need none among themselves. How often a bigram occurs is written out
    first: a small table, by which values that can have no partner are left out before any is shuffled.
    For ``few`` values that is spared: any order of the bigrams will do, if it is the same for all.
    """
    sized = _sized(values)
    sized = sized.where("total > 0").withColumn("prefix", F.size("distinct") - _least_shared(dice, edit) + 1)
    carried = ["column", "value", "node", "total", "repeats", "prefix"]
    if few:
        all_useful = F.transform(F.array_sort("distinct"), lambda g: F.struct(
            F.lit(0).cast("bigint").alias("freq"), g.alias("gram"), F.lit(True).alias("useful")))
        return _placed(sized.select(*carried, all_useful.alias("listed")))

    def tokens(rows: DataFrame) -> DataFrame:
        return rows.select(*carried, F.explode("distinct").alias("gram"))

    apart = F.when(F.col("total") > linked, F.col("node")) if linked else F.col("node")
    rarity = tokens(sized).groupBy(F.col("column").alias("c"), F.col("gram").alias("g")).agg(
        F.count("*").alias("freq"), F.min(apart).alias("least"), F.max(apart).alias("most"),
        F.count_if(apart.isNull()).alias("close"),
    )
    useful = F.coalesce(F.col("least") != F.col("most"), F.lit(False)) if other_nodes else F.col("freq") > 1
    if linked:
        useful = useful | ((F.col("close") > 0) & F.col("least").isNotNull())
    rarity = write_out(rarity.select("c", "g", "freq", useful.alias("useful")), "rarity")
    same = (F.col("column") == F.col("c")) & (F.col("gram") == F.col("g"))
    if other_nodes:
        found = tokens(sized).join(rarity.where("useful"), same).select(
            F.col("column").alias("fc"), F.col("value").alias("fv")).distinct()
        sized = sized.join(found, (F.col("column") == F.col("fc")) & (F.col("value") == F.col("fv")), "left_semi")
    ranked = tokens(sized).join(rarity, same)
    listed = ranked.groupBy(*carried).agg(
        F.array_sort(F.collect_list(F.struct("freq", "gram", "useful"))).alias("listed")
    )

    return _placed(listed)


def _placed(listed: DataFrame) -> DataFrame:
    """The postings, written out, from values with their bigrams in order."""

    def placed(entry: Column, place: Column) -> Column:
        return F.struct(entry["gram"].alias("gram"), place.alias("place"), entry["useful"].alias("useful"))

    places = F.transform("listed", placed)
    every = F.filter(places, lambda s: s["useful"])
    rare = F.filter(places, lambda s: s["useful"] & (s["place"] < F.col("prefix")))
    postings = listed.select(
        "column", "value", "node", "total", "repeats",
        F.when(F.col("repeats") > 0, bigram_codes(F.col("value"))).alias("bag"),
        F.transform("listed", lambda s: s["gram"]).alias("grams"),
        rare.alias("rare"), every.alias("every"),
    )
    return write_out(postings, "postings")


def _score(a: Column, b: Column, dice: float | None, edit: float | None) -> Column:
    share = F.lit(0.0) if dice is None else bigram_similarity(a, b)
    return F.greatest(share, edit_similarity(a, b)) if edit is not None else share


def _reaches(a: Column, b: Column, min_score: float) -> Column:
    """Whether either score is reached; bigrams are compared only where the edit distance is too large."""
    by_edit = edit_similarity(a, b) >= F.lit(min_score)
    return F.when(by_edit, F.lit(True)).otherwise(bigram_similarity(a, b) >= F.lit(min_score))


def _hot_bigrams(postings: DataFrame) -> DataFrame | None:
    """(c, g, blocks) of the bigrams with more than ``BLOCK_VALUES`` values, or None without any."""
    counts = postings.select(F.col("column").alias("c"), F.explode("every.gram").alias("g")).groupBy("c", "g").count()
    hot = counts.where(F.col("count") > BLOCK_VALUES)
    hot = hot.select("c", "g", F.ceil(F.col("count") / BLOCK_VALUES).alias("blocks"))
    return None if hot.isEmpty() else hot


def _in_blocks(a: DataFrame, b: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut the postings of a hot bigram into blocks and pair every block with every other.

    Each pair of blocks is a join key of its own, so no task compares more than a block squared.
    """

    def cut(side: DataFrame, s: str, own: str, other: str) -> DataFrame:
        same = (F.col(f"column_{s}") == F.col("c")) & (F.col(f"gram_{s}") == F.col("g"))
        blocks = F.coalesce("blocks", F.lit(1))
        cut_up = side.join(hot, same, "left").withColumn(f"{own}_{s}", F.pmod(F.xxhash64(f"value_{s}"), blocks))
        return cut_up.withColumn(f"{other}_{s}", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("c", "g", "blocks")

    return cut(a, "a", "row", "col"), cut(b, "b", "col", "row")


def _scored(
    postings: DataFrame, dice: float | None, edit: float | None, min_score: float, other_nodes: bool, linked: int = 0,
    few: bool = False,
) -> DataFrame:
    """Pairs ``a < b`` at or above the score, each emitted at its rarest shared bigram only.
    Pairs of two values of up to ``linked`` bigrams are left out.

    First texts without repeated bigrams meet others on the prefixes of both; for the edit score
    all first texts do. First texts with repeats also meet all bigrams of the second for Dice.
    """
    carried = ("column", "value", "node", "total", "repeats", "bag", "grams")

    def side(name: str, grams: str) -> DataFrame:
        kept = [F.col(k).alias(f"{k}_{name}") for k in carried]
        found = postings.select(*kept, F.explode(grams).alias("found"))
        return found.withColumns(
            {f"gram_{name}": F.col("found.gram"), f"place_{name}": F.col("found.place")}).drop("found")

    def near_enough(least_shared: Column) -> Column:
        """Whether so many bigrams can be shared when this one, the rarest, has these places."""
        wanted = F.greatest(F.lit(1), least_shared)
        return (F.col("place_a") <= F.size("grams_a") - wanted) & (F.col("place_b") <= F.size("grams_b") - wanted)

    a, b = F.col("value_a"), F.col("value_b")
    longer = F.greatest(F.char_length(a), F.char_length(b))
    common = F.array_intersect("grams_a", "grams_b")
    first_shared = F.element_at(common, 1) == F.col("gram_a")
    of_plain, of_repeated = F.size(common), F.size(F.filter("bag_a", lambda x: F.array_contains("grams_b", x)))
    shared = F.when(F.col("repeats_a") == 0, of_plain).otherwise(of_repeated)
    share = F.least(F.lit(1.0), F.lit(2.0) * shared / (F.col("total_a") + F.col("total_b")))
    like_length = F.least(F.char_length(a), F.char_length(b)) >= longer * F.lit((edit or 1) - _ROUNDING)
    by_dice = by_edit = None
    if dice is not None:
        least = _ceil((F.col("total_a") + F.col("total_b")) * dice / 2) - F.col("repeats_a")
        by_dice = near_enough(least) & first_shared & (share >= F.lit(min_score))
    if edit is not None:
        least = _ceil(longer * (2 * edit - 1) - 1) - F.least("repeats_a", "repeats_b")
        by_edit = near_enough(least) & like_length & first_shared & (edit_similarity(a, b) >= F.lit(min_score))
    reached = by_dice | by_edit if edit is not None and dice is not None else by_edit if dice is None else by_dice
    candidate = (a < b) & (F.col("node_a") != F.col("node_b")) if other_nodes else a < b
    if linked:
        candidate = candidate & (F.greatest("total_a", "total_b") > linked)
    plain, repeated = F.col("repeats_a") == 0, F.col("repeats_a") > 0
    parts = postings.sparkSession.conf.get("spark.sql.shuffle.partitions")
    hot = None if few else _hot_bigrams(postings)

    def meet(first: Column | None, other: str, test: Column) -> DataFrame:
        left = side("a", "rare") if first is None else side("a", "rare").where(first)
        right, keys = side("b", other), ["column", "gram"]
        if hot is not None:
            left, right = _in_blocks(left, right, hot)
            keys += ["row", "col"]
        if not few:  # small in bytes but long to compute: a fixed number of partitions, not merged by size
            left = left.repartition(int(parts), *[f"{k}_a" for k in keys])
            right = right.repartition(int(parts), *[f"{k}_b" for k in keys])
        same = [F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys]
        return left.join(right, [*same, candidate & test])

    pairs = meet(plain if edit is None else None, "rare", reached)
    if dice is not None:
        pairs = pairs.unionByName(meet(repeated, "every", by_dice))
    # As a generated row the score is computed for the pairs found; a later filter on it would
    # otherwise move into the join and be tried first, on every candidate.
    found = F.struct(F.col("column_a").alias("column"), "value_a", "value_b", "node_a", "node_b", share.alias("score"))
    return pairs.select(F.inline(F.array(found)))


def similar_pairs(values: DataFrame, min_score: float) -> DataFrame:
    """All pairs of texts of two or more characters with a Dice score at or above ``min_score``."""
    if not 0 < min_score <= 1:
        raise ValueError("min_score must be above 0 and at most 1")
    nodes = values.withColumn("node", F.col("value"))
    return _scored(_postings(nodes, min_score, None, False), min_score, None, min_score, False)


def fuzzy_pairs(df: DataFrame, column: str, min_score: float = 0.85) -> DataFrame:
    """Value pairs with ``min_score <= similarity < 1``, most similar first."""
    pairs = similar_pairs(text_values(df, [column]), min_score).where(F.col("score") < 1)
    return pairs.select(
        "value_a", "value_b", F.bround("score", 3).alias("similarity")
    ).orderBy(F.desc("similarity"), "value_a", "value_b")


def _node(column: Column, name: Column) -> Column:
    return F.struct(column.alias("column"), name.alias("name"))


def _runs(values: DataFrame, min_score: float, dice: float | None, edit: float | None) -> DataFrame:
    """(column, value, n, run, start): runs of values in sorted order, each similar to the one before."""
    placed = global_row_index(values.select("column", "value", "n"), ["column", "value"], "place")
    previous = placed.select(
        (F.col("place") + 1).alias("p"), F.col("column").alias("pc"), F.col("value").alias("pv"))
    near = (F.col("column") == F.col("pc")) & (_score(F.col("pv"), F.col("value"), dice, edit) >= F.lit(min_score))
    start = F.when(near, F.lit(0)).otherwise(F.lit(1)).alias("start")
    linked = placed.join(previous, F.col("place") == F.col("p"), "left").select("column", "value", "n", "place", start)
    counted = running_total(linked, ["place"], "start", "before")
    return counted.select("column", "value", "n", (F.col("before") + F.col("start")).alias("run"), "start")


def _chained(values: DataFrame, min_score: float, dice: float | None, edit: float | None) -> DataFrame:
    """Give linked values one ``node`` as far as sorted order shows the links.

    Runs of similar neighbours are nodes; where they are long, the first values of the runs are
    chained in turn. Dense columns (codes, numbered names) are linked in linear time this way, and
    only pairs between nodes are left to look for.
    """
    runs = _runs(values, min_score, dice, edit)
    total, found = runs.agg(F.count("*"), F.sum("start")).first()
    if found * LONG_RUN > total:
        return runs.select("column", "value", "n", _node(F.col("column"), F.col("run").cast("string")).alias("node"))
    firsts = runs.where("start = 1")
    upper = _chained(firsts, min_score, dice, edit).select(
        F.col("column").alias("c"), F.col("value").alias("v"), "node")
    nodes = firsts.join(upper, (F.col("column") == F.col("c")) & (F.col("value") == F.col("v"))).select(
        F.col("run").alias("r"), "node")
    return runs.join(nodes, F.col("run") == F.col("r")).select("column", "value", "n", "node")


def _with_nodes(values: DataFrame, min_score: float, dice: float | None, edit: float | None) -> DataFrame:
    if values.count() <= FEW_VALUES:
        return values.withColumn("node", _node(F.col("column"), F.col("value")))
    return _chained(values, min_score, dice, edit)


def _merged(values: DataFrame, edges: DataFrame) -> DataFrame:
    """The values with linked nodes made one."""
    found = connected_components(edges, few=FEW_EDGES).withColumnRenamed("node", "linked")
    joined = values.join(found, F.col("node") == F.col("linked"), "left")
    return joined.withColumn("node", F.coalesce("component", "node")).select(*values.columns)


def _start_code(start: Column, length: int) -> Column:
    """The first characters as one whole number up to three of them, else as they are: an aggregate of
    numbers needs no sort."""
    if length > 3:
        return start
    points = [F.ascii(F.substring(start, i + 1, 1) if i else start) + 1 for i in range(length)]
    points = [F.when(F.char_length(start) > i, p.cast("bigint")).otherwise(F.lit(0)) for i, p in enumerate(points)]
    return reduce(lambda code, p: code * F.lit(1 << 21) + p, points)


def _places(values: DataFrame, length: int, min_score: float) -> DataFrame:
    """(column, start, node, size, singles, n), written out: a small table of the first characters of all values.

    Those with values alike but for their first character, or the lack of one, have one node. These are
    true links, as one edit is near enough in texts of that length. Values meet on what follows the first
    character, so nothing is sorted and no pair is made.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tails = F.explode(F.array(F.col("value"), F.expr("substring(value, 2)"))).alias("tail")
    # the code in a step of its own, once a value and not once a tail
    coded = values.select("column", "value", _start_code(F.left("value", F.lit(length)), length).alias("code"))
    rows = coded.select("column", "code", tails)
    near = F.lit(1.0) - F.lit(1) / (F.char_length("tail") + 1) >= F.lit(min_score)
    met = rows.where(near).repartition(parts, "column", "tail").groupBy("column", "tail").agg(
        F.min("code").alias("least"), F.max("code").alias("most"))

    def named(code: str) -> Column:
        return _node(F.col("column"), F.col(code).cast("string"))

    pairs = met.where("least != most").select(named("least").alias("a"), named("most").alias("b"))
    starts = values.groupBy("column", F.left("value", F.lit(length)).alias("start")).agg(
        F.count("*").alias("size"), F.count_if(F.char_length("value") == 1).alias("singles"), F.sum("n").alias("n"))
    starts = starts.withColumn("code", _start_code(F.col("start"), length)).withColumn("node", named("code")).drop("code")
    return write_out(_merged(starts, pairs), "places")


def _located(values: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The values that begin as one of the places, with its node."""
    small = places.select(F.col("column").alias("c"), "start", "node")
    begun = (F.col("column") == F.col("c")) & (F.left("value", F.lit(length)) == F.col("start"))
    return values.join(small, begun).select("column", "value", "n", "node")


def _merged_by_endings(values: DataFrame, min_score: float) -> DataFrame:
    """Nodes that are linked by values next to one another in the order of their endings become one.

    These are true links, found in linear time; they only spare the join of bigrams, which looks for
    links between nodes, most of its candidates. Values that begin unlike but end alike (codes,
    amounts, numbered names) mostly fall into one node this way.
    """
    ending = F.left(F.reverse("value"), F.lit(ENDING)).alias("ending")
    ranged = values.select("column", "value", "node", ending).repartitionByRange("column", "ending", "value")
    # neighbours inside a range partition; the one at its edge is left to the join of bigrams
    before = Window.partitionBy("part").orderBy("column", "ending", "value")
    placed = ranged.withColumn("part", F.spark_partition_id()).select(
        "column", "value", "node", F.lag("column").over(before).alias("pc"), F.lag("value").over(before).alias("pv"),
        F.lag("node").over(before).alias("a"))
    pairs = placed.where((F.col("column") == F.col("pc")) & (F.col("a") != F.col("node")))
    scored = pairs.select(F.inline(F.array(F.struct(
        "a", F.col("node").alias("b"), _reaches(F.least("pv", "value"), F.greatest("pv", "value"), min_score).alias("near"),
    ))))
    merged = _merged(values, scored.where("near").select("a", "b"))
    # Small in bytes but long to compute with: not merged into few files by size.
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_out(merged.repartition(parts, "column", "value"), "merged")


def _short_classes(values: DataFrame) -> set[tuple[int, int]]:
    """(bigrams, repeated ones) of the texts up to ``SHORT`` bigrams; all longer ones are one class."""
    sized = _sized(values.where(F.char_length("value") <= SHORT + 1)).select("total", "repeats")
    longer = values.where(F.char_length("value") > SHORT + 1).select(F.lit(SHORT + 1).alias("total"), F.lit(0).alias("repeats"))
    return set(map(tuple, sized.unionByName(longer).where("total > 0").distinct().collect()))


def _wanted(total_a: int, total_b: int, min_score: float) -> int:
    """How many bigrams must be shared for a Dice score."""
    return math.ceil((total_a + total_b) * min_score / 2 - _ROUNDING)


def _subsets(sized: DataFrame, sizes: dict[tuple[int, int], set[int]]) -> DataFrame:
    """One row per value and subset of its bigrams of a wanted size, with the subset's hash as key."""
    wanted = F.array().cast("array<int>")
    for (total, repeats), ks in sizes.items():
        here = (F.col("total") == total) & (F.col("repeats") == repeats)
        wanted = F.when(here, F.array(*[F.lit(k) for k in sorted(ks)]).cast("array<int>")).otherwise(wanted)
    # the n-th of all subsets holds the bigrams whose bits are set in n
    subsets = F.aggregate(
        F.transform("distinct", lambda g: F.xxhash64(g)), F.array(F.lit(0).cast("bigint")),
        lambda found, h: F.concat(found, F.transform(found, lambda x: x.bitwiseXOR(h))))
    keyed = F.transform(subsets, lambda x, i: F.struct(F.bit_count(i).cast("int").alias("k"), x.alias("key")))
    rows = sized.withColumn("sizes", wanted).where(F.size("sizes") > 0)
    kept = F.filter(keyed, lambda s: F.array_contains("sizes", s["k"]))
    return rows.select("value", "node", "total", "repeats", F.inline(kept))


def _short_links(values: DataFrame, classes: set[tuple[int, int]], min_score: float) -> DataFrame:
    """Edges that join all texts of one column with ``SHORT`` bigrams at most as Dice links do.

    Texts of A and B bigrams link when they share o = t(A+B)/2, so they meet on a subset of o. Without
    repeats any two texts that meet there link if their totals are small enough. So if any does, it
    does with the one of the smallest total: each subset is a star, and its members make no pairs.
    Texts with repeats count those too, on one side only. They meet on smaller subsets, and their
    pairs are looked at. Subsets meet by 64-bit hashes; all links are checked on the texts.
    """
    short = _sized(values.where(F.char_length("value") <= SHORT + 1))
    classes = {(total, repeats) for total, repeats in classes if total <= SHORT}
    plain, repeated = ({c for c in classes if bool(c[1]) is kind} for kind in (False, True))
    pair = F.struct(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.least("value_a", "value_b").alias("x"),
                    F.greatest("value_a", "value_b").alias("y"))

    def checked(met: DataFrame) -> DataFrame:
        found = met.select(F.inline(F.array(pair))).distinct().select(F.inline(F.array(F.struct(
            "a", "b", bigram_similarity(F.col("x"), F.col("y")).alias("score")))))
        return found.where(F.col("score") >= F.lit(min_score)).select("a", "b")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{c}_{name}") for c in rows.columns])

    def sizes(of: set, others: set) -> dict[tuple[int, int], set[int]]:
        found = {}
        for total, repeats in of:
            for total_b, repeats_b in others:
                k = max(1, _wanted(total, total_b, min_score) - max(repeats, repeats_b))
                if k <= min(total - repeats, total_b - repeats_b):
                    found.setdefault((total, repeats), set()).add(k)
        return found

    same = (F.col("k_a") == F.col("k_b")) & (F.col("key_a") == F.col("key_b"))
    totals = F.col("total_a") + F.col("total_b")
    members = _subsets(short.where("repeats = 0"), sizes(plain, plain))
    hubs = members.groupBy("k", "key").agg(
        F.min(F.struct("total", "value", "node")).alias("hub"), F.count("*").alias("members"))
    hubs = hubs.where((F.col("members") > 1) & (F.col("k") >= _ceil(F.col("hub.total") * min_score)))
    hubs = write_out(hubs.select("k", "key", "hub.total", "hub.value", "hub.node"), "hubs")
    near = (F.col("value_a") != F.col("value_b")) & (F.col("k_a") >= _ceil(totals * min_score / 2))
    edges = checked(side(members, "a").join(side(hubs, "b"), same & near))
    if repeated:
        own = write_out(_subsets(short.where("repeats > 0"), sizes(repeated, classes)), "repeated")
        every = _subsets(short, {
            c: ks for of, others in ((plain, repeated), (repeated, classes)) for c, ks in sizes(of, others).items()})
        least = _ceil(totals * min_score / 2) - F.greatest("repeats_a", "repeats_b")
        near = (F.col("value_a") != F.col("value_b")) & (F.col("k_a") == F.greatest(F.lit(1), least))
        edges = edges.unionByName(checked(side(every, "a").join(side(own, "b"), same & near)))
    return edges


def _main_and_rest(
    values: DataFrame, places: DataFrame | None = None, length: int | None = None
) -> tuple[DataFrame, DataFrame, bool, bool]:
    """The values of each column's largest node, which need no links among themselves, and all others;
    whether these are few, and whether there is any value of one character.

    With ``places`` the nodes are told from these, and each value is looked up once."""
    sized = values.select("column", "node", F.lit(1).alias("size"), (F.char_length("value") == 1).cast("int").alias(
        "singles")) if places is None else places
    sizes = sized.groupBy(F.col("column").alias("c"), F.col("node").alias("m")).agg(
        F.sum("size").alias("size"), F.sum("singles").alias("singles"))
    largest = sizes.groupBy("c").agg(
        F.max_by("m", F.struct("size", "m")).alias("m"), (F.sum("size") - F.max("size")).alias("others"),
        F.sum("singles").alias("singles"))
    counts = largest.collect()  # one row for each column
    kind = largest.schema["m"].dataType.simpleString()
    largest = small_table(values.sparkSession, [{"c": r["c"], "m": plain_value(r["m"])} for r in counts], f"c:string,m:{kind}")
    inside = (F.col("column") == F.col("c")) & (F.col("node") == F.col("m"))
    noded = values if places is None else places
    main, rest = (noded.join(largest, inside, how) for how in ("left_semi", "left_anti"))
    if places is not None:
        main, rest = (_located(values, part, length) for part in (main, rest))
    few, singles = sum(r["others"] for r in counts) <= FEW_VALUES, any(r["singles"] for r in counts)
    return main, write_out(rest, "rest"), few, singles


def _sharing(main: DataFrame, rest: DataFrame) -> DataFrame:
    """Those of the main values that hold a bigram of the others.

    Plain text functions on pieces of a fixed size, which do not slow down with the length of a text.
    """
    bigram = F.substring(F.col("piece"), F.col("i"), F.lit(2)).alias("gram")

    def grams(rows: DataFrame, *kept: str) -> DataFrame:
        last = F.greatest(F.lit(0), F.char_length("value") - 2) / F.lit(PIECE)
        pieces = rows.where(F.char_length("value") > 1).select(*kept, "value", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("k"))
        pieces = pieces.select(*kept, "value", F.substring(F.col("value"), F.col("k") * PIECE + 1, F.lit(PIECE + 1)).alias("piece"))
        return pieces.select(*kept, "value", "piece", F.explode(F.sequence(F.lit(1), F.char_length("piece") - 1)).alias("i")).select(
            *kept, "value", bigram)

    # One text a column, of the characters of few values: most main values are left out by it at once.
    held_chars = rest.select(F.col("column").alias("cc"), F.explode(F.split("value", "")).alias("char")).groupBy("cc").agg(
        F.concat_ws("", F.collect_set("char")).alias("chars"))
    holds = (F.col("column") == F.col("cc")) & F.expr("translate(value, chars, '') != value")
    main = main.join(held_chars, holds, "left_semi")
    wanted = grams(rest, "column").select(F.col("column").alias("c"), F.col("gram").alias("g")).distinct()
    held = (F.col("column") == F.col("c")) & (F.col("gram") == F.col("g"))
    return grams(main, "column", "node").join(wanted, held, "left_semi").select("column", "value", "node").distinct()


def _near_main(rest: DataFrame, main: DataFrame, min_score: float, few: bool) -> DataFrame:
    """Edges between the other nodes and the largest one of their column.

    One pass over the largest node finds its values' bigrams that any other value has. The first bigrams
    of each other value, from rare to common among those, are looked up there. Few other values mostly
    share no bigram with most of that node, so values without any are left out before.
    """
    if few:
        main = _sharing(main, rest)
    sized = _sized(rest).where("total > 0").withColumn(
        "prefix", F.size("distinct") - _least_shared(min_score, min_score) + 1)
    wanted = sized.select(F.col("column").alias("c"), F.explode("distinct").alias("g")).distinct()
    large = _sized(main).where("total > 0").select("column", "value", "node", "total", "repeats", F.explode("distinct").alias("gram"))
    held = (F.col("column") == F.col("c")) & (F.col("gram") == F.col("g"))
    known = write_out(large.join(wanted, held, "left_semi"), "main-grams")
    freq = known.groupBy(F.col("column").alias("c"), F.col("gram").alias("g")).agg(F.count("*").alias("freq"))
    carried = ["column", "value", "node", "total", "repeats", "prefix"]
    tokens = sized.select(*carried, F.explode("distinct").alias("gram")).join(freq, held, "left")
    # Small in bytes but long to compare: a fixed number of partitions, not merged by size.
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = tokens.repartition(parts, "column", "value").groupBy(*carried).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "gram"))).alias("listed"))
    probes = listed.select(*carried, F.posexplode("listed").alias("place", "found")).where("found.freq > 0")
    probes = probes.withColumn("gram", F.col("found.gram")).drop("found")
    if not few:
        probes = write_out(probes, "probes")
    looked_up = known.select(
        F.col("column").alias("c"), F.col("value").alias("v"), F.col("node").alias("m"), F.col("total").alias("t"),
        F.col("repeats").alias("r"), F.col("gram").alias("g"))
    value, v = F.col("value"), F.col("v")
    longer = F.greatest(F.char_length(value), F.char_length(v))
    like_length = F.least(F.char_length(value), F.char_length(v)) >= longer * F.lit(min_score - _ROUNDING)
    of_first = F.when(value < v, F.col("total")).otherwise(F.col("t"))
    enough = F.lit(2.0) * of_first >= (F.col("total") + F.col("t")) * min_score - _ROUNDING
    placed = (F.col("place") < F.col("prefix")) | (F.col("r") > 0)
    met = looked_up.join(probes, [held, placed & (like_length | enough)])
    near = _reaches(F.least("value", "v"), F.greatest("value", "v"), min_score).alias("near")
    scored = met.select(F.inline(F.array(F.struct(F.col("node").alias("a"), F.col("m").alias("b"), near))))
    return scored.where("near").select("a", "b")


def _containment_edges(values: DataFrame) -> DataFrame:
    """A one-character value scores 1.0 with every value that holds the character."""
    singles = write_out(values.where(F.char_length("value") == 1).select(
        F.col("column").alias("c"), F.col("value").alias("char"), F.col("node").alias("a")
    ), "singles")  # few, and mostly none: the size of the files tells Spark so
    holders = values.where(F.char_length("value") > 1).select(
        "column", F.col("node").alias("b"), F.explode(F.array_distinct(F.split("value", ""))).alias("held")
    )
    held = (F.col("c") == F.col("column")) & (F.col("char") == F.col("held"))
    return holders.join(singles, held).select("a", "b").distinct()


def _root_edges(rest: DataFrame, main: DataFrame) -> DataFrame:
    """Nodes with one collapsed root, linked to the smallest of them outside the largest node.

    The values of the largest node need none among themselves; only those that begin like another
    value can have its root.
    """
    firsts = rest.select(F.col("column").alias("c"), F.left("value", F.lit(1)).alias("first")).distinct()
    begun = (F.col("column") == F.col("c")) & (F.left("value", F.lit(1)) == F.col("first"))
    rows = rest.select("column", "value", "node").unionByName(
        main.select("column", "value", "node").join(firsts, begun, "left_semi"))

    def rooted(values: DataFrame) -> DataFrame:
        return values.where(F.char_length("value") > 0).select(
            "node", "column", collapsed_root(F.col("value")).alias("root"))

    hubs = rooted(rest).groupBy(F.col("column").alias("c"), F.col("root").alias("r")).agg(F.min("node").alias("a"))
    linked = rooted(rows).join(hubs, (F.col("column") == F.col("c")) & (F.col("root") == F.col("r")))
    return linked.select("a", F.col("node").alias("b")).where(F.col("a") != F.col("b"))


def _with_components(values: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges, few=FEW_EDGES).withColumnRenamed("node", "linked")
    joined = values.join(found, F.col("node") == F.col("linked"), "left")
    return joined.withColumn("component", F.coalesce("component", "node")).drop("node", "linked")


def _group_by_edges(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(column, value, n, group): the group is named after its smallest value."""
    placed = _with_components(values, edges)
    names = placed.groupBy(F.col("component").alias("comp")).agg(F.min("value").alias("group"))
    return placed.join(names, F.col("component") == F.col("comp")).select("column", "value", "n", "group")


def _linked(values: DataFrame, min_score: float, use_prefix: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The values with their nodes, the edges between nodes that join them as the three scores do, and rows
    (column, node, size, n) that count the values of the nodes, several for one node.

    Texts with the same first characters are one node from the start, or else texts similar to
    their neighbour in sorted order. Texts with the same collapsed root are linked to one node
    instead of to one another. Such groups cost as many edges as they have members.
    """
    if not 2 / 3 < min_score <= 1:
        raise ValueError("min_score must be above 2/3: below it similar texts may share no bigram")
    length = next((k for k, s in PREFIX_SCORES.items() if use_prefix and s >= min_score), None)
    if length:
        places = _places(values, length, min_score)
        main, rest, few, singles = _main_and_rest(values, places, length)
        values, sizes = _located(values, places, length), places
    if not length or not few:
        values = _merged_by_endings(values, min_score) if length else _with_nodes(values, min_score, min_score, min_score)
        main, rest, few, singles = _main_and_rest(values)
        sizes = values.select("column", "node", F.lit(1).alias("size"), "n")

    def among_others() -> DataFrame:
        postings = _postings(rest, min_score, min_score, True, 0, few)
        near = _scored(postings, min_score, min_score, min_score, True, 0, few)
        return near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    kinds = [lambda: _near_main(rest, main, min_score, few), among_others]  # the longest first
    if ROOT_SCORE >= min_score:
        kinds.append(lambda: _root_edges(rest, main))
    if singles:
        kinds.append(lambda: _containment_edges(values))

    def written(edges: Callable[[], DataFrame]) -> DataFrame:
        return write_out(edges().distinct(), "edges")

    with ThreadPoolExecutor(len(kinds)) as pool:  # edges of one kind need no others
        found = [in_background(pool, values.sparkSession, partial(written, kind)) for kind in kinds]
        return values, reduce(DataFrame.unionByName, [f.result() for f in found]), sizes


def group_values(values: DataFrame, min_score: float = 0.72, use_prefix: bool = True) -> DataFrame:
    """Groups of texts linked by any of the three scores at or above ``min_score``."""
    return _group_by_edges(*_linked(values, min_score, use_prefix)[:2])


def group_sizes(values: DataFrame, min_score: float = 0.72, use_prefix: bool = True) -> DataFrame:
    """(column, members, n) of each group of ``group_values``, without naming it or its members."""
    _, edges, sizes = _linked(values, min_score, use_prefix)
    return _with_components(sizes, edges).groupBy("column", "component").agg(
        F.sum("size").alias("members"), F.sum("n").alias("n")).drop("component")


def fuzzy_groups(df: DataFrame, column: str, min_score: float = 0.72, use_prefix: bool = True) -> DataFrame:
    """(group, value, n) for every distinct value; a value like no other is a group of its own.

    At the default score any two values with the same first two characters fall together;
    ``use_prefix=False`` leaves that score out.
    """
    return group_values(text_values(df, [column]), min_score, use_prefix).select("group", "value", "n")


def suggest_unification(df: DataFrame, column: str, min_score: float = 0.85) -> DataFrame:
    """(canonical, variant, n) for every group of two or more similar values.

    The canonical value is the most frequent, then the smallest. ``unify_values`` takes the result.
    """
    values = text_values(df, [column])
    classes = _short_classes(values)
    if SHORT + 1 in {total for total, _ in classes}:
        short = F.char_length("value") <= SHORT + 1
        longer = _with_nodes(values.where(~short), min_score, min_score, None).select("column", "value", "n", "node")
        own = _node(F.col("column"), F.col("value")).alias("node")
        values = write_out(longer.unionByName(values.where(short).select("column", "value", "n", own)), "nodes")
        postings = _postings(values, min_score, None, True, SHORT)
        pairs = _scored(postings, min_score, None, min_score, True, SHORT)
        edges = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
        edges = edges.unionByName(_short_links(values, classes, min_score))
    else:
        values = values.withColumn("node", _node(F.col("column"), F.col("value")))
        edges = _short_links(values, classes, min_score)
    groups = _group_by_edges(values, edges.unionByName(_containment_edges(values)))
    return canonical_values(groups).select("canonical", "variant", "n")


def canonical_values(groups: DataFrame) -> DataFrame:
    """(column, canonical, variant, n) of the groups with two or more members."""
    best = groups.groupBy(F.col("column").alias("c"), F.col("group").alias("g")).agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"), F.count("*").alias("members")
    )
    joined = groups.join(best, (F.col("column") == F.col("c")) & (F.col("group") == F.col("g")))
    return joined.where("members > 1").select("column", "canonical", F.col("value").alias("variant"), "n")
