"""Closed frequent itemsets and their rules by key-set counting inference.

A set is a *key* if each of its proper subsets has more baskets. Sets grow by one item a level. A candidate has all its
subsets of one item less among the frequent sets; only candidates whose subsets are all keys are counted in the baskets,
as any other has the least support of its subsets. Kept are keys and the sets that are a key and one item more: these
decide every closure, and there are at most (keys x items) of them, however large the groups of items that always occur
together. The closure of a key holds the items that leave its support as it is; every closed set is such a closure.

All tables are distributed and joined by sort-merge joins whose inputs adaptive execution can split: no broadcast, no
window, nothing on the driver but counts (of baskets, of rows of a level, and of baskets by the power of two of their
size). Within a set items stand by ascending support, so that few sets share a prefix and a count starts from the rarest
item's baskets. Pairs of items are emitted only from baskets of at most `t` frequent items, `t` being the least power of
two that fewer than half as many baskets exceed as the least support is; the larger ones are asked only for the pairs
that the others leave possible, which loses none.

Defined results: rows with a null basket or item are no part of any basket; repeated rows count once; an item of every
basket is in every closed set; no baskets give no sets; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.store import materialize

#: Elements of sets: an item after its support, so that sets sort by both.
_ITEM = "named_struct('s', s, 'i', i)"


def _merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def _without(sets: DataFrame, *columns: str) -> DataFrame:
    """A row for each item of each set: the rest of the set, the item, and the named columns."""
    parts = F.expr("transform(sequence(0, size(set) - 1), j -> named_struct('rest', filter(set, (x, k) -> k <> j), 'item', set[j]))")
    return sets.select(*columns, F.explode(parts).alias("_p")).select(*columns, "_p.rest", "_p.item")


def _pairs(baskets: DataFrame, least: int) -> DataFrame:
    """baskets (b, s, i) of frequent items -> frequent pairs (set, support)."""
    sizes = materialize(baskets.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "sizes")
    by_size = sorted(sizes.groupBy(F.ceil(F.log2("n")).cast("int").alias("p")).count().collect(), reverse=True)
    t, larger = 1 << 62, 0
    for p, n in by_size:  # at most 64 rows
        t = 1 << p
        if 2 * (larger + n) >= least:
            break
        larger += n
    many = sizes.filter(F.col("n") > t).select("b")
    small = _merge(baskets, many, "b", "left_anti") if larger else baskets
    lists = small.groupBy("b").agg(F.sort_array(F.collect_list(F.expr(_ITEM))).alias("v")).filter("size(v) > 1")
    pairs = F.expr("flatten(transform(sequence(1, size(v) - 1), k -> transform(slice(v, k + 1, size(v)), y -> array(v[k - 1], y))))")
    found = lists.select(F.explode(pairs).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least - larger)
    if larger:
        found = materialize(found, "pairs")
        rows = materialize(_merge(baskets, many, "b", "left_semi").select("b", "i"), "large")
        found = _add(found, _occurrences(found, rows, 2))
    return found.filter(F.col("support") >= least)


def _occurrences(sets: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(set, n): for sets that occur whole in baskets, of rows (b, i), the number of these."""
    at = sets.select("set")
    for k in range(size):
        at = at.withColumn("i", F.col("set")[k]["i"])
        at = _merge(rows, at, ["b", "i"] if k else "i").select("set", "b")
    return at.groupBy("set").agg(F.count(F.lit(1)).alias("n"))


def _add(sets: DataFrame, more: DataFrame) -> DataFrame:
    total = F.col("support") + F.coalesce("n", F.lit(0))
    return _merge(sets, more, "set", "left").select("set", total.alias("support"))


def _candidates(level: DataFrame, size: int) -> DataFrame:
    """level (set, support, key) of sets of `size` items -> (set, least, keys): sets of one item more that have all their
    subsets there, the least support of these and how many are keys."""
    ends = level.select(F.slice("set", 1, size - 1).alias("p"), F.col("set")[size - 1].alias("z"))
    joined = _merge(ends, ends.select("p", F.col("z").alias("y")), "p").filter("z < y")
    parts = _without(joined.select(F.concat("p", F.array("z", "y")).alias("set")), "set")
    known = level.select(F.col("set").alias("rest"), "support", "key")
    found = _merge(parts, known, "rest").groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.min("support").alias("least"), F.count_if("key").alias("keys"))
    return found.filter(F.col("n") == size + 1).filter("keys > 0").drop("n")


def closed_itemsets(lines: DataFrame, basket: str, item: str, least_count: int = 12, least_share: tuple[int, int] = (1, 10_000)) -> tuple[DataFrame, DataFrame, int]:
    """The closed itemsets (items: ascending, support) of at least `least_count` baskets and the share of all baskets,
    the frequent items (i, s: support), and the number of baskets. Items are whole numbers."""
    b, i = F.col(basket).alias("b"), F.col(item).cast("long").alias("i")
    rows = materialize(lines.filter(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(b, i).distinct(), "baskets")
    total = rows.groupBy("b").agg(F.lit(1).alias("one")).count()
    num, den = least_share
    least = max(least_count, -(-total * num // den), 1)
    single = materialize(rows.groupBy("i").agg(F.count(F.lit(1)).alias("s")).filter(F.col("s") >= least), "single")
    everywhere = single.filter(F.col("s") == total).select("i")  # each takes a row of every basket
    mined = single.filter(F.col("s") < total)
    baskets = materialize(_merge(rows, mined, "i").select("b", "s", "i"), "frequent")
    level = mined.select(F.array(F.expr(_ITEM)).alias("set"), F.col("s").alias("support"), F.lit(True).alias("key"))
    keys, grown, size = [level], [], 1
    while True:
        if size == 1:
            pairs = _pairs(baskets, least)
            new = pairs.withColumn("key", F.col("support") < F.array_min(F.transform("set", lambda x: x["s"])))
        else:
            found = materialize(_candidates(level, size), "candidates")
            asked = found.filter(F.col("keys") == size + 1)
            counted = _merge(_occurrences(asked, baskets.select("b", "i"), size + 1).filter(F.col("n") >= least), asked, "set")
            new = counted.select("set", F.col("n").alias("support"), (F.col("n") < F.col("least")).alias("key"))
            new = new.unionByName(found.filter(F.col("keys") <= size).select("set", F.col("least").alias("support"), F.lit(False).alias("key")))
        level, size = materialize(new, "level"), size + 1
        if not level.head(1):
            break
        grown.append(level)
        keys.append(level.filter("key").select("set", "support", "key"))
    closed = _closures(keys, grown)
    if everywhere.head(1):
        always = F.lit(sorted(r["i"] for r in everywhere.collect())).cast("array<bigint>")  # no more than a basket has items on average
        closed = closed.withColumn("items", F.array_sort(F.concat("items", always)))
        closed = closed.unionByName(everywhere.limit(1).select(always.alias("items"), F.lit(total).cast("long").alias("support")))
    return materialize(closed, "closed"), single, total


def _closures(keys: list[DataFrame], grown: list[DataFrame]) -> DataFrame:
    """A key's closure adds each item with which it still has its support."""
    every = keys[0]
    for more in keys[1:]:
        every = every.unionByName(more)
    added = None
    for level in grown:
        part = _without(level, "support").select(F.col("rest").alias("set"), "support", F.col("item")["i"].alias("more"))
        added = part if added is None else added.unionByName(part)
    own = every.select("set", "support")
    if added is not None:
        more = _merge(added, own, ["set", "support"]).groupBy("set").agg(F.collect_set("more").alias("more"))
        own = _merge(own, more, "set", "left")
    else:
        own = own.withColumn("more", F.lit(None).cast("array<bigint>"))
    items = F.array_sort(F.concat(F.transform("set", lambda x: x["i"]), F.coalesce("more", F.array().cast("array<bigint>"))))
    return own.select(items.alias("items"), "support").distinct()


def with_rules(closed: DataFrame, single: DataFrame, total: int, least_confidence: int = 30) -> DataFrame:
    """closed with `rules`: structs (c, a, s) by ascending c, of each item c that the rest of its set foretells: in at
    least so many percent of the rest's a baskets, and more often than c's s baskets among all.

    What a closed set without one item has for closure lies within the set, so its support is its own if it is closed,
    else the set's."""
    one = F.expr("transform(sequence(0, size(items) - 1), j -> named_struct('rest', filter(items, (x, k) -> k <> j), 'c', items[j]))")
    parts = closed.filter("size(items) > 1").select("items", "support", F.explode(one).alias("_p")).select("items", "support", "_p.rest", "_p.c")
    of_rest = closed.select(F.col("items").alias("rest"), F.col("support").alias("_a"))
    known = _merge(_merge(parts, of_rest, "rest", "left"), single.select(F.col("i").alias("c"), "s"), "c").withColumn("a", F.coalesce("_a", "support"))
    holds = (100 * F.col("support") >= least_confidence * F.col("a")) & (F.col("support") * F.lit(total).cast("long") > F.col("a") * F.col("s"))
    rules = known.filter(holds).groupBy("items").agg(F.sort_array(F.collect_list(F.struct("c", "a", "s"))).alias("rules"))
    return _merge(closed, rules, "items", "left").select("items", "support", F.coalesce("rules", F.expr("array()").cast("array<struct<c:bigint,a:bigint,s:bigint>>")).alias("rules"))
