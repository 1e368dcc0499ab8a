"""Graph operators over edges (dependent, dependency): an edge says dependent needs dependency.

Traversals run level by level, as DataFrames at every size. Two things keep the rounds and the
rows few. Runs of nodes with one dependency and one dependent each are contracted first, by
pointers that double their reach every round, so a chain of any length costs rounds by its
logarithm. And a node carries the seeds that reach it as bits, 64 to a row: a round joins only
the newest bits with the edges and combines them by `bit_or` before they are shuffled. Nulls
are no nodes; an edge from a node to itself changes nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.operators.loops import cut, cut_counted, forget

MERGE_ROUNDS = 32  # after so many, nodes on longer ways round stay apart
ROUNDS_KEPT = 8  # tables of seen bits that are read one by one before they become one


def _back_edges(edges: DataFrame) -> DataFrame:
    """(dependency, dependent), once each, written."""
    return cut(edges.filter("dependent is not null and dependency is not null and dependent <> dependency").select("dependency", "dependent").distinct())


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def chains(back: DataFrame, kept: DataFrame) -> DataFrame | None:
    """(node, start, from_start, end, to_end, last) of every node with one dependency and one dependent
    that is not in `kept` (node): the first other nodes on both sides, the steps to them, and the
    chain's node next to the end. Rings without any other node are left out. None where there are none."""
    before = back.groupBy(F.col("dependent").alias("node")).agg(F.count("*").alias("n"), F.min("dependency").alias("start")).filter("n = 1").drop("n")
    after = back.groupBy(F.col("dependency").alias("node")).agg(F.count("*").alias("n"), F.min("dependent").alias("end")).filter("n = 1").drop("n")
    one = F.lit(1).cast("long")
    inner, count = cut_counted(before.join(after, "node").join(kept, "node", "left_anti").select("node", "start", one.alias("from_start"), "end", one.alias("to_end"), F.col("node").alias("last")))
    if not count:
        return None
    rows = inner
    for _ in range(count.bit_length() + 1):
        left = rows.select(F.col("node").alias("start"), F.col("start").alias("start_2"), F.col("from_start").alias("from_2"))
        right = rows.select(F.col("node").alias("end"), F.col("end").alias("end_2"), F.col("to_end").alias("to_2"), F.col("last").alias("last_2"))
        both = rows.join(left, "start", "left").join(right, "end", "left")
        moved = F.col("start_2").isNotNull() | F.col("end_2").isNotNull()
        rows, open_ = cut_counted(
            both.select(
                "node", F.coalesce("start_2", "start").alias("start"), (F.col("from_start") + F.coalesce("from_2", F.lit(0))).alias("from_start"),
                F.coalesce("end_2", "end").alias("end"), (F.col("to_end") + F.coalesce("to_2", F.lit(0))).alias("to_end"), F.coalesce("last_2", "last").alias("last"), moved.alias("moved"),
            ),
            "moved",
        )
        if not open_:
            return rows
    return cut(rows.join(inner.select(F.col("node").alias("start")), "start", "left_anti"))  # without rings


def _contracted(back: DataFrame, inner: DataFrame | None) -> DataFrame:
    """(a, b, w, via): a needs b over w steps, the first of them to `via`; for each a and b the shortest,
    then least. Without the nodes of `inner`."""
    plain = back.select(F.col("dependent").alias("a"), F.col("dependency").alias("b"), F.lit(1).cast("long").alias("w"), F.col("dependency").alias("via"))
    if inner is None:
        return plain
    gone = inner.select("node")
    plain = plain.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti")
    long = inner.filter("to_end = 1 and start <> end").select(F.col("end").alias("a"), F.col("start").alias("b"), (F.col("from_start") + 1).alias("w"), F.col("node").alias("via"))
    best = plain.unionByName(long).groupBy("a", "b").agg(F.min(F.struct("w", "via")).alias("x"))
    return cut(best.select("a", "b", "x.w", "x.via"))


def _numbered(nodes: DataFrame) -> DataFrame:
    """(node, n): distinct nodes with numbers in node order, close together within a partition, written."""
    return cut(nodes.filter("node is not null").distinct().orderBy("node").withColumn("n", F.monotonically_increasing_id()))


def _marks(numbered: DataFrame) -> DataFrame:
    return numbered.select("node", F.shiftright("n", 6).alias("word"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("bits"))


def _bits(col: str = "bits") -> Column:
    """The numbers of the set bits within their word."""
    return F.expr(f"filter(sequence(0, 63), i -> getbit({col}, i) = 1)")


def _named(rows: DataFrame, numbered: DataFrame, name: str) -> DataFrame:
    """One row for each set bit, with the seed that it stands for as column `name`."""
    rows = rows.withColumn("bit", F.explode(_bits())).withColumn("n", F.shiftleft("word", 6) + F.col("bit")).drop("word", "bits", "bit")
    return rows.join(numbered.select("n", F.col("node").alias(name)), "n").drop("n")


def edges_of(evidence: DataFrame) -> DataFrame:
    return evidence.select("dependent", "dependency").distinct()


def grouped_evidence(evidence: DataFrame) -> DataFrame:
    """(dependent, dependency, evidence): ordered list without repeats."""
    fields = ("kind", "line", "col", "import", "name")
    once = evidence.groupBy("dependent", "dependency", *fields).agg(F.min(F.struct("stage", "seq")).alias("place"))
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("name").alias("by"), F.struct(*fields).alias("item"))), lambda a, b: _compare(a, b))
    return once.groupBy("dependent", "dependency").agg(F.transform(listed, lambda x: x["item"]).alias("evidence"))


def _compare(a, b):
    """Order of two evidence entries by stage, place and name."""
    key = lambda x: F.struct(x["place"], F.coalesce(x["by"], F.lit("")), x["item"]["line"], x["item"]["col"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def direct_dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("dependency")).distinct(), "dependency", "left_semi").select(F.col("dependent").alias("node")).distinct()


def _spread(marks: DataFrame, step: DataFrame) -> DataFrame:
    """(node, word, bits): the bits of `marks` (node, word, bits) and all that come to a node over `step` (node, to);
    no bit of a node stands in two rows."""
    new = cut(marks.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    seen = [new]
    while True:
        sent = new.join(step, "node").groupBy(F.col("to").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        old = _union(seen).groupBy("node", "word").agg(F.bit_or("bits").alias("old"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        new, count = cut_counted(sent.join(old, ["node", "word"], "left").select("node", "word", fresh.alias("bits")).filter("bits <> 0"))
        if not count:
            return _union(seen)
        seen.append(new)
        if len(seen) > ROUNDS_KEPT:
            whole = cut(_union(seen).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
            forget(*seen[:-1])
            seen = [whole]


def closure_bits(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, word, bits), (node, n)): the seeds that reach each node, themselves included, as bits, and
    the seeds' numbers: bit i of a word stands for the seed of number 64 x word + i."""
    back, numbered = _back_edges(edges), _numbered(seeds.select("node"))
    inner = chains(back, numbered.select("node"))
    step = _contracted(back, inner).select(F.col("b").alias("node"), F.col("a").alias("to"))
    reached = _spread(_marks(numbered), step)
    if inner is not None:
        passed = reached.withColumnRenamed("node", "start").join(inner.select("start", "node"), "start")
        reached = reached.unionByName(passed.select("node", "word", "bits"))
    return reached, numbered


def reverse_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): all nodes that depend on each seed, directly or not, the seed itself excepted.

    `seeds` has column `node`."""
    reached, numbered = closure_bits(edges, seeds)
    return _named(reached, numbered, "seed").filter("seed <> node").select("seed", "node")


def _runs(back: DataFrame, kept: DataFrame, numbered: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """((node, start, bottom, n, lo, hi, m, least, open), (bottom, end)) of every node with one dependency and one
    dependent that is not in `kept` (node), by pointers that double their reach every round. Its run goes down
    to `bottom`, which depends on the other node `start`; n seeds lie on it below the node, of numbers lo to hi,
    and m is the node's own. `end` is the other node above the run. Open rows are rings without any other node,
    of which `least` is the least. None where there are none."""
    before = back.groupBy(F.col("dependent").alias("node")).agg(F.count("*").alias("k"), F.min("dependency").alias("start")).filter("k = 1").drop("k")
    after = back.groupBy(F.col("dependency").alias("node")).agg(F.count("*").alias("k"), F.min("dependent").alias("end")).filter("k = 1").drop("k")
    both = before.join(after, "node").join(kept, "node", "left_anti").join(numbered.select("node", F.col("n").alias("m")), "node", "left")
    inner, count = cut_counted(both.select("node", "start", "end", "m"))
    if not count:
        return None
    none = F.lit(None).cast("long")
    rows = inner.select("node", "start", F.col("node").alias("bottom"), F.lit(0).cast("long").alias("n"), none.alias("lo"), none.alias("hi"), "m", F.col("node").alias("least"), F.lit(True).alias("open"))
    for turn in range(count.bit_length() + 2):
        ahead = rows.select(
            F.col("node").alias("start"), F.col("start").alias("start_2"), F.col("bottom").alias("bottom_2"), (F.col("n") + F.col("m").isNotNull().cast("long")).alias("n_2"),
            F.least("lo", "m").alias("lo_2"), F.greatest("hi", "m").alias("hi_2"), F.col("least").alias("least_2"), F.col("open").alias("open_2"),
        )
        moved = rows.filter("open").join(ahead, "start", "left").select(
            "node", F.coalesce("start_2", "start").alias("start"), F.coalesce("bottom_2", "bottom").alias("bottom"), (F.col("n") + F.coalesce("n_2", F.lit(0))).alias("n"),
            F.least("lo", "lo_2").alias("lo"), F.greatest("hi", "hi_2").alias("hi"), "m", F.least("least", "least_2").alias("least"), F.coalesce("open_2", F.lit(False)).alias("open"),
        )
        older = rows
        rows, left = cut_counted(rows.filter("not open").unionByName(moved).withColumn("still", F.col("open")), "still")
        if turn:
            forget(older)
        if not left:
            break
    tops = inner.join(inner.select(F.col("node").alias("end")), "end", "left_anti").select("node", "end")
    return rows, cut(rows.filter("not open").select("node", "bottom").join(tops, "node").select("bottom", "end"))


def _merged(back: DataFrame) -> DataFrame | None:
    """(node, rep): sets of two nodes or more that all reach each other, with the least of each; None where
    none is found. Any such sets may be merged, and what is not found is left to the traversal, so four edges of
    a node do, two each way by a hash, and rounds are bounded. Graphs of few edges, such as chains, are not tried."""
    nodes = back.select("dependency").union(back.select("dependent")).distinct().count()
    if 2 * back.count() < 3 * nodes:
        return None
    hashed = F.xxhash64("dependency", "dependent").alias("h")

    def few(one: str, other: str) -> DataFrame:
        ends = back.groupBy(one).agg(F.min(F.struct(hashed, other)).alias("x"), F.max(F.struct(hashed, other)).alias("y"))
        return ends.select(one, F.explode(F.array(f"x.{other}", f"y.{other}")).alias(other)).select("dependency", "dependent")

    some, count = cut_counted(few("dependent", "dependency").unionByName(few("dependency", "dependent")).distinct())
    for _ in range(MERGE_ROUNDS):  # without nodes that have edges on one side only
        both = some.select("dependency").intersect(some.select("dependent"))
        trimmed, left = cut_counted(some.join(both, "dependency", "left_semi").join(both.toDF("dependent"), "dependent", "left_semi").select("dependency", "dependent"))
        forget(some)
        some = trimmed
        if not left:
            return None
        if left == count:
            break
        count = left
    ways = some.select(F.col("dependency").alias("node"), F.col("dependent").alias("to"), F.lit(0).alias("way")).unionByName(some.select(F.col("dependent").alias("node"), F.col("dependency").alias("to"), F.lit(1).alias("way")))
    labels = cut(ways.select("node").distinct().select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), F.col("node").alias("label"), F.lit(True).alias("new")))
    for _ in range(MERGE_ROUNDS):  # the least node that reaches each, and that each reaches
        got = labels.filter("new").join(ways, ["node", "way"]).groupBy(F.col("to").alias("node"), "way").agg(F.min("label").alias("got"))
        less = F.coalesce(F.col("got") < F.col("label"), F.lit(False))
        older = labels
        labels, count = cut_counted(labels.drop("new").join(got, ["node", "way"], "left").select("node", "way", F.least("label", "got").alias("label"), less.alias("new"), less.alias("moved")), "moved")
        forget(older)
        if not count:
            break
    same = labels.filter("way = 0").select("node", F.col("label").alias("rep")).join(labels.filter("way = 1").select("node", F.col("label").alias("rep")), ["node", "rep"])
    merged, count = cut_counted(same.join(same.filter("node <> rep").select("rep").distinct(), "rep", "left_semi").select("node", "rep"))
    return merged if count else None


def closure_summary(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, n_causes, first_cause, last_cause): the number of seeds that a node depends on, directly or not, the
    least and the greatest of them, itself excepted; nodes without any are absent.

    `reverse_closure` grouped by node, where no pair becomes a row. Sets of nodes that reach each other are one node. Runs of nodes with one dependency
    and one dependent are left out of the traversal, seeds on them or not: their seeds count from the node above them on,
    and on the run itself a node has those below it and those of the node below the run."""
    back, numbered = _back_edges(edges), _numbered(seeds.select("node"))
    of, none = back.schema["dependent"].dataType, F.lit(None).cast("long")
    alone = (F.lit(None).cast(of).alias("bottom"), none.alias("add_n"), none.alias("add_lo"), none.alias("add_hi"))
    groups = _merged(back)
    if groups is None:
        groups, links = numbered.limit(0).select(F.col("node").cast(of).alias("node"), F.col("node").cast(of).alias("rep")), back
    else:
        links = back
        for end in ("dependency", "dependent"):
            links = links.join(groups.toDF(end, "rep"), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep").distinct()
        links = cut(links.filter("dependency <> dependent").select("dependency", "dependent"))
    places, above = groups.select("node", F.col("rep").alias("at"), *alone), groups.select("node", F.col("rep").alias("to"))
    step, closed = links.select(F.col("dependency").alias("node"), F.col("dependent").alias("to")), places.select("bottom").limit(0)
    runs = _runs(links, groups.select(F.col("rep").alias("node")).distinct(), numbered)
    if runs is not None:
        rows, ends = runs
        rings = rows.filter("open").select("node", F.col("least").alias("at"), *alone)
        places = cut(places.unionByName(rings).unionByName(rows.filter("not open").select("node", F.col("start").alias("at"), "bottom", F.col("n").alias("add_n"), F.col("lo").alias("add_lo"), F.col("hi").alias("add_hi"))))
        gone = rows.select("node")
        step = step.join(gone, "node", "left_anti").join(gone.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to")
        over = ends.join(rows.filter("node = bottom").select("bottom", "start"), "bottom")
        step = cut(step.unionByName(over.filter("start <> end").select(F.col("start").alias("node"), F.col("end").alias("to"))).distinct())
        above = above.unionByName(rows.filter("m is not null").join(ends, "bottom", "left").select("node", F.coalesce("end", "least").alias("to")))
    marks = numbered.join(above, "node", "left").select(F.coalesce("to", "node").alias("node"), "n")
    reached = _spread(_marks(marks), step)
    if runs is not None:  # runs below whose bottom their own seeds are found again lie on a cycle
        probe = rows.filter("not open").groupBy("bottom", "start").agg(F.min("m").alias("m")).filter("m is not null")
        probe = probe.select("bottom", F.col("start").alias("node"), F.shiftright("m", 6).alias("word"), F.expr("cast(m & 63 as int)").alias("bit"))
        closed = reached.join(probe, ["node", "word"]).filter("getbit(bits, bit) = 1").select("bottom").distinct()
    number = [F.shiftleft("word", 6) + f(_bits()) for f in (F.array_min, F.array_max)]
    total = (F.sum(F.bit_count("bits")).alias("c"), F.min(number[0]).alias("lo"), F.max(number[1]).alias("hi"))
    open_ = places.join(closed, "bottom", "left_anti").select("node", "add_n", "add_lo", "add_hi")
    nodes = back.select(F.col("dependent").alias("node")).distinct().join(places.select("node", "at"), "node", "left").select("node", F.coalesce("at", "node").alias("at"))
    nodes = cut(nodes.join(numbered, "node", "left"))
    own = F.when(F.col("word") == F.shiftright("n", 6), F.expr("shiftleft(1L, cast(n & 63 as int))")).otherwise(F.lit(0).cast("long"))
    others = F.col("bits").bitwiseAND(F.bitwise_not(own))
    here = reached.withColumnRenamed("node", "at")
    of_seeds = nodes.filter("n is not null").join(here, "at").select("node", "word", others.alias("bits")).filter("bits <> 0").groupBy("node").agg(*total)
    of_others = nodes.filter("n is null").select("node", "at").join(here.groupBy("at").agg(*total), "at").drop("at")
    sums = of_seeds.unionByName(of_others).join(open_, "node", "full")
    sums = sums.select("node", (F.coalesce("c", F.lit(0)) + F.coalesce("add_n", F.lit(0))).alias("n_causes"), F.least("lo", "add_lo").alias("lo"), F.greatest("hi", "add_hi").alias("hi")).filter("n_causes > 0")
    names = [numbered.select(F.col("n").alias(at), F.col("node").alias(name)) for at, name in (("lo", "first_cause"), ("hi", "last_cause"))]
    return sums.join(names[0], "lo").join(names[1], "hi").select("node", "n_causes", "first_cause", "last_cause")


def _distances(step: DataFrame, numbered: DataFrame) -> DataFrame:
    """(node, word, d, bits): the seeds whose shortest way up to the node has d steps, written."""
    new = cut(_marks(numbered).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")).withColumn("d", F.lit(0).cast("long")))
    edges = step.select(F.col("b").alias("node"), F.col("a").alias("to"), "w")
    seen = [new]
    while True:
        sent = new.join(edges, "node").groupBy(F.col("to").alias("node"), "word", (F.col("d") + F.col("w")).alias("d")).agg(F.bit_or("bits").alias("bits"))
        old = _union(seen).select("node", "word", F.col("d").alias("old_d"), F.col("bits").alias("old"))
        nearer = F.when(F.col("old_d") <= F.col("d"), F.col("old")).otherwise(F.lit(0).cast("long"))
        left = sent.join(old, ["node", "word"], "left").groupBy("node", "word", "d").agg(F.first("bits").alias("bits"), F.bit_or(nearer).alias("old"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        new, count = cut_counted(left.select("node", "word", "d", fresh.alias("bits")).filter("bits <> 0"))
        if not count:
            break
        seen.append(new.select(*seen[0].columns))
        if len(seen) > ROUNDS_KEPT:
            seen = [cut(_union(seen))]
    nearer = Window.partitionBy("node", "word").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("bits").over(nearer), F.lit(0).cast("long"))))
    return cut(_union(seen).groupBy("node", "word", "d").agg(F.bit_or("bits").alias("bits")).withColumn("bits", first).filter("bits <> 0"))


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(changed, affected, path): of the shortest paths from affected down to changed the least in
    node order; pairs without a path are absent. `pairs` has changed, affected."""
    pairs = cut(pairs.filter("changed is not null and affected is not null").select("changed", "affected").distinct())
    back, numbered = _back_edges(edges), _numbered(pairs.select(F.col("changed").alias("node")))
    inner = chains(back, pairs.select(F.col("changed").alias("node")).union(pairs.select("affected")).distinct())
    step = _contracted(back, inner)
    near = _distances(step, numbered)
    below = near.select(F.col("node").alias("b"), "word", F.col("d").alias("below"), F.col("bits").alias("theirs"))
    hops = near.withColumnRenamed("node", "a").join(step, "a").withColumn("below", F.col("d") - F.col("w")).join(below, ["b", "word", "below"])
    hops = hops.select("a", "word", F.col("bits").bitwiseAND(F.col("theirs")).alias("bits"), F.struct("via", "b", "w").alias("hop")).filter("bits <> 0")
    hops = cut(_named(hops, numbered, "changed").groupBy("changed", F.col("a").alias("at")).agg(F.min("hop").alias("hop")))
    none = F.array().cast(f"array<{hops.schema['hop'].dataType.simpleString()}>")
    open_, done = pairs.select("changed", "affected", F.col("affected").alias("at"), none.alias("hops")), []
    while True:
        done.append(open_.filter("at = changed").drop("at"))
        for _ in range(3):  # a few hops a round
            ahead = open_.filter("at <> changed").join(hops, ["changed", "at"]).select("changed", "affected", F.col("hop.b").alias("at"), F.concat("hops", F.array("hop")).alias("hops"))
            done.append(ahead.filter("at = changed").drop("at"))
            open_ = ahead
        open_, count = cut_counted(open_.filter("at <> changed"))
        done = [cut(_union(done))]
        if not count:
            break
    found = done[0]
    if inner is None:
        return found.select("changed", "affected", F.concat(F.array("affected"), F.transform("hops", lambda h: h["b"])).alias("path"))
    found = found.select("changed", "affected", F.posexplode_outer("hops").alias("place", "hop"))
    through = found.filter("hop.w > 1").withColumn("last", F.col("hop.via")).join(inner.select("last", F.col("node").alias("stop"), F.col("to_end").alias("offset")), "last")
    ends = found.filter("hop is not null").select("changed", "affected", "place", F.col("hop.w").alias("offset"), F.col("hop.b").alias("stop"))
    stops = ends.unionByName(through.select(*ends.columns)).unionByName(found.filter("coalesce(place, 0) = 0").select("changed", "affected", F.lit(0).alias("place"), F.lit(0).cast("long").alias("offset"), F.col("affected").alias("stop")))
    listed = F.array_sort(F.collect_list(F.struct("place", "offset", "stop")))
    return stops.groupBy("changed", "affected").agg(F.transform(listed, lambda x: x["stop"]).alias("path"))


def closure_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(changed, affected, path): for each pair of `reverse_closure`, what `shortest_paths` finds.

    A round sends the newest bits over the edges; of those that come to a node for the first time the least sender
    takes each, and so is their next hop down. Only pairs that others pass through are written
    with their paths; the others become rows at the end."""
    back, numbered = _back_edges(edges), _numbered(seeds.select("node"))
    step, zero = back.select(F.col("dependency").alias("node"), F.col("dependent").alias("to")), F.lit(0).cast("long")
    new = cut(_marks(numbered))
    seen, hops, last = [new], [], None
    level = cut(numbered.select("n", "node", F.array("node").alias("path")))  # paths of the last level but one
    paths = [level]
    lower = Window.partitionBy("node", "word").orderBy("via").rowsBetween(Window.unboundedPreceding, -1)

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select("node", "via", F.shiftleft("word", 6).alias("first"), F.explode(_bits()).alias("bit")).select("node", "via", (F.col("first") + F.col("bit")).alias("n"))

    def onward(rows: DataFrame, to: DataFrame) -> DataFrame:
        return pairs(rows).join(to.select("n", F.col("node").alias("via"), "path"), ["n", "via"]).select("n", "node", F.concat(F.array("node"), "path").alias("path"))

    while True:
        sent = new.join(step, "node").select(F.col("to").alias("node"), "word", F.col("node").alias("via"), "bits")
        old = _union(seen).groupBy("node", "word").agg(F.bit_or("bits").alias("old"))
        taken = F.coalesce(F.bit_or("bits").over(lower), zero).bitwiseOR(F.coalesce("old", zero))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(taken))
        found, count = cut_counted(sent.join(old, ["node", "word"], "left").select("node", "word", "via", fresh.alias("bits")).filter("bits <> 0"))
        if not count:
            break
        if last is not None:
            passed = found.groupBy(F.col("via").alias("node"), "word").agg(F.bit_or("bits").alias("passed"))
            through = last.join(passed, ["node", "word"]).select("node", "word", "via", F.col("bits").bitwiseAND(F.col("passed")).alias("bits")).filter("bits <> 0")
            level = cut(onward(through, level))
            paths.append(level)
        last = found
        hops.append(found)
        new = cut(found.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
        seen.append(new)
        if len(seen) > ROUNDS_KEPT:
            whole = cut(_union(seen).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
            forget(*seen[:-1])
            seen = [whole]
            for tables in (hops, paths):  # the newest are read on their own in the next round
                if len(tables) > 2:
                    joined = cut(_union(tables[:-1]))
                    forget(*tables[:-1])
                    tables[:-1] = [joined]
    forget(*{id(t): t for t in [*seen, new]}.values())
    if not hops:
        hops = [found.select("node", "word", "via", "bits")]
    done = onward(_union(hops), _union(paths))
    return done.select(F.element_at("path", -1).alias("changed"), F.col("node").alias("affected"), "path")


def path_steps(paths: DataFrame, evidence: DataFrame) -> DataFrame:
    """Consecutive pairs of each path with their evidence lists."""
    steps = paths.select("changed", "affected", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("ordinal", "dependent"))
    steps = steps.withColumn("dependency", F.element_at("path", F.col("ordinal") + 2)).drop("path")
    return steps.join(evidence, ["dependent", "dependency"], "left")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, dependencies, dependents): sorted lists of both directions."""
    ahead = edges.groupBy(F.col("dependent").alias("node")).agg(F.array_sort(F.collect_set("dependency")).alias("dependencies"))
    back = edges.groupBy(F.col("dependency").alias("node")).agg(F.array_sort(F.collect_set("dependent")).alias("dependents"))
    empty = F.array().cast(edges.schema["dependent"].dataType.simpleString().join(("array<", ">")))
    return ahead.join(back, "node", "full").select("node", F.coalesce("dependencies", empty).alias("dependencies"), F.coalesce("dependents", empty).alias("dependents"))


def edge_mutations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dependent, dependency, change): edges that were added or removed."""
    added = new.distinct().join(old, ["dependent", "dependency"], "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.distinct().join(new, ["dependent", "dependency"], "left_anti").withColumn("change", F.lit("removed")))
