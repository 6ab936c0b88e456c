"""Order-dependent steps on change sets too large for one worker, as rounds of joins: cycles, levels, clusters of names.

Each function gives the rows of its kernel twin. Change sets of up to `most` edges or names are counted out first and go to the
kernel, many to a batch; only larger ones take rounds, as many as the longest way that a mark has to go. What a round leaves is written below `path`, or below
spark.checkpoint.dir, so lineage stays short and a lost executor loses nothing; the driver sees counts alone.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, grouping, splitting
from .deps import with_ends

#: Edges, or names of changes, of a change set that one worker takes.
MOST = 1_000_000
#: Share of the undecided that a round must decide, else pairs are formed.
PROGRESS = 0.05


class _Work:
    """A folder of tables, each written once and read back."""

    def __init__(self, df: DataFrame, path: str | None):
        spark = df.sparkSession
        base = path or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            raise RuntimeError("rounds need a path or spark.checkpoint.dir")
        self.base = f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex}"
        self.paths: dict = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of keep() that nothing reads any more."""
        for table in tables:
            path, _ = self.paths.pop(id(table))
            spark = table.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _parted(rows: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows, which are written, of change sets up to `most` rows, and of larger ones; None where there are none."""
    sizes = rows.groupBy("split_id").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > most).select("split_id")
    if not large.head(1):
        return rows, None
    if not most or not sizes.filter(F.col("n") <= most).head(1):
        return None, rows
    return rows.join(large, "split_id", "left_anti"), rows.join(large, "split_id", "left_semi")


def _trimmed(edges: DataFrame, work: _Work) -> DataFrame:
    """edges without those that lie on no cycle because nothing leads to them, or from them, on and on."""
    n, given = edges.count(), edges
    while n:
        before = edges
        heads = edges.select("split_id", F.col("target").alias("source")).distinct()
        tails = edges.select("split_id", F.col("source").alias("target")).distinct()
        edges = work.keep(edges.join(heads, ["split_id", "source"], "left_semi").join(tails, ["split_id", "target"], "left_semi").select("split_id", "source", "target"))
        if before is not given:
            work.drop(before)
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def _spread(edges: DataFrame, marks: DataFrame, work: _Work) -> DataFrame:
    """marks (split_id, node, mark) after every mark has followed the edges to where a greater one stood."""
    given = last = marks
    while True:
        along = edges.join(marks.withColumnRenamed("node", "source"), ["split_id", "source"]).select("split_id", F.col("target").alias("node"), F.col("mark").alias("got"))
        along = along.groupBy("split_id", "node").agg(F.min("got").alias("got"))
        out = work.keep(marks.join(along, ["split_id", "node"], "left").select("split_id", "node", F.least("mark", "got").alias("mark"), (F.col("got") < F.col("mark")).alias("moved")))
        if last is not given:
            work.drop(last)
        last, marks = out, out.drop("moved")
        if not out.filter("moved").head(1):
            return marks


def _rings(edges: DataFrame, work: _Work) -> DataFrame | None:
    """split_id, change_id, scc of the nodes of distinct edges (split_id, source, target) that lie on a cycle: every node gets the
    least node that reaches it; those that reach that node back are its component; the others go another round."""
    found = None
    while True:
        edges = _trimmed(edges, work)
        if not edges.head(1):
            return found
        nodes = edges.select("split_id", F.col("source").alias("node")).unionByName(edges.select("split_id", F.col("target").alias("node"))).distinct()
        colours = _spread(edges, nodes.withColumn("mark", F.col("node")), work)
        side = lambda c: colours.select("split_id", F.col("node").alias(c), F.col("mark").alias(f"{c}_mark"))  # noqa: E731, B023
        same = edges.join(side("source"), ["split_id", "source"]).join(side("target"), ["split_id", "target"]).filter("source_mark = target_mark")
        same = work.keep(same.select("split_id", "source", "target", F.col("source_mark").alias("mark")))
        reached = work.keep(colours.filter("node = mark"))
        while True:  # against the edges, from the least node of each colour
            back = same.join(reached.select("split_id", F.col("node").alias("target"), "mark"), ["split_id", "target", "mark"]).select("split_id", F.col("source").alias("node"), "mark").distinct()
            new = work.keep(back.join(reached, ["split_id", "node"], "left_anti"))
            if not new.head(1):
                break
            before, reached = reached, work.keep(reached.unionByName(new))
            work.drop(before, new)
        rings = reached.select("split_id", F.col("node").alias("change_id"), F.col("mark").alias("scc"))
        several = rings.groupBy("split_id", "scc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("split_id", "scc")
        rings = work.keep(rings.join(several, ["split_id", "scc"], "left_semi"))
        found = rings if found is None else found.unionByName(rings)
        done = reached.select("split_id", F.col("node").alias("source"))
        edges = work.keep(same.join(done, ["split_id", "source"], "left_anti").join(done.withColumnRenamed("source", "target"), ["split_id", "target"], "left_anti").select("split_id", "source", "target"))


def cycles(deps: DataFrame, least_strength: float | None = None, most: int = MOST, path: str | None = None) -> DataFrame:
    """graph.cycles for change sets of any size."""
    edges = deps if least_strength is None else deps.filter(F.col("strength") >= least_strength)
    work = _Work(deps, path)
    # Written first: the edges are read several times.
    pairs = work.keep(edges.filter("source <> target").select("split_id", "source", "target").distinct())
    small, large = _parted(pairs, most)
    rings = None if large is None else _rings(large, work)
    if small is None and rings is not None:
        return rings.select("split_id", "change_id", "scc")
    out = graph.cycles(pairs.limit(0) if small is None else small).select("split_id", "change_id", "scc")
    return out if rings is None else out.unionByName(rings.select("split_id", "change_id", "scc"))


def levels(nodes: DataFrame, deps: DataFrame, most: int = MOST, path: str | None = None) -> DataFrame:
    """graph.levels for change sets of any size: a round settles all changes whose prerequisites are settled, and goes over
    the edges of the others alone; a change without edges is at level 0. Where none is left to settle, the last edge of
    each cycle that remains, in the order of its ends, is cut."""
    own = nodes.select("split_id", "change_ord", "change_id")
    work = _Work(nodes, path)
    pairs = work.keep(deps.select("split_id", "source", "target").filter("source <> target").distinct())
    small, large = _parted(pairs, most)
    if large is None:
        return graph.levels(nodes, pairs)
    edges = with_ends(large, own, "change_ord").filter("s is not null and t is not null")
    edges = work.keep(edges.select("split_id", "source", "target", F.col("s.change_ord").alias("source_ord"), F.col("t.change_ord").alias("target_ord")))
    # below: the target's level, null while it is not settled.
    heads = edges.select("split_id", F.col("source").alias("target"), F.lit(True).alias("waits")).distinct()
    live = work.keep(edges.join(heads, ["split_id", "target"], "left").withColumn("below", F.when(F.col("waits").isNull(), 0)).drop("waits"))
    work.drop(edges)
    told = lambda now: now.select("split_id", F.col("change_id").alias("target"), F.col("level").alias("got"))
    settled = []
    while live.head(1):
        state = live.groupBy("split_id", "source").agg(F.count(F.lit(1)).alias("n"), F.count("below").alias("k"), F.max("below").alias("below"))
        now = work.keep(state.filter("n = k").select("split_id", F.col("source").alias("change_id"), (F.col("below") + 1).alias("level")))
        rest = live
        if now.head(1):
            settled.append(now)
            rest = live.join(now.select("split_id", F.col("change_id").alias("source")), ["split_id", "source"], "left_anti")
        else:
            rings = _rings(work.keep(live.filter("below is null").select("split_id", "source", "target")), work)
            mark = lambda c: rings.select("split_id", F.col("change_id").alias(c), F.col("scc").alias(f"{c}_scc"))  # noqa: E731, B023
            inner = live.join(mark("source"), ["split_id", "source"]).join(mark("target"), ["split_id", "target"]).filter("source_scc = target_scc")
            last = inner.groupBy("split_id", "source_scc").agg(F.max_by(F.struct("source", "target"), F.struct("source_ord", "target_ord")).alias("e")).select("split_id", "e.*")
            cut = work.keep(last)
            rest = live.join(cut, ["split_id", "source", "target"], "left_anti")
            # A change whose last edge is cut has no row left to settle it.
            free = cut.select("split_id", "source").distinct().join(rest.select("split_id", "source").distinct(), ["split_id", "source"], "left_anti")
            now = free.select("split_id", F.col("source").alias("change_id"), F.lit(0).alias("level"))
        before = live
        live = work.keep(rest.join(told(now), ["split_id", "target"], "left").withColumn("below", F.coalesce("got", "below")).select("split_id", "source", "target", "source_ord", "target_ord", "below"))
        work.drop(before)
    rows = own if small is None else own.join(small.select("split_id").distinct(), "split_id", "left_anti")
    done = functools.reduce(DataFrame.unionByName, settled) if settled else None
    rows = rows.withColumn("level", F.lit(0)) if done is None else rows.join(done, ["split_id", "change_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    nth = _places(work.keep(rows.select("split_id", "change_ord", "change_id", "level")), work)
    if small is None:
        return nth
    rest = nodes.join(small.select("split_id").distinct(), "split_id", "left_semi")
    return graph.levels(rest, small).select("split_id", "change_id", "level", "place").unionByName(nth)


def _places(rows: DataFrame, work: _Work) -> DataFrame:
    """rows with their place in the order of level and change_ord: a level's start by running sums over levels, the place
    within it by ranges of the sort, so no task sorts a whole change set."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["split_id", "level", "change_ord"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = work.keep(dealt)
    work.drop(rows)
    part = F.shiftrightunsigned("at", 33)
    sizes = dealt.groupBy("split_id", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    before = F.sum("n").over(Window.partitionBy("split_id").orderBy("part")) - F.col("n")
    sizes = sizes.select("split_id", "part", (before - F.col("low")).alias("shift"))
    return dealt.withColumn("part", part).join(sizes, ["split_id", "part"]).select("split_id", "change_id", F.col("level").cast("int").alias("level"), (F.col("at") + F.col("shift")).alias("place"))


def _similar(pairs: DataFrame, sets: DataFrame, over: float) -> DataFrame:
    """pairs (split_id, a, b) whose sets have a Jaccard over `over`."""
    side = lambda c: sets.select("split_id", F.col("change_ord").alias(c), F.col("names").alias(f"{c}_names"))
    rows = pairs.join(side("a"), ["split_id", "a"]).join(side("b"), ["split_id", "b"])
    common = F.size(F.array_intersect("a_names", "b_names"))
    return rows.filter(common / (F.size("a_names") + F.size("b_names") - common) > over).select("split_id", "a", "b")


def symbol_groups(symbols: DataFrame, over: float = 0.3, most: int = MOST, path: str | None = None) -> DataFrame:
    """splitting.symbol_groups for change sets of any size.

    Changes with equal names go with the first of them. A change is a seed when none before it that shares a key is undecided
    or has taken it; each round settles all seeds at once, and each key meets one seed a round, so a name that all changes
    hold costs its holders, not their square. Where keys alone decide too few, links between similar changes take their place.
    """
    work = _Work(symbols, path)
    held = work.keep(symbols.select("split_id", "name", "change_id", "change_ord").distinct())
    small, large = _parted(held, most)
    if large is None:
        return splitting.symbol_groups(held)
    rep = F.min("change_ord").over(Window.partitionBy("split_id", "names"))
    every = grouping.held_sets(large, 2).withColumn("rep", rep)
    # Names stand at the first change that holds them alone.
    every = work.keep(every.select("split_id", "rep", "change_ord", "change_id", F.when(F.col("rep") == F.col("change_ord"), F.col("names")).alias("names")))
    member = every.drop("names")
    sets = every.filter("names is not null").select("split_id", "change_ord", "names")
    keys = work.keep(grouping.similar_keys(sets.withColumnRenamed("change_ord", "id"), over).withColumnRenamed("id", "change_ord"))
    undecided = work.keep(sets.select("split_id", "change_ord"))
    taken = []
    left, paired = undecided.count(), False
    while left:
        mine = keys.join(undecided, ["split_id", "change_ord"], "left_semi")
        lead = F.min("change_ord").over(Window.partitionBy("split_id", "key"))
        held_up = mine.withColumn("lead", lead).filter("lead < change_ord").select("split_id", "change_ord").distinct()
        seeds = work.keep(undecided.join(held_up, ["split_id", "change_ord"], "left_anti"))
        of_seed = keys.join(seeds, ["split_id", "change_ord"], "left_semi").select("split_id", "key", F.col("change_ord").alias("a"))
        pairs = of_seed.join(keys.withColumnRenamed("change_ord", "b"), ["split_id", "key"]).filter("a < b").select("split_id", "a", "b").distinct()
        links = work.keep(_similar(pairs, sets, over))
        taken.append(links)
        gone = seeds.unionByName(links.select("split_id", F.col("b").alias("change_ord")))
        before = undecided
        undecided = work.keep(undecided.join(gone, ["split_id", "change_ord"], "left_anti"))
        work.drop(before, seeds)
        now = undecided.count()
        if not paired and now and left - now < PROGRESS * left:
            one, two = keys.join(undecided, ["split_id", "change_ord"], "left_semi").withColumnRenamed("change_ord", "a"), keys.withColumnRenamed("change_ord", "b")
            each = one.join(two, ["split_id", "key"]).filter("a <> b").select("split_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            each = _similar(each, sets, over).withColumn("key", F.struct(F.concat_ws(",", "a", "b").alias("name"), F.lit(0).alias("low"), F.lit(0).alias("high")))
            keys, paired = work.keep(each.select("split_id", F.explode(F.array("a", "b")).alias("change_ord"), "key")), True
        left = now
    if not taken:
        return splitting.symbol_groups(held.limit(0) if small is None else small)
    seed_of = functools.reduce(DataFrame.unionByName, taken).groupBy("split_id", F.col("b").alias("rep")).agg(F.min("a").alias("seed"))
    rows = member.join(seed_of, ["split_id", "rep"], "left").withColumn("seed", F.coalesce("seed", "rep"))
    ordered = F.array_sort(F.collect_list(F.struct("change_ord", "change_id")))
    out = rows.groupBy("split_id", "seed").agg(F.transform(ordered, lambda x: x["change_id"]).alias("change_ids")).filter(F.size("change_ids") > 1)
    out = out.select("split_id", F.col("change_ids")[0].alias("key"), F.col("seed").cast("int").alias("first"), F.lit(0.8).alias("score"), "change_ids")
    return out if small is None else splitting.symbol_groups(small).select(*out.columns).unionByName(out)
