"""Graph patterns and algorithms over nodes (id) and edges (src, dst).

Iterative algorithms keep one row per node and write it after each round to the folder that all executors share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.components import components as linked
from ..functions.order import cumulative
from ..functions.storage import bucketed, cut, dealt, spread, spread_names, sweep, written


def undirected(edges: DataFrame) -> DataFrame:
    """Each link in both directions, once, without self-loops."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    return e.union(e.select("dst", "src"))


def adjacency(edges: DataFrame) -> DataFrame:
    """undirected(), written in buckets of src: rounds that join it on src shuffle what they send, not the links."""
    e = edges.select("src", "dst").where("src <> dst")
    return dealt(e.union(e.select("dst", "src")), "src")


def between(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(src, dst, own, other): each link once, src < dst, with the communities of its ends; member is (id, community). Links are dealt by src before they are taken once, so that the first join doesn't shuffle them again."""
    e = spread(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst"), "src").distinct()
    return e.join(member.select(F.col("id").alias("src"), F.col("community").alias("own")), "src").join(member.select(F.col("id").alias("dst"), F.col("community").alias("other")), "dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def typed_degrees(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, out_<kind>..., in_<kind>..., total_out, total_in): edges (src, dst, type) that leave and reach each node, by their type; totals are of all types. Nodes without an edge are left out."""
    ends = edges.select("type", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("way")))).alias("e")).select("e.*", "type")
    is_ = lambda way: F.col("way") == way
    ways = ("out", "in")
    counts = [F.count_if(is_(w) & (F.col("type") == k)).alias(f"{w}_{k}") for w in ways for k in kinds]
    return ends.groupBy("id").agg(*counts, *(F.count_if(is_(w)).alias(f"total_{w}") for w in ways))


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(seed, id, hops) of all within k steps of a seed, by least number of steps."""
    both = undirected(edges)
    found = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops"))
    front = found
    for step in range(1, k + 1):
        front = front.join(both, front.id == both.src).select("seed", F.col("dst").alias("id"), F.lit(step).alias("hops")).distinct().join(found.select("seed", "id"), ["seed", "id"], "left_anti")
        found = cut(found.unionByName(front))
        front = found.where(F.col("hops") == step)
    return found


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest reachable id, that of itself for a node without links."""
    own = linked(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "id")
    return nodes.select("id").join(own, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, start: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank); rank of nodes without an out-edge is shared by all. It ends when a round changes less than tolerance a node in all, or after rounds.

    start (id, weight summing to 1) makes it personalised: jumps and dangling rank go by weight.
    """
    links = edges.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("out"))
    n = nodes.count()
    if start is None:
        base = nodes.select("id", F.lit(1.0 / max(1, n)).alias("weight"))
    else:
        base = nodes.select("id").join(start, "id", "left").na.fill(0.0, ["weight"])
    base = cut(base.join(out, base.id == out.src, "left").select("id", "weight", "out"))
    share = cut(links.join(out, "src"))
    rank = base.select("id", F.col("weight").alias("rank"), "weight", "out")
    for _ in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = share.join(rank.select("id", "rank"), share.src == rank.id).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = rank.withColumnRenamed("rank", "was").join(got, F.col("id") == F.col("dst"), "left").crossJoin(F.broadcast(lost))
        value = (1 - damping) * F.col("weight") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("weight"))
        rank = cut(new.select("id", value.alias("rank"), "weight", "out", "was"))
        if tolerance and (rank.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) < tolerance * n:
            break
        rank = rank.drop("was")
    return rank.select("id", "rank")


def pagerank_limit(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """(id, rank) that pagerank() comes near to, summing to 1: the tolerance is for the whole graph, not for a node.

    Rank of nodes without an out-edge goes the way of jumps, so it only scales the ranks: they are the sum, over the lengths of walks, of what walks
    from everywhere bring along, scaled to 1. A round takes the walks one step on and keeps the nodes they reach; it ends when they bring
    less than tolerance of all, at the latest after the longest walk where there is no circle.
    """
    links = edges.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("out"))
    share = cut(links)
    base = cut(nodes.join(out, F.col("id") == F.col("src"), "left").select("id", "out"))
    n = base.count()
    front = base.select("id", F.lit(1.0 / max(1, n)).alias("rank"), "out")
    steps, total = [front], 1.0
    while True:
        got = share.join(front.where("out IS NOT NULL").select(F.col("id").alias("src"), (damping * F.col("rank") / F.col("out")).alias("part")), "src")
        front = cut(got.groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("rank")).join(base, "id"))
        brought = front.agg(F.sum("rank")).first()[0] or 0.0
        steps, total = [*steps, front], total + brought
        if brought < tolerance * total:
            break
    every = steps[0].select("id", "rank")
    for s in steps[1:]:
        every = every.unionByName(s.select("id", "rank"))
    return every.groupBy("id").agg((F.sum("rank") / total).alias("rank"))


def hits(nodes: DataFrame, edges: DataFrame, rounds: int = 1000, tolerance: float = 1e-10) -> DataFrame:
    """(id, hub, authority), each summing to 1, over directed links without loops, until hubs change less than tolerance in all."""
    links = dealt(edges.select("src", "dst").where("src <> dst"), "src")
    back = dealt(links, "dst")
    n = nodes.count()
    score = nodes.select("id", F.lit(1.0 / max(1, n)).alias("hub"))

    def unit(df: DataFrame, c: str) -> DataFrame:
        norm = df.agg(F.sum(c).alias("norm"))
        return df.crossJoin(F.broadcast(norm)).withColumn(c, F.coalesce(F.try_divide(c, "norm"), F.lit(0.0))).drop("norm")

    for _ in range(rounds):
        a = links.join(score.select("id", "hub"), links.src == score.id).groupBy("dst").agg(F.sum("hub").alias("a"))
        score = unit(score.select("id", F.col("hub").alias("was")).join(a, F.col("id") == a.dst, "left").select("id", "was", F.coalesce("a", F.lit(0.0)).alias("authority")), "authority")
        score = cut(score)
        h = back.join(score.select("id", "authority"), back.dst == score.id).groupBy("src").agg(F.sum("authority").alias("h"))
        score = cut(unit(score.join(h, score.id == h.src, "left").select("id", "was", F.coalesce("h", F.lit(0.0)).alias("hub"), "authority"), "hub"))
        if tolerance and (score.agg(F.sum(F.abs(F.col("hub") - F.col("was")))).first()[0] or 0.0) < tolerance:
            break
    return score.select("id", "hub", "authority")


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles): each link points to the end with more neighbours, so a node points to few, at most the root of twice the links.

    A node sends each that it points to the list of those after it, where it is met with that one's own list: no wedge is a row.
    """
    both = undirected(edges)
    d = both.groupBy("src").agg(F.count("*").alias("d"))
    order = lambda c: F.struct(F.col(f"{c}d"), F.col(c))
    up = both.join(d.select(F.col("src"), F.col("d").alias("srcd")), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("dstd")), "dst").where(order("src") < order("dst")).select("src", "dst", "dstd")
    up = cut(up)
    lists = cut(up.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("dstd", "dst"))), lambda x: x["dst"]).alias("own")))
    sent = lists.select(F.col("src").alias("x"), "own", F.posexplode("own").alias("at", "y")).where(F.col("at") < F.size("own") - 1).select("x", "y", F.expr("slice(own, at + 2, size(own))").alias("later"))
    met = sent.join(lists.withColumnRenamed("src", "y"), "y").select("x", "y", F.array_intersect("own", "later").alias("z")).where(F.size("z") > 0)
    one = F.lit(1).cast("long")
    ends = F.concat(F.array(*(F.struct(F.col(c).alias("id"), F.size("z").cast("long").alias("n")) for c in ("x", "y"))), F.transform("z", lambda z: F.struct(z.alias("id"), one.alias("n"))))
    return met.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.sum("e.n").alias("triangles"))


def shared_neighbours(pairs: DataFrame) -> DataFrame:
    """pairs (left, right): left ends with a common right end, with how many, Jaccard and Adamic-Adar."""
    p = pairs.distinct()
    size, fame = p.groupBy("left").agg(F.count("*").alias("n")), p.groupBy("right").agg(F.count("*").alias("f"))
    known = p.join(fame, "right")
    a, b = known.alias("a"), known.alias("b")
    met = a.join(b, (F.col("a.right") == F.col("b.right")) & (F.col("a.left") < F.col("b.left")))
    met = met.groupBy(F.col("a.left").alias("a"), F.col("b.left").alias("b")).agg(F.count("*").alias("common"), F.sum(1 / F.ln(F.col("a.f"))).alias("adamic_adar"))
    met = met.join(size.select(F.col("left").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("left").alias("b"), F.col("n").alias("nb")), "b")
    return met.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"), "adamic_adar")


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(community, inside, cut, conductance, part) and with their sum of parts the modularity; member is (id, community)."""
    m = between(edges, member).groupBy(F.col("own").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("n"))
    n = F.col("n")
    ends = m.select(F.explode(F.array(*(F.struct(F.col(c).alias("community"), F.when(F.col("a") == F.col("b"), n).otherwise(0).alias("inside"), n.alias("volume")) for c in ("a", "b")))).alias("e")).select("e.*")
    c = ends.groupBy("community").agg(F.sum("inside").alias("inside"), F.sum("volume").alias("volume"))
    c = c.crossJoin(F.broadcast(c.agg(F.sum("volume").alias("total"))))  # one row
    part = F.col("inside") / F.col("total") - F.pow(F.col("volume") / F.col("total"), 2)
    away = F.col("volume") - F.col("inside")
    return c.select("community", (F.col("inside") / 2).cast("long").alias("inside"), away.alias("cut"), F.coalesce(F.try_divide(away, F.least("volume", F.col("total") - F.col("volume"))), F.lit(0.0)).alias("conductance"), part.alias("part"), F.sum(part).over(Window.partitionBy(F.lit(0))).alias("modularity"))


def partitions_agreement(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of two partitions: adjusted Rand index and normalised mutual information, from counts per cell."""
    c = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    c = c.withColumn("x", F.sum("n").over(Window.partitionBy("a"))).withColumn("y", F.sum("n").over(Window.partitionBy("b"))).withColumn("t", F.sum("n").over(Window.partitionBy(F.lit(0))))
    two = lambda v: v * (v - 1) / 2
    p = F.col("n") / F.col("t")
    s = c.agg(
        F.sum(two(F.col("n"))).alias("nn"), F.sum(F.col("n") / F.col("x") * two(F.col("x"))).alias("xx"), F.sum(F.col("n") / F.col("y") * two(F.col("y"))).alias("yy"), F.max("t").alias("t"),
        F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("x") * F.col("y")))).alias("mi"), F.sum(-p * F.ln(F.col("x") / F.col("t"))).alias("hx"), F.sum(-p * F.ln(F.col("y") / F.col("t"))).alias("hy"),
    )
    chance = F.col("xx") * F.col("yy") / two(F.col("t"))
    return s.select(((F.col("nn") - chance) / ((F.col("xx") + F.col("yy")) / 2 - chance)).alias("ari"), (2 * F.col("mi") / (F.col("hx") + F.col("hy"))).alias("nmi"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of two versions: added, removed or changed rows."""
    a, b = old.select(*keys, F.col(value).alias("old"), F.lit(1).alias("_a")), new.select(*keys, F.col(value).alias("new"), F.lit(1).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, keys, "full").withColumn("change", kind).where("change IS NOT NULL").select(*keys, "change", "old", "new")


def core_numbers(nodes: DataFrame | None, edges: DataFrame, block: int = 6_000_000, least: int = 500_000) -> DataFrame:
    """(id, core): the largest k for which a node is in a part where all have k neighbours or more. Without nodes, those that have links.

    Starting from the degrees, every node takes the largest h for which h neighbours have h or more, until nothing changes;
    this ends at the core numbers. Nodes are dealt by hash into blocks of about `block` links (of `least` or more where there are fewer blocks than
    shuffle partitions), whose links are written once, in buckets. A block keeps what it last heard of its neighbours, and works out again only nodes that
    what it hears leaves short of neighbours; in a round a node whose number fell tells each block that has neighbours of it once, and links are neither
    shuffled nor made rows. A node's links lie in one block, so memory grows with the largest degree. Ids that aren't numbers are numbered in their order first.
    """
    if dict(edges.dtypes)["src"] not in ("bigint", "int"):
        return _numbered_cores(nodes, edges, block, least)
    once = edges.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).where("src <> dst")
    once, spark = cut(spread(once, "src", "dst").distinct()), edges.sparkSession
    n = 2 * once.count()
    many = max(1, -(-n // block), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // least)))
    names = F.array(*map(F.lit, spread_names(spark, many)))
    of = lambda c: F.element_at(names, (F.pmod(F.xxhash64(c), F.lit(many)) + 1).cast("int"))
    packed, settled = _block_steps()
    keyed = once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(of("src").alias("block"), "src", "dst", of("dst").alias("home"))
    held = bucketed(keyed.groupBy("block").applyInPandas(packed, "block int, id binary, degree binary, at binary, near binary, home binary, who binary, to binary"), "block")
    sweep(spark)
    news, shape, old = None, "block int, core binary, heard binary, id binary, fell binary", []
    while True:
        before = spark.createDataFrame([], shape) if news is None else news
        news = cut(held.groupBy("block").cogroup(before.groupBy("block")).applyInPandas(settled, shape))
        del before
        sweep(spark, *old)
        old = written[-1:]
        if news.where("fell IS NOT NULL").isEmpty():
            break
    found = held.select("block", "id").join(news.where("core IS NOT NULL").select("block", "core"), "block")
    core = cut(found.mapInPandas(_unpacked(), "id long, core long"))
    return core if nodes is None else nodes.select("id").distinct().join(core, "id", "left").select("id", F.coalesce("core", F.lit(0).cast("long")).alias("core"))


def _numbered_cores(nodes: DataFrame | None, edges: DataFrame, *how: int) -> DataFrame:
    """core_numbers() of ids of any type that has an order, by their place in it."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL").distinct().withColumn("n", F.lit(1).cast("long"))
    place = cut(cumulative(ids, "id", ["n"]).select("id", F.col("upto_n").alias("place")))
    of = lambda c: place.select(F.col("id").alias(c), F.col("place").alias(f"_{c}"))
    links = edges.join(of("src"), "src").join(of("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    core = core_numbers(None, links, *how).withColumnRenamed("id", "place").join(place, "place").select("id", "core")
    return core if nodes is None else nodes.select("id").distinct().join(core, "id", "left").select("id", F.coalesce("core", F.lit(0).cast("long")).alias("core"))


def _unpacked():
    def rows(batches):
        for batch in batches:
            for ids, core in batch[["id", "core"]].itertuples(index=False):
                yield pd.DataFrame({"id": np.frombuffer(ids, "<i8"), "core": np.frombuffer(core, "<i4").astype(np.int64)})

    return rows


def _block_steps():  # within a function, so that executors are sent them and need no copy of this module
    def packed(links: pd.DataFrame) -> pd.DataFrame:
        """A block's links (block, src, dst, home: the block of dst) as one row: its ids, how many links each has, each link's place in near, the different
        neighbours and their blocks; and which id (who) has neighbours in which block (to)."""
        src, dst, home = (links[c].to_numpy() for c in ("src", "dst", "home"))
        order = np.argsort(src, kind="stable")
        src, dst, home = src[order], dst[order], home[order]
        starts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        degree = np.diff(starts, append=len(src))
        near, first, at = np.unique(dst, return_index=True, return_inverse=True)
        most = int(home.max()) + 1
        who, to = np.divmod(np.unique(np.repeat(np.arange(len(starts)), degree) * most + home), most)
        parts = (src[starts], degree.astype(np.int32), at.astype(np.int32), near, home[first].astype(np.int32), who.astype(np.int32), to.astype(np.int32))
        row = [int(links["block"].iat[0]), *(p.tobytes() for p in parts)]
        return pd.DataFrame([row], columns=["block", "id", "degree", "at", "near", "home", "who", "to"])

    def settled(held: pd.DataFrame, news: pd.DataFrame) -> pd.DataFrame:
        """A block's state (core, heard: its neighbours' numbers) once it has taken in what it is told, and a row (id, fell) for each other block that has to hear of it."""
        row = held.iloc[0]
        me = int(row["block"])
        ids, degree, at, near, home, who, to = (np.frombuffer(row[c], t) for c, t in zip(("id", "degree", "at", "near", "home", "who", "to"), ("<i8", "<i4", "<i4", "<i8", "<i4", "<i4", "<i4"), strict=True))
        starts = np.cumsum(degree, dtype=np.int64) - degree
        inner = np.flatnonzero(home == me)
        own_of, near_of = np.full(len(near), -1, np.int32), np.full(len(ids), -1, np.int32)
        own_of[inner] = np.searchsorted(ids, near[inner])
        near_of[own_of[inner]] = inner

        def links_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where the links of some nodes are, and where each node's begin among them."""
            many = degree[some].astype(np.int64)
            begins = np.cumsum(many) - many
            return np.repeat(starts[some] - begins, many) + np.arange(int(many.sum())), begins

        kept = news[news["core"].notna()]
        first = not len(kept)
        if first:
            core, heard = degree.copy(), np.full(len(near), np.iinfo(np.int32).max, np.int32)
            heard[inner] = core[own_of[inner]]
            short = np.arange(len(ids))
        else:
            core, heard = np.frombuffer(kept["core"].iat[0], "<i4").copy(), np.frombuffer(kept["heard"].iat[0], "<i4").copy()
            for told, fell in news.loc[news["fell"].notna(), ["id", "fell"]].itertuples(index=False):
                heard[np.searchsorted(near, np.frombuffer(told, "<i8"))] = np.frombuffer(fell, "<i4")
            enough = np.add.reduceat(heard[at] >= np.repeat(core, degree), starts, dtype=np.int32)
            short = np.flatnonzero(enough < core)
        was = core.copy()
        while len(short):
            where, begins = links_of(short)
            which = np.repeat(np.arange(len(short), dtype=np.int64), degree[short])
            seen = np.minimum(heard[at[where]], core[short][which])
            # each node's numbers from the greatest on: as many as stand no further than they say
            turned = np.sort((which << 32) - seen)
            best = (which << 32) - turned >= np.arange(len(where)) - begins[which] + 1
            now = np.add.reduceat(best, begins, dtype=np.int32)
            fell = short[now < core[short]]
            core[short] = now
            fell_near = near_of[fell]
            fell = fell[fell_near >= 0]
            heard[fell_near[fell_near >= 0]] = core[fell]
            around = own_of[at[links_of(fell)[0]]]
            short = np.unique(around[around >= 0])
        changed = np.ones(len(core), bool) if first else core != was
        sent = changed[who] & (to != me)
        who, to = who[sent], to[sent]
        order = np.argsort(to, kind="stable")
        who, to = who[order], to[order]
        out = [(me, core.tobytes(), heard.tobytes(), None, None)]
        for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
            if len(part):
                out.append((int(to[part[0]]), None, None, ids[who[part]].tobytes(), core[who[part]].tobytes()))
        return pd.DataFrame(out, columns=["block", "core", "heard", "id", "fell"])

    return packed, settled


def clustering(edges: DataFrame) -> DataFrame:
    """(id, neighbours, links, coefficient): how many of a node's pairs of neighbours are linked; 0 with fewer than two."""
    both = cut(undirected(edges))
    d = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("neighbours"))
    t = d.join(triangles(both), "id", "left").select("id", "neighbours", F.coalesce("triangles", F.lit(0).cast("long")).alias("links"))
    pairs = F.col("neighbours") * (F.col("neighbours") - 1) / 2
    return t.withColumn("coefficient", F.when(F.col("neighbours") > 1, F.col("links") / pairs).otherwise(0.0))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    return nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


def distances(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, id, hops) from each seed (id) of a stated set to all that it reaches, breadth first, as far as most steps."""
    return walked(adjacency(edges), seeds, most)


def walked(both: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """distances() over an adjacency. Each step is kept apart and written once; what it meets is looked up in the last two steps alone, as a node's neighbours are at most one step from it."""
    front = cut(seeds.select(F.col("id").alias("seed"), "id").distinct())
    before, parts, step = None, [front.withColumn("hops", F.lit(0).cast("long"))], 0
    while most is None or step < most:
        step += 1
        seen = front if before is None else front.unionByName(before)
        met = both.join(front, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        before, front = front, cut(met.join(seen, ["seed", "id"], "left_anti"))
        if front.isEmpty():
            break
        parts.append(front.withColumn("hops", F.lit(step).cast("long")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def closeness(reached: DataFrame, n: int) -> DataFrame:
    """distances() of each seed as closeness (n - 1) / sum, scaled by the share that is reached, harmonic mean and eccentricity."""
    d = reached.where("hops > 0")
    c = d.groupBy("seed").agg(F.count("*").alias("reached"), F.sum("hops").alias("total"), F.sum(1 / F.col("hops")).alias("h"), F.max("hops").alias("eccentricity"))
    share = F.col("reached") / (n - 1)
    return c.select("seed", "reached", (F.col("reached") / F.col("total") * share).alias("closeness"), (F.col("h") / (n - 1)).alias("harmonic"), "eccentricity")


def shortest_path(edges: DataFrame, start: str | int, stop: str | int, most: int = 6) -> DataFrame:
    """(place, id) of the first shortest path in the order of ids: breadth first from start, then back from stop."""
    spark, both = edges.sparkSession, adjacency(edges)
    kind = dict(both.dtypes)["src"]
    found = walked(both, spark.createDataFrame([(start,)], f"id {kind}"), most)
    end = found.where(F.col("id") == stop).first()
    path, at = [], stop if end else None
    for hops in range(end["hops"] if end else -1, -1, -1):
        path.append((hops, at))
        if hops:
            before = both.where(F.col("src") == at).join(found.where(F.col("hops") == hops - 1), F.col("dst") == F.col("id")).agg(F.min("id")).first()
            at = before[0]
    return spark.createDataFrame(path, f"place long, id {kind}")


def simple_paths(edges: DataFrame, seeds: DataFrame, most: int = 4, value: str | None = None, otherwise: float = 1.0) -> DataFrame:
    """(nodes, hops, product) of all directed paths of at most so many steps from seeds (id) that meet no node twice.

    product multiplies an edge's value (otherwise where it is null) along the path. What grows here are the paths
    themselves, so edges should be few or steps short.
    """
    e = edges.select("src", "dst", (F.coalesce(F.col(value), F.lit(otherwise)) if value else F.lit(1.0)).alias("v"))
    front = seeds.select(F.array("id").alias("nodes"), F.lit(0).cast("long").alias("hops"), F.lit(1.0).alias("product"))
    out = None
    for _ in range(most):
        front = front.join(e, F.element_at("nodes", -1) == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        front = cut(front.select(F.array_append("nodes", F.col("dst")).alias("nodes"), (F.col("hops") + 1).alias("hops"), (F.col("product") * F.col("v")).alias("product")))
        out = front if out is None else out.unionByName(front)
    return out


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, label): each round every node takes its neighbours' most frequent label, the least of equals, until none changes or after rounds.

    In the first round all labels differ, so that the least neighbour's wins. After it a round sends a label along each link, to be counted where it arrives.
    """
    both = adjacency(edges)
    best = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("new"))
    label = nodes.select("id", F.col("id").alias("label"))
    for at in range(rounds):
        if at:
            votes = both.join(label, both.src == label.id).select("dst", "label").repartition("dst").groupBy("dst", "label").agg(F.count("*").alias("n"))
            best = votes.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("id", F.col("b.label").alias("new"))
        new = cut(label.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), F.col("label").alias("was")))
        label = new.select("id", "label")
        if new.where("label <> was").isEmpty():
            break
    return label


def _xml(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def lines(nodes: DataFrame, edges: DataFrame, form: str) -> DataFrame:
    """(part, line): text lines of a graph. Written in the order of part they are a file of the form.

    Forms: sif, tgf, dot, ndjson, graphml, nt (N-Triples), csv, cypher. Lines of one part may be in any order.
    """
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    iri = lambda kind, c: F.concat(F.lit(f"<urn:{kind}:"), F.col(c), F.lit(">"))
    field = lambda c: F.when(F.col(c).rlike('[",\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))

    def of(part: int, df: DataFrame, line: Column) -> DataFrame:
        return df.select(F.lit(part).alias("part"), line.alias("line"))

    def fixed(part: int, *text: str) -> DataFrame:
        return edges.sparkSession.createDataFrame([(part, t) for t in text], "part int, line string")

    if form == "sif":
        return of(1, edges, F.concat_ws("\t", "src", "type", "dst"))
    if form == "tgf":
        return of(1, nodes, F.concat_ws(" ", "id", "label")).unionByName(fixed(2, "#")).unionByName(of(3, edges, F.concat_ws(" ", "src", "dst", "type")))
    if form == "dot":
        node = F.concat(F.lit("  "), quote(F.col("id")), F.lit(" [label="), quote(F.col("label")), F.lit("];"))
        edge = F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(" [label="), quote(F.col("type")), F.lit("];"))
        return fixed(0, "digraph G {").unionByName(of(1, nodes, node)).unionByName(of(2, edges, edge)).unionByName(fixed(3, "}"))
    if form == "ndjson":
        return of(1, edges, F.to_json(F.struct("src", "dst", "type")))
    if form == "graphml":
        node = F.concat(F.lit('<node id="'), _xml("id"), F.lit('"><data key="label">'), _xml("label"), F.lit("</data></node>"))
        edge = F.concat(F.lit('<edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"><data key="type">'), _xml("type"), F.lit("</data></edge>"))
        head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="type" for="edge" attr.name="type" attr.type="string"/><graph edgedefault="directed">'
        return fixed(0, head).unionByName(of(1, nodes, node)).unionByName(of(2, edges, edge)).unionByName(fixed(3, "</graph></graphml>"))
    if form == "nt":
        return of(1, nodes, F.concat(iri("node", "id"), F.lit(" <urn:label> "), quote(F.col("label")), F.lit(" ."))).unionByName(of(2, edges, F.concat_ws(" ", iri("node", "src"), iri("type", "type"), iri("node", "dst"), F.lit("."))))
    if form == "csv":
        return fixed(0, "src,dst,type").unionByName(of(1, edges, F.concat_ws(",", field("src"), field("dst"), field("type"))))
    if form == "cypher":
        return of(1, nodes, F.concat(F.lit("MERGE (n {id: "), quote(F.col("id")), F.lit("}) SET n:"), F.col("label"), F.lit(";"))).unionByName(
            of(2, edges, F.concat(F.lit("MATCH (a {id: "), quote(F.col("src")), F.lit("}), (b {id: "), quote(F.col("dst")), F.lit("}) MERGE (a)-[:"), F.upper("type"), F.lit("]->(b);")))
        )
    raise ValueError(f"unknown form {form}")
