"""Graph operators as loops over DataFrames.

A loop keeps one small DataFrame per round (frontier or labels), writes it to the shared checkpoint
folder and stops when a round adds nothing; only counts come to the driver. Rounds are bounded by the
depth of the graph, by a given depth, or by its logarithm where labels jump.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.session import durable


def pairs_of(edges: DataFrame) -> DataFrame:
    """Distinct (source, target) without nulls and self loops."""
    return edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct()


def turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))


def reach(pairs: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """id, depth and via (the least predecessor at the first depth) of all nodes that seeds reach; seeds have depth 0.

    Each node counts once, at its least depth. Unknown seeds reach only themselves, cycles end by
    themselves, an empty seed set gives no rows. Each round writes its frontier only; nodes seen so far
    are the union of the written frontiers.
    """
    frontier = seen = durable(seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")))
    level = 0
    while depth is None or level < depth:
        level += 1
        step = frontier.select(F.col("id").alias("source")).join(pairs, "source").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("via"))
        frontier = durable(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth"), "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % MERGED == 0:
            seen = durable(seen)
    return seen


#: Frontiers are written together once in so many rounds, which keeps plans short.
MERGED = 16


def reach_per_seed(pairs: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, id, depth) of the nodes within ``depth`` steps of each seed, each once at its least depth; all of them without ``depth``."""
    frontier = seen = durable(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct())
    level = 0
    while depth is None or level < depth:
        level += 1
        step = frontier.select("seed", F.col("id").alias("source")).join(pairs, "source").select("seed", F.col("target").alias("id")).distinct()
        frontier = durable(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % MERGED == 0:
            seen = durable(seen)
    return seen


def reach_counts(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, reached): how many nodes each seed reaches, itself among them.

    Seeds walk together: a node carries, per 64 seeds, one number whose bits are the seeds that reach it, and
    each round sends only bits that are new to a node. So 64 pairs of seed and node are one row, also where
    nearly every seed reaches nearly every node.
    """
    from stratagraph.operators.ordered import running_sum

    numbered = durable(running_sum(seeds.select("id").where("id is not null").distinct().withColumn("one", F.lit(1)), "id", "one", "n", "all").select("id", "n"))
    frontier = durable(numbered.select("id", F.expr("cast(floor(n / 64) as int)").alias("word"), F.expr("shiftleft(1L, cast(n % 64 as int))").alias("bits")))
    parts, level = frontier, 0
    while not frontier.isEmpty():
        level += 1
        step = frontier.withColumnRenamed("id", "source").join(pairs, "source").groupBy(F.col("target").alias("id"), "word").agg(F.bit_or("bits").alias("came"))
        known = parts.groupBy("id", "word").agg(F.bit_or("bits").alias("known"))
        new = F.col("came").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("bigint"))))
        frontier = durable(step.join(known, ["id", "word"], "left").select("id", "word", new.alias("bits")).where("bits <> 0"))
        parts = parts.unionByName(frontier)
        if level % 8 == 0:
            parts = durable(parts.groupBy("id", "word").agg(F.bit_or("bits").alias("bits")))
    seen = parts.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    sums = seen.groupBy("word").agg(*(F.sum(F.expr(f"shiftrightunsigned(bits, {k}) & 1L")).alias(f"b{k}") for k in range(64)))
    counts = sums.select("word", F.posexplode(F.array(*(f"b{k}" for k in range(64)))).alias("bit", "reached"))
    place = counts.select((F.col("word") * F.lit(64).cast("bigint") + F.col("bit")).alias("n"), "reached")
    return numbered.withColumn("n", F.col("n").cast("bigint")).join(place, "n").select(F.col("id").alias("seed"), "reached")


def _with_least(both: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """Rows (u, w) with m of their u. Nodes with more than a thousandth of the ``rows``, at most 1,000, are looked up by broadcast, so no task is sent a hub's rows."""
    hubs = durable(least.where(F.col("n") > max(1000, rows // 1000)).select("u", "m"))
    small = F.broadcast(hubs)
    return both.join(small.select("u"), "u", "left_anti").join(least.select("u", "m"), "u").unionByName(both.join(small, "u"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) of the undirected graph, the component named by its least id.

    Large-star and small-star rounds: every node hooks its neighbours to the least one, which halves
    distances; a hub is only ever the centre of a star, never a row with all its neighbours.
    """
    links = durable(pairs.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("w")).distinct())
    ids = links.select(F.col("u").alias("id")).union(links.select("w")).distinct()
    count = links.count()
    while True:
        both = links.union(links.select("w", "u"))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = durable(_with_least(both, least, 2 * count).where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").distinct())
        least = large.groupBy("u").agg(F.min("w").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, count).select(F.col("w").alias("u"), F.col("m").alias("w")).union(least.select("u", F.col("m").alias("w"))).where("u <> w")
        new = durable(small.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).distinct())
        before, count = count, new.count()
        if count == before and new.exceptAll(links).isEmpty():
            break
        links = new
    root = links.groupBy(F.col("u").alias("id")).agg(F.min("w").alias("component"))
    return ids.join(root, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(pairs: DataFrame) -> DataFrame:
    """(id, component) of the strongly connected components, named by their least id.

    Nodes without in- or out-edges are cut off as their own components. The rest is coloured: the least
    id that reaches a node is its colour, and the nodes of a colour that reach its least id form its
    component; these are taken out and the next round colours what is left.
    """
    left = durable(pairs)
    done = None
    while True:
        ids = durable(left.select(F.col("source").alias("id")).union(left.select("target")).distinct())
        if ids.isEmpty():
            break
        inner = left.select(F.col("source").alias("id")).intersect(left.select(F.col("target").alias("id")))
        single = ids.join(inner, "id", "left_anti").select("id", F.col("id").alias("component"))
        colours = durable(inner.select("id", F.col("id").alias("colour")))
        core = durable(left.join(inner.withColumnRenamed("id", "source"), "source", "left_semi").join(inner.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target"))
        while True:
            coming = core.join(colours.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("colour").alias("came"))
            new = durable(colours.join(coming, "id", "left").select("id", F.least("colour", F.coalesce("came", "colour")).alias("colour"), (F.col("came") < F.col("colour")).alias("moved")))
            changed = not new.where("moved").isEmpty()
            colours = new.select("id", "colour")
            if not changed:
                break
        same = core.join(colours.withColumnsRenamed({"id": "source", "colour": "a"}), "source").join(colours.withColumnsRenamed({"id": "target", "colour": "b"}), "target").where("a = b")
        back = reach(turned(same.select("source", "target")), colours.where("id = colour").select("id"))
        strong = back.select("id").join(colours, "id").select("id", F.col("colour").alias("component"))
        found = durable(single.unionByName(strong))
        done = found if done is None else durable(done.unionByName(found))
        left = durable(left.join(found.select(F.col("id").alias("source")), "source", "left_anti").join(found.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target"))
        if left.isEmpty():
            rest = ids.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
            return done.unionByName(rest)
        # Nodes whose every edge led to a component that is gone are components of their own.
        alone = ids.join(found.select("id"), "id", "left_anti").join(left.select(F.col("source").alias("id")).union(left.select("target")), "id", "left_anti")
        done = durable(done.unionByName(alone.select("id", F.col("id").alias("component"))))
    return done if done is not None else pairs.select(F.col("source").alias("id"), F.col("source").alias("component"))


def terminality(pairs: DataFrame) -> DataFrame:
    """id and distance (in components) to the nearest component without way out; 0 is terminal."""
    strong = durable(strong_components(pairs))
    named = pairs.join(strong.withColumnsRenamed({"id": "source", "component": "a"}), "source").join(strong.withColumnsRenamed({"id": "target", "component": "b"}), "target")
    steps = durable(named.where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct())
    sinks = strong.select(F.col("component").alias("id")).distinct().join(steps.select(F.col("source").alias("id")), "id", "left_anti")
    far = reach(turned(steps), sinks).select(F.col("id").alias("component"), F.col("depth").alias("distance"))
    return strong.join(far, "component").select("id", "component", "distance")


def settled(starts: list[int], targets: array, weights: array) -> list[int]:
    """The community (a node's number) of each node: nodes move in the order of their numbers, until none would gain by moving.

    ``targets`` and ``weights`` from ``starts[u]`` to ``starts[u + 1]`` are the links of node u, in both directions;
    none leads to u itself. Gains are whole numbers (times all weights). Ties go to the least number, so each
    move makes the sum of gains greater or a number less, and moves end.
    """
    n = len(starts) - 1
    degree = [sum(weights[starts[u] : starts[u + 1]]) for u in range(n)]
    label, sigma, whole = list(range(n)), degree.copy(), sum(degree)
    moved = True
    while moved:
        moved = False
        for u in range(n):
            mine, k, inside = label[u], degree[u], {}
            for v, w in zip(targets[starts[u] : starts[u + 1]], weights[starts[u] : starts[u + 1]]):
                c = label[v]
                inside[c] = inside.get(c, 0) + w
            sigma[mine] -= k
            best, to = (inside[mine] * whole - sigma[mine] * k if mine in inside else 0), mine
            for c, w in inside.items():
                gain = w * whole - sigma[c] * k
                if gain > best or (gain == best and c < to and best > 0):
                    best, to = gain, c
            label[u] = to
            sigma[to] += k
            moved = moved or to != mine
    return label


def _settled_in_one_task(links: DataFrame) -> DataFrame:
    """(id, community) of links (source, target, w) in both directions, which one task reads as numbers (16 bytes a link)."""
    kind = links.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict = {}
        parts = []
        for batch in batches:
            ends = []
            for column in batch.columns[:2]:
                coded = column.dictionary_encode()
                codes = np.array([number.setdefault(x, len(number)) for x in coded.dictionary.to_pylist()], np.int32)
                ends.append(codes[coded.indices.to_numpy()])
            parts.append((*ends, batch.column(2).to_numpy()))
        if not parts:
            return
        names = sorted(number)
        place = np.empty(len(names), np.int32)
        place[[number[x] for x in names]] = np.arange(len(names), dtype=np.int32)
        source, target, w = (np.concatenate(x) for x in zip(*parts))
        source, target = place[source], place[target]
        order = np.lexsort((target, source))
        starts = np.concatenate(([0], np.cumsum(np.bincount(source, minlength=len(names))))).tolist()
        label = settled(starts, array("i", target[order].tobytes()), array("q", w[order].astype(np.int64).tobytes()))
        for at in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_pydict({"id": names[at : at + 100_000], "community": [names[c] for c in label[at : at + 100_000]]})

    return durable(links.select("source", "target", "w").coalesce(1).mapInArrow(run, f"id {kind}, community {kind}"))


def communities(pairs: DataFrame, most: int = 1000, alone: int = 10_000_000) -> DataFrame:
    """(id, community) by local moving: modularity gain until no node at all would gain by moving.

    Up to ``alone`` links (pairs, each in both directions) one task moves node after node in the order of their
    ids (see ``settled``), as parallel rounds, which move neighbours at once, are needed in great number for what
    sweeps do. Larger graphs move in rounds, one half of the nodes per round.

    In each round half of the nodes (by a hash of id and round) may move to the neighbouring community of
    the greatest positive gain, ties to the least name. Degrees and community sums are aggregated, so a
    hub's row count equals the communities it touches. Order differs from a sequential sweep, and so may
    the partition; it is the same for the same graph. Rounds end when no node at all would gain by moving;
    every 32 rounds a smaller part may move, so that neighbours don't swap for ever. ``most`` rounds raise.
    """
    links = durable(pairs.union(turned(pairs)).groupBy("source", "target").agg(F.count("*").alias("w")))
    if links.count() <= alone:
        return _settled_in_one_task(links)
    degree = durable(links.groupBy(F.col("source").alias("id")).agg(F.sum("w").alias("k")))
    whole = degree.agg(F.sum("k")).first()[0]
    label = durable(degree.select("id", F.col("id").alias("community")))
    if not whole:
        return label
    for r in range(most):
        sums = label.join(degree, "id").groupBy("community").agg(F.sum("k").alias("sigma"))
        near = links.join(label.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id"), "community").agg(F.sum("w").alias("inside"))
        own = label.join(degree, "id").withColumnRenamed("community", "mine")
        options = near.join(own, "id").join(sums, "community")
        sigma = F.col("sigma") - F.when(F.col("community") == F.col("mine"), F.col("k")).otherwise(0)
        scored = options.withColumn("gain", F.round(F.col("inside") - sigma * F.col("k") / F.lit(float(whole)), 9))
        stay = F.max(F.when(F.col("community") == F.col("mine"), F.col("gain")))
        best = scored.groupBy("id").agg(F.max(F.struct("gain", "community")).alias("b"), F.coalesce(stay, F.lit(0.0)).alias("stay"))
        gains = durable(best.where(F.col("b.gain") > F.col("stay") + 1e-9).select("id", F.col("b.community").alias("moved")))
        if gains.isEmpty():
            return label
        moves = gains.where(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2 + r // 32)) == 0)
        label = durable(label.join(moves, "id", "left").select("id", F.coalesce("moved", "community").alias("community")), replaces=label)
    raise RuntimeError(f"communities still move after {most} rounds")


def ancestors(parents: DataFrame) -> DataFrame:
    """(id, ancestor, distance) over (id, parent); distances double per round until no pair is new, which ends cycles as well."""
    ways = durable(parents.where("parent is not null and parent <> id").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    span = 1
    while True:
        longer = ways.join(ways.where(F.col("distance") <= span).select(F.col("id").alias("ancestor"), F.col("ancestor").alias("above"), F.col("distance").alias("more")), "ancestor").select("id", F.col("above").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance")).where("id <> ancestor")
        new = durable(ways.unionByName(longer).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))
        if new.count() == ways.count():
            return ways
        ways, span = new, span * 2


def colour_batches(conflicts: list[tuple[str, str]], tasks: list[str]) -> dict[str, int]:
    """Greedy colouring in task order: tasks of one batch don't conflict. For the few tasks of a work plan, on the driver."""
    near: dict[str, set[str]] = {t: set() for t in tasks}
    for a, b in conflicts:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    batch: dict[str, int] = {}
    for task in tasks:
        taken = {batch[x] for x in near[task] if x in batch}
        batch[task] = next(i for i in range(len(tasks)) if i not in taken)
    return batch
