"""Random walk with restart on layered networks, run until it converges.

Two definitions are kept apart:

* :func:`layer_walks`: an independent walk in each layer, row-normalised weights;
* :func:`multiplex_walks`: coupled layers; a share ``delta`` of the walk changes layer,
  evenly to the other layers that hold the node.

A walk is iterated until no vector changes by more than its tolerance (L1; the reference's
1e-8 and 1e-10). A step shrinks every change by 1 - restart, so the number of rounds is
bounded beforehand, and :class:`NotConverged` is raised if that bound is passed.
A number of ``iterations`` given by the caller is run instead, as the registered SQL does:
its scores are rounded to 12 digits in each step, so that the order of sums does not show,
and nodes farther from the seeds than that number have no score.

A network of up to :data:`MAX_LOCAL_MOVES` moves is co-located with batches of seed sets, and
each batch is iterated in one task; a larger one is stored in blocks (:mod:`blocks`), and all
seed sets advance in one loop. The results agree within the tolerance. Walks of a number of
``iterations``, or with other weights between layers, have a long table keyed by (set_id,
layer, node) as their state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.blocks import MAX_LOCAL_MOVES, Network
from strandloom.operators.edges import symmetric
from strandloom.runtime import materialize, release, shuffle_width

REDUCTIONS = ("arithmetic", "geometric", "sum")

#: Changes (L1) at which a walk has converged.
LAYER_TOLERANCE, MULTIPLEX_TOLERANCE = 1e-8, 1e-10


class NotConverged(RuntimeError):
    """A walk still changed by more than its tolerance after the largest number of rounds."""


def most_rounds(restart: float, tolerance: float) -> int:
    """Rounds after which a walk of this restart must have converged; 50 at the least."""
    if not 0 < restart <= 1:
        raise ValueError("a walk converges only with a restart above 0 and up to 1")
    return max(50, 2 + math.ceil(math.log(tolerance / 2) / math.log(1 - restart))) if restart < 1 else 50


def converged(moves: DataFrame, start: DataFrame, restart: float, tolerance: float, max_local_moves: int = MAX_LOCAL_MOVES) -> DataFrame:
    """(set_id, layer, node, score): the fixed point of score = (1 - restart) * moved + restart * p0.

    ``moves`` (layer, src, to, dst, p) has the chances of each step between slots (layer, node),
    ``start`` (set_id, layer, node, p0) the start vectors.
    """
    rounds = most_rounds(restart, tolerance)
    moves, start = materialize(moves, "moves"), materialize(start, "start")
    if moves.count() <= max_local_moves:
        return materialize(_converged_local(moves, start, restart, tolerance, rounds), "walk")
    now = start.select("set_id", "layer", "node", F.col("p0").alias("score"))
    held = None
    for _ in range(rounds):
        moved = now.join(moves.withColumnRenamed("src", "node"), ["layer", "node"]).select(
            "set_id", F.col("to").alias("layer"), F.col("dst").alias("node"), (F.col("score") * F.col("p") * (1 - restart)).alias("score"), F.lit(0.0).alias("was")
        )
        back = start.select("set_id", "layer", "node", (F.col("p0") * restart).alias("score"), F.lit(0.0).alias("was"))
        before = now.select("set_id", "layer", "node", F.lit(0.0).alias("score"), F.col("score").alias("was"))
        after = materialize(
            moved.unionByName(back).unionByName(before).groupBy("set_id", "layer", "node").agg(F.sum("score").alias("score"), F.sum("was").alias("was")), "walk"
        )
        release(held)
        now = held = after
        off = after.groupBy("set_id").agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("d")).agg(F.max("d")).first()[0]
        if off is None or off < tolerance:
            return after.select("set_id", "layer", "node", "score")
    raise NotConverged(f"a walk still changed by {off:g} after {rounds} rounds")


def _co_located(moves: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slots, start rows, links): numbered slots and nodes, and the network once for each batch of sets."""
    slots = moves.select("layer", F.col("src").alias("node")).union(moves.select("to", "dst")).union(start.select("layer", "node")).distinct()
    slots = materialize(
        slots.withColumn("slot", F.row_number().over(Window.orderBy("node", "layer")) - 1).withColumn("who", F.dense_rank().over(Window.orderBy("node")) - 1), "slots"
    )
    batch = F.pmod(F.xxhash64("set_id"), F.lit(shuffle_width(moves.sparkSession))).cast("int").alias("batch")
    at = materialize(start.join(slots, ["layer", "node"]).select("set_id", batch, "slot", "p0"), "starts")
    used = at.select(F.col("batch").alias("for")).distinct()
    links = (
        moves.join(slots.select("layer", F.col("node").alias("src"), F.col("slot").alias("a")), ["layer", "src"])
        .join(slots.select(F.col("layer").alias("to"), F.col("node").alias("dst"), F.col("slot").alias("b"), "who"), ["to", "dst"])
        .select("a", "b", "who", "p")
        .crossJoin(F.broadcast(used))
    )
    return slots, at, links


def _converged_local(moves: DataFrame, start: DataFrame, restart: float, tolerance: float, rounds: int) -> DataFrame:
    """The same walks with the network brought to each batch of seed sets."""
    slots, at, links = _co_located(moves, start)
    kind = start.schema["set_id"].dataType.simpleString()
    found = at.groupBy("batch").cogroup(links.groupBy("for")).applyInPandas(_iterate(restart, tolerance, rounds), f"set_id {kind}, slot int, score double")
    return found.join(slots, "slot").select("set_id", "layer", "node", "score")


def _vectors(start: pd.DataFrame, links: pd.DataFrame, restart: float, tolerance: float, rounds: int) -> Iterator[tuple]:
    """(name, start rows, scores by slot) of every set of a batch."""
    size = 1 + int(max(start["slot"].max(), *(links[c].max() if len(links) else -1 for c in ("a", "b"))))
    a, b = links["a"].to_numpy(), links["b"].to_numpy()
    p = links["p"].to_numpy() * (1 - restart)
    for name, own in start.groupby("set_id", sort=False):
        p0 = np.bincount(own["slot"], own["p0"], size)
        now = p0
        for _ in range(rounds):
            after = np.bincount(b, now[a] * p, size) + restart * p0
            off = np.abs(after - now).sum()
            now = after
            if off < tolerance:
                break
        else:
            raise NotConverged(f"the walk of {name} still changed by {off:g} after {rounds} rounds")
        yield name, own, now


def _iterate(restart: float, tolerance: float, rounds: int) -> Callable:
    def run(start: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, _, scores in _vectors(start, links, restart, tolerance, rounds):
            held = np.flatnonzero(scores)
            out.append(pd.DataFrame({"set_id": name, "slot": held.astype(np.int32), "score": scores[held]}))
        return pd.concat(out, ignore_index=True)

    return run


def _rank_target(restart: float, tolerance: float, rounds: int, layers: int) -> Callable:
    """The mean rank of each set's target node among all nodes but the set's own."""

    def run(start: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        out = []
        who = np.zeros(1 + int(links["b"].max()), np.int64)
        who[links["b"].to_numpy()] = links["who"].to_numpy()
        for name, own, scores in _vectors(start, links, restart, tolerance, rounds):
            score = np.round(np.bincount(who, scores[: len(who)]) / layers, 12)
            target = int(own["target"].iloc[0])
            value = score[target] if target >= 0 else 0.0
            score[who[own["slot"].to_numpy()]] = -1.0  # the set's own nodes have no rank
            tied = (score == value).sum() + (target < 0)
            out.append((name, 1 + (score > value).sum() + (tied - 1) / 2))
        return pd.DataFrame(out, columns=["set_id", "rank"])

    return run


def collected(seeds: DataFrame) -> DataFrame:
    """The seeds (set_id, node) as rows of the driver, for several walks."""
    seeds = seeds.select("set_id", "node").distinct()
    return seeds.sparkSession.createDataFrame(seeds.collect(), seeds.schema)  # one row per seed


def stored_blocks(edges: DataFrame, max_local_moves: int) -> Network | None:
    """The network in blocks if it is too large for one task."""
    return Network(edges, merge=True) if 2 * edges.count() > max_local_moves else None


def transitions(edges: DataFrame, scale: float = 1.0) -> DataFrame:
    """(layer, src, dst, p): the chance of each step from src, times ``scale``."""
    both = symmetric(edges)
    out = both.groupBy("layer", "src").agg(F.sum("weight").alias("total"))
    return both.groupBy("layer", "src", "dst").agg(F.sum("weight").alias("w")).join(out, ["layer", "src"]).select(
        "layer", "src", "dst", (F.col("w") / F.col("total") * scale).alias("p")
    )


def seed_rows(edges: DataFrame, seeds: DataFrame, taus: dict[str, float] | None = None) -> DataFrame:
    """(set_id, layer, node, p0): start vectors; each set's mass is spread over its seeds and
    over layers by ``taus`` (even by default). Seeds without an edge in a layer have none there."""
    layers = [r[0] for r in edges.select("layer").distinct().orderBy("layer").collect()]  # one row per layer
    taus = taus or {x: 1 / len(layers) for x in layers}
    if abs(sum(taus.values()) - 1) > 1e-9 or set(taus) != set(layers):
        raise ValueError("layer weights must cover every layer and sum to one")
    size = seeds.distinct().groupBy("set_id").agg(F.count("*").alias("size"))
    spread = edges.sparkSession.createDataFrame(sorted(taus.items()), "layer string, tau double")
    at = symmetric(edges).select("layer", F.col("src").alias("node")).distinct()
    return (
        seeds.select("set_id", "node").distinct().join(size, "set_id").join(at, "node").join(F.broadcast(spread), "layer")
        .select("set_id", "layer", "node", (F.col("tau") / F.col("size")).alias("p0"))
    )


def layer_walks(
    edges: DataFrame,
    seeds: DataFrame,
    restart: float = 0.35,
    iterations: int | None = None,
    tolerance: float = LAYER_TOLERANCE,
    max_local_moves: int = MAX_LOCAL_MOVES,
) -> DataFrame:
    """(set_id, layer, node, score): a walk in each layer that has an active seed."""
    net = stored_blocks(edges, max_local_moves) if iterations is None else None
    if net is not None:
        found = net.walk(seeds, restart, tolerance, most_rounds(restart, tolerance))
        net.release()
        return found
    step = materialize(transitions(edges), "steps")
    at = symmetric(edges).select("layer", F.col("src").alias("node")).distinct()
    active = seeds.select("set_id", "node").distinct().join(at, "node")
    many = active.groupBy("set_id", "layer").agg(F.count("*").alias("n"))
    start = materialize(active.join(many, ["set_id", "layer"]).select("set_id", "layer", "node", (1 / F.col("n")).alias("score")), "walk")
    if iterations is None:
        moves = step.select("layer", "src", F.col("layer").alias("to"), "dst", "p")
        return converged(moves, start.withColumnRenamed("score", "p0"), restart, tolerance, max_local_moves)
    now = start
    for _ in range(iterations):
        moved = now.join(step.withColumnRenamed("src", "node"), ["layer", "node"]).select(
            "set_id", "layer", F.col("dst").alias("node"), (F.col("score") * F.col("p") * (1 - restart)).alias("score")
        )
        back = start.select("set_id", "layer", "node", (F.col("score") * restart).alias("score"))
        after = materialize(moved.unionByName(back).groupBy("set_id", "layer", "node").agg(F.round(F.sum("score"), 12).alias("score")), "walk")
        if now is not start:
            release(now)
        now = after
    return now


def mean_over_layers(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, node, score): mean of a node's scores over the active layers that hold it."""
    active = scores.select("set_id", "layer").distinct()
    held = symmetric(edges).select("layer", F.col("src").alias("node")).distinct()
    slots = active.join(held, "layer").groupBy("set_id", "node").agg(F.count("*").alias("n"))
    total = scores.groupBy("set_id", "node").agg(F.sum("score").alias("s"))
    return slots.join(total, ["set_id", "node"]).select("set_id", "node", (F.col("s") / F.col("n")).alias("score"))


def layer_means(
    edges: DataFrame, seeds: DataFrame, restart: float = 0.35, tolerance: float = LAYER_TOLERANCE, max_local_moves: int = MAX_LOCAL_MOVES
) -> DataFrame:
    """:func:`mean_over_layers` of converged :func:`layer_walks`; of a network in blocks each task
    takes the means of its own walks."""
    net = stored_blocks(edges, max_local_moves)
    if net is None:
        return mean_over_layers(layer_walks(edges, seeds, restart, tolerance=tolerance, max_local_moves=max_local_moves), edges)
    rounds = most_rounds(restart, tolerance)
    if net.whole:
        found = net.walk(seeds, restart, tolerance, rounds, reduce="mean")
    else:
        found = mean_over_layers(net.walk(seeds, restart, tolerance, rounds), edges)
    net.release()
    return found


def multiplex_walks(
    edges: DataFrame,
    seeds: DataFrame,
    restart: float = 0.7,
    delta: float = 0.5,
    iterations: int | None = None,
    taus: dict[str, float] | None = None,
    inter: DataFrame | None = None,
    scale: float | None = None,
    tolerance: float = MULTIPLEX_TOLERANCE,
    max_local_moves: int = MAX_LOCAL_MOVES,
    then: Callable | None = None,
) -> DataFrame:
    """(set_id, layer, node, score) of coupled walks, or what ``then`` makes of their moves and starts.

    One step: (1 - restart) * (within layers + from the other layers) + restart * start.
    A node in L layers sends delta / (L - 1) of its score to each other one; with a single
    layer delta is 0. ``inter`` (layer, node, d) replaces these weights.
    """
    net = stored_blocks(edges, max_local_moves) if iterations is None and inter is None and scale is None and then is None else None
    if net is not None:
        found = net.walk(seeds, restart, tolerance, most_rounds(restart, tolerance), delta, taus)
        net.release()
        return found
    layers = edges.select("layer").distinct().count()
    delta = 0.0 if layers < 2 else delta
    step = materialize(transitions(edges, 1 - delta if scale is None else scale), "steps")
    at = symmetric(edges).select("layer", F.col("src").alias("node")).distinct()
    if inter is None:
        held = at.groupBy("node").agg(F.count("*").alias("n"))
        inter = at.join(held, "node").select("layer", "node", F.when(F.col("n") > 1, delta / (F.col("n") - 1)).otherwise(0.0).alias("d"))
    inter = materialize(inter, "inter")
    start = materialize(seed_rows(edges, seeds, taus), "walk")
    if iterations is None:
        inside = step.select("layer", "src", F.col("layer").alias("to"), "dst", "p")
        others = inter.where("d > 0").join(at.select("node", F.col("layer").alias("to")), "node").where(F.col("layer") != F.col("to"))
        moves = inside.unionByName(others.select("layer", F.col("node").alias("src"), "to", F.col("node").alias("dst"), F.col("d").alias("p")))
        return (then or converged)(moves, start, restart, tolerance, max_local_moves)
    now = start.withColumnRenamed("p0", "score")
    held = None
    for _ in range(iterations):
        within = now.join(step.withColumnRenamed("src", "node"), ["layer", "node"]).select(
            "set_id", "layer", F.col("dst").alias("node"), (F.col("score") * F.col("p") * (1 - restart)).alias("score")
        )
        sent = now.join(inter, ["layer", "node"]).select("set_id", "node", F.col("layer").alias("from"), (F.col("score") * F.col("d") * (1 - restart)).alias("score"))
        across = sent.join(at, "node").where(F.col("layer") != F.col("from")).select("set_id", "layer", "node", "score")
        back = start.select("set_id", "layer", "node", (F.col("p0") * restart).alias("score"))
        after = materialize(
            within.unionByName(across).unionByName(back).groupBy("set_id", "layer", "node").agg(F.round(F.sum("score"), 12).alias("score")), "walk"
        )
        release(held)
        now = held = after
    return now


def reduced(scores: DataFrame, edges: DataFrame, how: str = "geometric") -> DataFrame:
    """(set_id, node, score): layers reduced over all L layers; a node missing in a layer counts as 0 there."""
    n = edges.select("layer").distinct().count()
    grouped = scores.groupBy("set_id", "node")
    if how == "geometric":
        value = F.when((F.count("*") < n) | (F.min("score") <= 0), 0.0).otherwise(F.exp(F.sum(F.log(F.greatest("score", F.lit(1e-300)))) / n))
    elif how in ("arithmetic", "sum"):
        value = F.sum("score") / (n if how == "arithmetic" else 1)
    else:
        raise ValueError(f"unknown reduction: {how}")
    return grouped.agg(F.round(value, 12).alias("score"))


def _reduced_in_blocks(net: Network, edges: DataFrame, how: str, *walk: object, **options: object) -> DataFrame:
    """:func:`reduced` of a network's walk, in the tasks that walk where they can."""
    if net.whole:
        return net.walk(*walk, **options, reduce=how).select("set_id", "node", F.round("score", 12).alias("score"))
    return reduced(net.walk(*walk, **options), edges, how)


def reduced_walks(
    edges: DataFrame,
    seeds: DataFrame,
    restart: float = 0.7,
    delta: float = 0.5,
    how: str = "geometric",
    tolerance: float = MULTIPLEX_TOLERANCE,
    max_local_moves: int = MAX_LOCAL_MOVES,
    best: int | None = None,
) -> DataFrame:
    """:func:`reduced` of converged :func:`multiplex_walks`. For :func:`best` of so many rows, those of a network in
    blocks are the ones it can take."""
    net = stored_blocks(edges, max_local_moves)
    if net is None:
        return reduced(multiplex_walks(edges, seeds, restart, delta, tolerance=tolerance, max_local_moves=max_local_moves), edges, how)
    found = _reduced_in_blocks(net, edges, how, seeds, restart, tolerance, most_rounds(restart, tolerance), delta, best=best)
    net.release()
    return found


def ranked(scores: DataFrame, seeds: DataFrame | None = None, drop_seeds: bool = False, ties: str = "average") -> DataFrame:
    """(set_id, node, score, rank, is_seed): rank 1 is the highest score of a set.

    ``ties``: "average" gives tied nodes their mean rank, "min" the smallest.
    """
    if seeds is not None:
        scores = scores.join(seeds.select("set_id", "node").distinct().withColumn("is_seed", F.lit(True)), ["set_id", "node"], "left")
        scores = scores.withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
        if drop_seeds:
            scores = scores.where("not is_seed")
    tied = scores.groupBy("set_id", "score").agg(F.count("*").alias("_n"))  # the distinct scores are ranked, not the rows
    until = F.sum("_n").over(Window.partitionBy("set_id").orderBy(F.desc("score")))
    first = until - F.col("_n") + 1
    rank = first + (F.col("_n") - 1) / 2 if ties == "average" else first.cast("double")
    places = tied.select(F.col("set_id").alias("_set"), F.col("score").alias("_score"), rank.alias("rank"))
    found = scores.join(places, F.col("set_id").eqNullSafe(F.col("_set")) & F.col("score").eqNullSafe(F.col("_score")))
    return found.drop("_set", "_score")


def top(ranks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best nodes of each set, ties broken by node."""
    place = F.row_number().over(Window.partitionBy("set_id").orderBy("rank", "node"))
    return ranks.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def best(scores: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(set_id, node, score, rank): :func:`top` of :func:`ranked` with ties "min" and without the seeds. All rows that
    come before one of the ``k`` are among them, so no other row is ranked."""
    rest = scores.join(F.broadcast(seeds.select("set_id", "node").distinct()), ["set_id", "node"], "left_anti")
    sets = Window.partitionBy("set_id")
    kept = rest.withColumn("_p", F.row_number().over(sets.orderBy(F.desc("score"), "node"))).where(F.col("_p") <= k).drop("_p")
    return kept.withColumn("rank", F.rank().over(sets.orderBy(F.desc("score"))).cast("double"))


def leave_one_out(seeds: DataFrame) -> DataFrame:
    """(set_id, left_out, node): for each set and each of its seeds the set without it.

    ``set_id`` of the result names both."""
    a = seeds.select("set_id", F.col("node").alias("left_out")).distinct()
    b = seeds.select("set_id", "node").distinct()
    return a.join(b, "set_id").where(F.col("node") != F.col("left_out")).select(
        F.concat_ws("-", F.col("set_id").cast("string"), "left_out").alias("set_id"), "left_out", "node"
    )


def left_out_ranks(edges: DataFrame, sets: DataFrame, restart: float, delta: float, max_local_moves: int = MAX_LOCAL_MOVES) -> DataFrame:
    """(set_id, left_out, rank): where each left-out node stands in the converged walk from
    the set's other nodes, among all nodes but these; tied nodes share their mean rank.

    ``sets`` is the result of :func:`leave_one_out`. A node that the walk does not reach has
    score 0 and the rank tied with all such nodes."""
    layers = edges.select("layer").distinct().count()
    nodes = materialize(symmetric(edges).select(F.col("src").alias("node")).distinct(), "nodes")
    n = nodes.count()
    targets = sets.select("set_id", "left_out").distinct()

    def ranks(moves: DataFrame, start: DataFrame, restart: float, tolerance: float, most: int) -> DataFrame:
        moves, start = materialize(moves, "moves"), materialize(start, "start")
        if moves.count() <= most:
            slots, at, links = _co_located(moves, start)
            known = targets.join(slots.select(F.col("node").alias("left_out"), F.col("who").alias("target")).distinct(), "left_out", "left")
            at = at.join(known.select("set_id", F.coalesce("target", F.lit(-1)).alias("target")), "set_id")
            work = _rank_target(restart, tolerance, most_rounds(restart, tolerance), layers)
            return at.groupBy("batch").cogroup(links.groupBy("for")).applyInPandas(work, "set_id string, rank double")
        scores = reduced(converged(moves, start, restart, tolerance, most), edges, "arithmetic").where("score > 0")
        placed = materialize(ranked(scores, sets.select("set_id", "node"), drop_seeds=True), "placed")
        own = sets.join(nodes, "node").groupBy("set_id").agg(F.count("*").alias("own"))
        reached = placed.groupBy("set_id").agg(F.count("*").alias("reached"))
        absent = F.col("held").isNull().cast("int")  # a target without an edge is one more unreached node
        last = F.coalesce("reached", F.lit(0)) + (n + absent - F.coalesce("own", F.lit(0)) - F.coalesce("reached", F.lit(0)) + 1) / 2
        return (
            targets.join(placed.select("set_id", F.col("node").alias("left_out"), "rank"), ["set_id", "left_out"], "left")
            .join(own, "set_id", "left").join(reached, "set_id", "left")
            .join(nodes.select(F.col("node").alias("left_out"), F.lit(True).alias("held")), "left_out", "left")
            .select("set_id", F.coalesce("rank", last).alias("rank"))
        )

    net = stored_blocks(edges, max_local_moves)
    if net is not None and net.whole:
        found = net.ranks(sets, restart, MULTIPLEX_TOLERANCE, most_rounds(restart, MULTIPLEX_TOLERANCE), delta)
    else:
        found = materialize(multiplex_walks(edges, sets.select("set_id", "node"), restart, delta, max_local_moves=max_local_moves, then=ranks), "ranks")
    if net is not None:
        net.release()
    # sets of which no node has an edge: all nodes tie at 0
    return (
        targets.join(found, "set_id", "left")
        .join(nodes.select(F.col("node").alias("left_out"), F.lit(True).alias("held")), "left_out", "left")
        .select("set_id", "left_out", F.coalesce("rank", (n + F.col("held").isNull().cast("int") + 1) / 2).alias("rank"))
    )


def random_sets(pool: DataFrame, seeds: DataFrame, samples: int = 100) -> DataFrame:
    """(set_id, node): for every seed set ``samples`` sets ``<set>~<k>`` of its own size from
    ``pool`` (node), drawn by hash order."""
    size = seeds.distinct().groupBy("set_id").agg(F.count("*").alias("size"))
    asked = size.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    named = asked.select(F.concat_ws("~", F.col("set_id").cast("string"), F.col("k").cast("string")).alias("set_id"), "size")
    order = Window.partitionBy("set_id").orderBy(F.xxhash64("set_id", "node"), "node")
    drawn = pool.select("node").distinct().crossJoin(F.broadcast(named)).withColumn("place", F.row_number().over(order))
    return drawn.where(F.col("place") <= F.col("size")).select("set_id", "node")


def essentiality(edges: DataFrame, seeds: DataFrame, null_sets: DataFrame, restart: float = 0.7, delta: float = 0.5, max_local_moves: int = MAX_LOCAL_MOVES) -> DataFrame:
    """(set_id, position, left_out, rank, null_median, delta): how early each seed is found
    from the others, against the median of random sets at the same place.

    ``seeds`` and ``null_sets`` have (set_id, node); null sets are named ``<set>~<k>``.
    """
    everything = leave_one_out(seeds.unionByName(null_sets))
    everything = materialize(everything.withColumn("group", F.regexp_replace("set_id", r"-[^-]*$", "")), "loo")
    found = left_out_ranks(edges, everything, restart, delta, max_local_moves).join(everything.select("set_id", "group").distinct(), "set_id")
    place = F.row_number().over(Window.partitionBy("group").orderBy("rank", "left_out"))
    placed = found.select(F.split("group", "~").getItem(0).alias("base"), "group", F.col("left_out").alias("node"), "rank", place.alias("position"))
    null = placed.where(F.col("group") != F.col("base")).groupBy("base", "position").agg(F.median("rank").alias("null_median"))
    return placed.where(F.col("group") == F.col("base")).join(null, ["base", "position"], "left").select(
        F.col("base").alias("set_id"), "position", F.col("node").alias("left_out"), "rank", "null_median", (F.col("null_median") - F.col("rank")).alias("delta")
    )


def ablation(
    edges: DataFrame,
    seeds: DataFrame,
    restart: float = 0.7,
    delta: float = 0.5,
    iterations: int | None = None,
    tolerance: float = MULTIPLEX_TOLERANCE,
    max_local_moves: int = MAX_LOCAL_MOVES,
) -> DataFrame:
    """(layer, set_id, node, score, base): vectors after dropping each layer, beside the full ones."""
    net = stored_blocks(edges, max_local_moves) if iterations is None else None
    if net is not None:
        seeds = collected(seeds)
    rounds = most_rounds(restart, tolerance)

    def scores(rest: DataFrame, without: str | None = None) -> DataFrame:
        if net is None:
            return reduced(multiplex_walks(rest, seeds, restart, delta, iterations, tolerance=tolerance, max_local_moves=max_local_moves), rest, "arithmetic")
        return _reduced_in_blocks(net, rest, "arithmetic", seeds, restart, tolerance, rounds, delta, without_layer=without)

    full = scores(edges).withColumnRenamed("score", "base")
    full = materialize(full, "base") if net is None else full
    out = None
    layers = [r[0] for r in edges.select("layer").distinct().orderBy("layer").collect()] if net is None or net.n_layers > len(net.layers) else net.layers
    for layer in layers:  # one round per layer
        rest = edges.where(F.col("layer") != layer)
        part = scores(rest, layer).select(F.lit(layer).alias("layer"), "set_id", "node", "score")
        out = part if out is None else out.unionByName(part)
    if net is not None:
        net.release()
    names = out.select("layer").distinct()
    return F.broadcast(names).crossJoin(full).join(out, ["layer", "set_id", "node"], "left").select(
        "layer", "set_id", "node", F.coalesce("score", F.lit(0.0)).alias("score"), "base"
    )


def perturbation(
    edges: DataFrame,
    seeds: DataFrame,
    node: str,
    restart: float = 0.7,
    delta: float = 0.5,
    iterations: int | None = None,
    tolerance: float = MULTIPLEX_TOLERANCE,
    max_local_moves: int = MAX_LOCAL_MOVES,
) -> DataFrame:
    """(set_id, node, score, base): vectors after taking a node's edges away. The weights
    between layers stay those of the full network."""
    net = stored_blocks(edges, max_local_moves) if iterations is None else None
    if net is not None:
        seeds, rounds = collected(seeds), most_rounds(restart, tolerance)
        full, changed = (_reduced_in_blocks(net, edges, "arithmetic", seeds, restart, tolerance, rounds, delta, without_node=x) for x in (None, node))
        net.release()
    else:
        at = symmetric(edges).select("layer", F.col("src").alias("node")).distinct()
        held = at.groupBy("node").agg(F.count("*").alias("n"))
        inter = at.join(held, "node").select("layer", "node", F.when(F.col("n") > 1, delta / (F.col("n") - 1)).otherwise(0.0).alias("d"))
        cut = edges.where((F.col("src") != node) & (F.col("dst") != node))
        whole = multiplex_walks(edges, seeds, restart, delta, iterations, tolerance=tolerance, max_local_moves=max_local_moves)
        less = multiplex_walks(cut, seeds, restart, delta, iterations, inter=inter, tolerance=tolerance, max_local_moves=max_local_moves)
        full, changed = reduced(whole, edges, "arithmetic"), reduced(less, edges, "arithmetic")
    return full.withColumnRenamed("score", "base").join(changed, ["set_id", "node"], "full").select(
        "set_id", "node", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("base", F.lit(0.0)).alias("base")
    )
