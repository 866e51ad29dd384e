"""Bounded frontier loops: closures, quality-ordered routes, reverse test routing.

Each hop is one equi-join and one aggregate. Frontiers hold at most one row a node (and hop), and
lineage is cut every few hops in the shared checkpoint folder. No visited set is broadcast.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.plans.evidence import CURRENT, UNKNOWN

CUT_EVERY = 4
QUALITY = ("stale", "unknown", "unresolved", "ambiguous", "candidate", "distance")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; on a local master without one, a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="factweave-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
    context.setCheckpointDir(given)


def closure(seed: DataFrame, arcs: DataFrame, most: int = 1000) -> DataFrame:
    """Nodes reachable over arcs (a, b), seeds included; stops when a hop adds none, raises at the limit."""
    ensure_checkpoints(seed.sparkSession)
    front = seed.select("node").distinct().checkpoint()
    parts = [front]
    for _ in range(most):
        found = reduce(DataFrame.unionByName, parts)
        step = front.join(arcs, front.node == arcs.a).select(F.col("b").alias("node")).distinct()
        front = step.join(found, "node", "left_anti").checkpoint()
        if front.isEmpty():
            return found
        parts.append(front)  # fronts are written once; every few are put together, at doubling sizes
        while len(parts) > 2 * CUT_EVERY:
            parts = [reduce(DataFrame.unionByName, parts[:CUT_EVERY]).checkpoint(), *parts[CUT_EVERY:]]
    raise ValueError(f"the closure takes more than {most} hops")


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as arcs from ``a`` to ``b``: downstream follows them, upstream goes back, both does both."""
    down = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), *_costs(edges))
    up = edges.select(F.col("target").alias("a"), F.col("source").alias("b"), *_costs(edges))
    return {"downstream": down, "upstream": up}.get(direction) or down.unionByName(up)


def _costs(edges: DataFrame) -> list[Column]:
    state, resolution = F.col("state"), F.col("resolution") if "resolution" in edges.columns else F.lit("unique")
    stale, unknown = (state == "stale").cast("int"), (state == UNKNOWN).cast("int")
    kinds = [(resolution == k).cast("int").alias(f"{k}_") for k in ("unresolved", "ambiguous", "candidate")]
    return [stale.alias("stale_"), unknown.alias("unknown_"), *kinds]


def routes(seed: DataFrame, edges: DataFrame, depth: int, direction: str = "downstream") -> DataFrame:
    """(node, stale, unknown, unresolved, ambiguous, candidate, distance): the best route to each.

    The best route of exactly h hops is kept for every h, as a worse route with fewer hops may be
    the only one that reaches further in the depth; the best over all hops is the result.
    """
    ensure_checkpoints(seed.sparkSession)
    all_arcs = oriented(edges, direction)
    arcs = all_arcs.groupBy("a", "b").agg(F.min(F.struct(*[f"{q}_" for q in QUALITY[:-1]])).alias("cost"))  # parallel edges: the best
    if depth > CUT_EVERY:
        arcs = arcs.checkpoint()
    zero = F.struct(*[F.lit(0).alias(q) for q in QUALITY])
    front = seed.select("node").distinct().select("node", zero.alias("route"))
    best = front
    for hop in range(1, depth + 1):
        total = F.struct(*[(F.col(f"route.{q}") + F.col(f"cost.{q}_")).alias(q) for q in QUALITY[:-1]], F.lit(hop).alias("distance"))
        front = front.join(arcs, front.node == arcs.a).select(F.col("b").alias("node"), total.alias("route")).groupBy("node").agg(F.min("route").alias("route"))
        best = best.unionByName(front)
        if hop % CUT_EVERY == 0 and hop < depth:
            front, best = front.checkpoint(), best.groupBy("node").agg(F.min("route").alias("route")).checkpoint()
            if front.isEmpty():  # no route goes further
                break
    final = best.groupBy("node").agg(F.min("route").alias("route"))
    return final.select("node", *[F.col(f"route.{q}").alias(q) for q in QUALITY])


def reverse_tests(changed: DataFrame, edges: DataFrame, tests: DataFrame, depth: int = 8) -> DataFrame:
    """Per test the best route to a changed node: configured before static, then nearest, then path."""
    reached = routes(changed, edges, depth, "upstream").select(F.col("node").alias("target"), "distance")
    rows = tests.join(reached, "target").withColumn("grade", F.when(F.col("configured"), 1).otherwise(2))
    best = rows.groupBy("grp", "path", "selector").agg(F.min(F.struct("grade", "distance", "target")).alias("x"))
    return best.select("grp", "path", "selector", F.when(F.col("x.grade") == 1, "configured").otherwise("static").alias("provenance"), F.col("x.distance").alias("distance"), F.col("x.target").alias("target"))


def expand_containers(chosen: DataFrame, symbols: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Chosen symbols and the members (X.*, same path) of those of a container kind."""
    inside = symbols.withColumn("owner", F.regexp_replace("name", r"\.[^.]*$", "")).where("owner <> name")
    holders = chosen.where(F.col("kind").isin(*kinds)).select("path", F.col("name").alias("owner"))
    members = inside.join(holders, ["path", "owner"], "left_semi").select("path", "name", "kind")
    return chosen.select("path", "name", "kind").unionByName(members).distinct()


def shortest_paths(sources: DataFrame, targets: DataFrame, edges: DataFrame, depth: int = 8, most: int = 8, direction: str = "downstream") -> DataFrame:
    """(nodes, length, proven): all shortest paths to the nearest targets, at most ``most``.

    Proven edges (current, uniquely resolved) are tried first; only if they reach no target are all
    used. Distances come from node-level hops; paths are built over nodes that lie on one.
    """
    good = F.col("state") == CURRENT
    if "resolution" in edges.columns:
        good = good & F.col("resolution").isin("unique", "builtin")
    for proven in (True, False):
        own = edges.where(good) if proven else edges
        arcs = oriented(own, direction).select("a", "b").distinct()
        found = _search(sources, targets, arcs, depth, most)
        if found is not None:
            return found.withColumn("proven", F.lit(proven))
    spark = sources.sparkSession
    return spark.createDataFrame([], "nodes array<string>, length int, proven boolean")


def _search(sources: DataFrame, targets: DataFrame, arcs: DataFrame, depth: int, most: int) -> DataFrame | None:
    ensure_checkpoints(sources.sparkSession)
    ends = targets.select("node").distinct().withColumn("hit", F.lit(True))

    def settled(df: DataFrame, hop: int) -> tuple[DataFrame, int, int]:
        """A hop's nodes, written once with whether they are targets; how many there are, and targets."""
        out = df.join(ends, "node", "left").select("node", F.lit(hop).alias("d"), F.coalesce("hit", F.lit(False)).alias("hit")).checkpoint()
        n, hits = out.agg(F.count("*"), F.count_if("hit")).first()
        return out, n, hits

    front, n, hits = settled(sources.select("node").distinct(), 0)
    fronts, length = [front], 0
    while n and not hits and length < depth:
        step = front.join(arcs, front.node == arcs.a).select(F.col("b").alias("node")).distinct()
        length += 1
        front, n, hits = settled(step.join(reduce(DataFrame.unionByName, fronts), "node", "left_anti"), length)
        fronts.append(front)
    if not hits:
        return None
    keep = front.where("hit").select("node", "d")
    useful = keep
    for hop in range(length - 1, -1, -1):  # nodes from which a nearest target is reached in time
        back = arcs.join(keep.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct()
        keep = fronts[hop].join(back, "node", "left_semi").select("node", "d")
        useful = useful.unionByName(keep)
    useful = useful.checkpoint()
    paths = useful.where("d = 0").select(F.array("node").alias("nodes"), "node")
    for hop in range(1, length + 1):
        onward = arcs.join(useful.where(F.col("d") == hop).select(F.col("node").alias("b")), "b", "left_semi")
        paths = paths.join(onward, paths.node == onward.a).select(F.concat("nodes", F.array("b")).alias("nodes"), F.col("b").alias("node"))
        paths = paths.orderBy("nodes").limit(most)  # every prefix leads to a target, so the first stay
    return paths.orderBy("nodes").limit(most).select("nodes", F.lit(length).alias("length"))


def path_outcome(found: DataFrame, sources: DataFrame, targets: DataFrame, complete: bool, frontier: bool) -> DataFrame:
    """One row (outcome, reason) by the ladder of found, unknown and absent."""
    counts = found.agg(F.count("*").alias("n"), F.bool_and("proven").alias("proven")).crossJoin(sources.agg(F.count("*").alias("s"))).crossJoin(targets.agg(F.count("*").alias("t")))
    any_path, ends = F.col("n") > 0, (F.col("s") > 0) & (F.col("t") > 0)
    outcome = F.when(any_path & F.col("proven"), "found").when(any_path | ~ends | F.lit(not complete) | F.lit(frontier), "unknown").otherwise("absent")
    reason = F.when(any_path & F.col("proven"), "witnesses").when(any_path, "candidate-witnesses").when(~ends, "endpoint-unresolved")
    reason = reason.when(F.lit(not complete), "graph-incomplete").when(F.lit(frontier), "depth-frontier").otherwise("exhaustive")
    return counts.select(outcome.alias("outcome"), reason.alias("reason"))


class CoreTooLarge(ValueError):
    """A cyclic core has more edges than the driver may read."""


def cycle_core(edges: DataFrame, most: int = 1000) -> DataFrame:
    """Edges left after trimming nodes without incoming or outgoing ones: empty if acyclic."""
    ensure_checkpoints(edges.sparkSession)
    left = edges.select("source", "target").distinct().checkpoint()
    size = left.count()
    for _ in range(most):
        ends = left.select(F.col("target").alias("source")).distinct()
        starts = left.select(F.col("source").alias("target")).distinct()
        left = left.join(ends, "source", "left_semi").join(starts, "target", "left_semi").select("source", "target").checkpoint()
        now = left.count()
        if now in (0, size):
            return left
        size = now
    raise ValueError(f"trimming takes more than {most} rounds")


def cycle_witnesses(core: DataFrame, most_edges: int = 100_000) -> list[list[str]]:
    """One cycle per back edge of a depth-first search in byte order, from its smallest node on.

    The trimmed core is read on the driver only up to ``most_edges``; beyond that it raises
    ``CoreTooLarge``.
    """
    rows = core.select("source", "target").orderBy("source", "target").limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise CoreTooLarge(f"more than {most_edges} edges")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["source"], []).append(r["target"])
    closed: set[str] = set()
    found: dict[tuple[str, ...], None] = {}
    for root in out:
        if root in closed:
            continue
        trail, place, ahead = [root], {root: 0}, [iter(out[root])]
        while trail:
            step = next(ahead[-1], None)
            if step is None:
                ahead.pop()
                closed.add(trail[-1])
                del place[trail.pop()]
            elif step in place:
                loop = trail[place[step] :]
                first = loop.index(min(loop))  # nodes of a loop are different, so this is its least rotation
                found.setdefault((*loop[first:], *loop[:first]))
            elif step not in closed and step in out:
                place[step] = len(trail)
                trail.append(step)
                ahead.append(iter(out[step]))
    return [list(c) for c in found]


def file_order(routes_: DataFrame, retrieval: DataFrame, degrees: DataFrame, most: int) -> DataFrame:
    """(node, place): the first ``most`` files by route quality, retrieval score and rank, degree and path.

    routes_: as ``routes``; retrieval: node, score, rank; degrees: node, degree. Only what is shown is ranked.
    """
    joined = routes_.join(retrieval, "node", "left").join(degrees, "node", "left").withColumns({"score": F.coalesce("score", F.lit(0)), "degree": F.coalesce("degree", F.lit(0))})
    order = [*QUALITY, F.desc("score"), F.when(F.col("score") != 0, F.col("rank")).otherwise(0), F.desc("degree"), "node"]
    return _ranked(joined, order, most).select("node", "place")


#: Fixed values, best first: how a test's route is known.
PROVENANCE = ("observed", "asserted")
CONFIDENCE = ("exact", "candidate", "conservative")
SCOPE = ("case", "file")
ROLE = ("requested-symbol", "requested-seed", "focused-test-route", "symbol-neighborhood", "file-neighborhood", "transitive-context")


def _priority(column: str, names: tuple[str, ...]) -> Column:
    """Place in a list; after its end if not there."""
    out = F.lit(len(names))
    for i, n in enumerate(names):
        out = F.when(F.col(column) == n, i).otherwise(out)
    return out


def test_order(matches: DataFrame, most: int, by_retrieval: bool = False) -> DataFrame:
    """The first ``most`` test matches, with their ``place``.

    By provenance, seed score and rank, confidence (where the provenance does not say more), scope,
    target role, symbol and seed distance, route count, path, group, selector and line; affinity comes
    after the seed rank if a text was searched for, else after the distances.
    """
    sure = F.col("provenance").isin(*PROVENANCE)
    affinity = [F.desc("affinity")]
    order = [
        _priority("provenance", PROVENANCE), F.desc("seed_score"), "seed_rank", *(affinity if by_retrieval else []),
        F.when(sure, 0).otherwise(_priority("confidence", CONFIDENCE)), _priority("scope", SCOPE), _priority("role", ROLE),
        "symbol_distance", "seed_distance", *([] if by_retrieval else affinity), "route_count", "path", "grp", "selector", "line",
    ]
    return _ranked(matches, order, most)


test_order.__test__ = False  # an operator, not a test


def _ranked(rows: DataFrame, order: list, most: int) -> DataFrame:
    shown = rows.orderBy(*order).limit(most)
    return shown.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a window over at most that many rows
