"""Cheapest ways through a street graph whose costs depend on when one passes: labels relaxed cell by cell.

The graph is cut into cells of space. A label is the cheapest known cost of reaching a node, with the minute at which one is
then there. In each round, every (trip, cell) whose entries have changed settles its nodes: the cells' arcs and the labels
that enter meet in a cogroup, and the labels that leave are the next entries of the neighbours. Entries are replaced, not
merged: a label counts only as long as the cell it came from still sends it, so that the fixed point is that of a search
which settles the whole graph in order of cost, also where waiting would pay. Rounds follow the number of cells on a way, not
of its arcs; no task holds more than a cell, and its share of the trips.

A component of few nodes is a cell as a whole: nothing leaves it, so its trips are searched once, up to their goals, and need
no rounds. The arcs of a component are dealt to as many tasks as its own trips fill, whatever trips there are elsewhere.

A way is found backwards: each label that leaves a cell names the label that it entered by, so a chain of joins lists the
cells of a way, and one more pass over those alone writes the nodes between.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .graph import both_ways, components

#: Where the steps of the day begin, and how long each is, in minutes.
FIRST, STEP = 300, 15
#: Metres that an edge counts at least: a circle of edges that cost nothing would keep its labels for ever.
LEAST = 0.1
LABEL = "trip long, cell string, node long, cost double, clock double, src long, from_cell string, from_node long, from_src long, alpha double, part int"
WAY = "trip long, cell string, depth int, place int, src long, node long, edge long, seconds double, cost double, clock double, length double, index int, sun int, side string, segment long"


def arcs_of(edges: DataFrame, nodes: DataFrame, exposures: DataFrame, speed: float = 1.35, penalty: float = 25.0) -> DataFrame:
    """Arcs of both directions, with what passing them takes and how exposed they are at each step of the day.

    ``edges`` (edge, src, dst, segment, sides, length, crossing), ``nodes`` (node_id, lon, lat, cell, parts: how many
    tasks share its arcs), ``exposures`` (sides, octant, index, work, sun, side: arrays by step). A crossing costs
    ``penalty`` seconds, shared among the edges of its segment by length. Edges without exposures count as unexposed.
    """
    whole = edges.groupBy("segment").agg((F.sum(F.round(F.col("length") * 1e6).cast("long")) / 1e6).alias("whole"))  # whole numbers: the same in any order
    both = both_ways(edges).join(whole, "segment")
    for end in ("src", "dst"):
        both = both.join(nodes.select(F.col("node_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("lon", "lat", "cell", "parts")]), end)
    east = (F.col("dst_lon") - F.col("src_lon")) * F.cos(F.radians((F.col("dst_lat") + F.col("src_lat")) / 2)) * 111320
    north = (F.col("dst_lat") - F.col("src_lat")) * 111132
    octant = F.pmod(F.round(F.degrees(F.atan2(east, north)) / 45), F.lit(8.0)).cast("int")
    share = F.when(F.col("crossing") & (F.col("whole") > 0), F.col("length") / F.col("whole")).otherwise(0.0)
    seconds = F.greatest(F.col("length"), F.lit(LEAST)) / speed + share * penalty
    return both.withColumns({"octant": octant, "seconds": seconds}).join(exposures, ["sides", "octant"], "left").select("edge", "src", "dst", F.col("src_cell").alias("cell"), "dst_cell", "segment", "length", "seconds", "index", "work", "sun", "side", F.col("src_parts").alias("parts"))


class Cell:
    """Arcs of a cell by source, and the search within it."""

    def __init__(self, arcs: pd.DataFrame):
        self.out = defaultdict(list)
        for a in arcs.itertuples(index=False):
            self.out[a.src].append((a.dst, a.dst_cell, a))

    @staticmethod
    def passed(arc, clock: float, alpha: float) -> tuple[float, int]:
        """Cost of an arc entered at this minute, and the step of the day at its middle."""
        if arc.index is None:
            return arc.seconds, -1
        at = int((clock + arc.seconds / 120 - FIRST) // STEP)
        at = min(max(at, 0), len(arc.index) - 1)
        return arc.seconds * (1 + 2 * arc.work[at] / 100) * (1 + alpha * arc.index[at] / 100), at

    def settle(self, entries: list[tuple], alpha: float, until: set | None = None) -> tuple[dict, list[tuple]]:
        """Labels of the cell's nodes: node -> (cost, clock, src, entry); and labels that leave: (dst_cell, dst, cost, clock, src, entry).

        ``entries``: (cost, clock, node, src). Ties go to the earlier clock, then to the smaller node and source.
        ``until``: nodes after which nothing more is asked.
        """
        left = set(until or ())
        heap = [(cost, clock, node, src, (node, src)) for cost, clock, node, src in entries]
        heapq.heapify(heap)
        known: dict = {}
        leaving: dict = {}
        while heap:
            cost, clock, node, src, entry = heapq.heappop(heap)
            if node in known:
                continue
            known[node] = (cost, clock, src, entry)
            if left:
                left.discard(node)
                if not left:
                    break
            for dst, to, arc in self.out.get(node, ()):
                if dst in known:
                    continue
                label = (cost + self.passed(arc, clock, alpha)[0], clock + arc.seconds / 60)
                if to == arc.cell:
                    heapq.heappush(heap, (*label, dst, node, entry))
                elif dst not in leaving or (*label, node) < leaving[dst][0]:
                    leaving[dst] = ((*label, node), to, entry)
        return known, [(to, dst, *label, entry) for dst, (label, to, entry) in leaving.items()]


def _met(rows: DataFrame, arcs: DataFrame):
    """``rows`` cogrouped with the arcs of their cells alone: those of other cells stay where they are."""
    return rows.groupBy("cell", "part").cogroup(arcs.join(rows.select("cell", "part").distinct(), ["cell", "part"], "left_semi").groupBy("cell", "part"))


def _round(entries: DataFrame, arcs: DataFrame) -> DataFrame:
    """What the cells of ``entries`` send to their neighbours."""

    def run(key, labels: pd.DataFrame, streets: pd.DataFrame) -> pd.DataFrame:
        cell, rows = Cell(streets), []
        for trip, each in labels.groupby("trip"):
            alpha = float(each["alpha"].iloc[0])
            _, leaving = cell.settle(list(zip(each["cost"], each["clock"], each["node"], each["src"], strict=True)), alpha)
            rows += [(trip, to, dst, cost, clock, src, key[0], *entry, alpha, key[1]) for to, dst, cost, clock, src, entry in leaving]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LABEL.split(", ")])

    return _met(entries, arcs.drop("sun", "side", "segment")).applyInPandas(run, LABEL)


def relaxed(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """The fixed point: all labels that enter a cell, the starts (as LABEL has them) among them."""
    labels, changed = starts, starts.select("trip", "cell").distinct()
    while not changed.isEmpty():
        sent = materialize(_round(labels.join(changed, ["trip", "cell"], "left_semi").select(labels.columns), arcs), "labels")
        origin = changed.withColumnRenamed("cell", "from_cell")
        stale = labels.join(origin, ["trip", "from_cell"], "left_semi").select(sent.columns)
        kept = labels.join(origin, ["trip", "from_cell"], "left_anti").select(sent.columns)
        told = stale.withColumn("sign", F.lit(-1)).unionByName(sent.withColumn("sign", F.lit(1)))
        differs = told.groupBy("trip", "cell", "node", "cost", "clock", "src", "from_cell").agg(F.sum("sign").alias("sign")).where("sign != 0")
        labels, changed = materialize(kept.unionByName(sent), "labels"), materialize(differs.select("trip", "cell").distinct(), "changed")
    return labels


def connected(edges: DataFrame, nodes: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trips that have a way, and the nodes that these can pass, both with their component: streets run both ways, so a trip has one if its ends are of one component.

    A search for the others would settle all that they can reach to find nothing.
    """
    labels = components(nodes, edges)
    end = lambda name: labels.select(F.col("node_id").alias(name), F.col("component").alias(f"{name}_component"))
    asked = trips.where("start != goal").join(end("start"), "start").join(end("goal"), "goal").where("start_component = goal_component")
    asked = materialize(asked.select("trip", "start", "goal", "alpha", "departure", F.col("start_component").alias("component")), "trips")
    passed = labels.join(asked.select("component").distinct(), "component", "left_semi")
    return nodes.join(passed, "node_id"), asked


def routes(edges: DataFrame, nodes: DataFrame, exposures: DataFrame, trips: DataFrame, cell: Column, speed: float = 1.35, penalty: float = 25.0, trips_a_task: int = 200, whole: int = 5_000) -> DataFrame:
    """Every hop of every trip's way, in order: trip, hop, src, node, edge, seconds, cost and clock so far, and the hop's length, index, sun, side and segment.

    A trip without a way, or to where it starts, has no rows. Index and sun are those of the hop's middle; the side is that
    with the least index and work. Unknown starts and goals have no way. ``cell``: name of a node's cell, from its columns;
    a component of at most ``whole`` nodes is one cell.
    """
    nodes, trips = connected(edges, nodes, trips)
    tasks = trips.groupBy("component").agg(F.ceil(F.count("*") / trips_a_task).cast("int").alias("parts"))
    areas = materialize(nodes.groupBy("component").agg((F.count("*") <= whole).alias("one")).join(tasks, "component"), "areas")
    of = F.when(F.col("one"), F.concat(F.lit("component "), F.col("component"))).otherwise(cell.cast("string"))
    nodes = materialize(nodes.join(areas, "component").select("node_id", "lon", "lat", of.alias("cell"), "one", "parts"), "nodes")
    arcs = arcs_of(edges, nodes, exposures, speed, penalty)
    dealt = materialize(arcs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), "arcs")
    end = lambda name: nodes.select(F.col("node_id").alias(name), F.col("cell").alias(f"{name}_cell"), *(["one", "parts"] if name == "start" else []))
    asked = trips.join(end("start"), "start").join(end("goal"), "goal").withColumn("part", F.pmod(F.xxhash64("trip"), "parts").cast("int"))
    asked = materialize(asked.select("trip", "start", "goal", "start_cell", "goal_cell", F.col("alpha").cast("double").alias("alpha"), F.col("departure").cast("double").alias("departure"), "one", "part"), "asked")
    near, far = asked.where("one"), asked.where("not one")
    hops = _traced(_starts(near), _goals(near), dealt, ways=True)
    if not far.isEmpty():
        hops = hops.unionByName(_crossing(far, dealt))
    hop = F.row_number().over(Window.partitionBy("trip").orderBy(F.desc("depth"), "place")).alias("hop")
    told = hops.select("*", hop).join(asked.select("trip", "departure"), "trip")
    return told.select("trip", "hop", "src", "node", "edge", ((F.col("clock") - F.col("departure")) * 60).alias("seconds"), "cost", "clock", "length", "index", "sun", "side", "segment")


def _starts(trips: DataFrame) -> DataFrame:
    no, none = F.lit(-1).cast("long"), F.lit(None).cast("string")
    return trips.select("trip", F.col("start_cell").alias("cell"), F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.col("departure").alias("clock"), no.alias("src"), none.alias("from_cell"), no.alias("from_node"), no.alias("from_src"), "alpha", "part")


def _goals(trips: DataFrame) -> DataFrame:
    return trips.select("trip", F.col("goal_cell").alias("cell"), F.col("goal").alias("node"), F.lit(-1).cast("long").alias("onto"), F.lit(0).alias("depth"), "alpha", "part")


def _crossing(trips: DataFrame, dealt: DataFrame) -> DataFrame:
    """The hops (WAY) of trips through components of several cells."""
    labels = relaxed(dealt, _starts(trips))
    # A goal's cell settles once to tell by which entry it is reached; the entry tells the cell before, and so on.
    reached = materialize(_traced(labels, _goals(trips), dealt, ways=False), "reached").select("trip", "cell", F.col("node").alias("exit"), F.col("src").alias("entry"), F.col("edge").alias("entry_src"))
    no = F.lit(-1).cast("long")
    at = crossed = reached.withColumns({"onto": no, "depth": F.lit(0)})
    border = labels.select("trip", "cell", F.col("node").alias("entry"), F.col("src").alias("entry_src"), "from_cell", "from_node", "from_src").where("from_cell is not null")
    while True:
        came = at.select("trip", "cell", "entry", "entry_src", "depth").join(border, ["trip", "cell", "entry", "entry_src"])
        at = materialize(came.select("trip", F.col("from_cell").alias("cell"), F.col("entry_src").alias("exit"), F.col("from_node").alias("entry"), F.col("from_src").alias("entry_src"), F.col("entry").alias("onto"), (F.col("depth") + 1).alias("depth")), "legs")
        if at.isEmpty():
            break
        crossed = crossed.unionByName(at)
    passed = crossed.select("trip", "cell", F.col("exit").alias("node"), "onto", "depth").join(trips.select("trip", "alpha", "part"), "trip")
    return _traced(labels, passed, dealt, ways=True)


def _traced(labels: DataFrame, wanted: DataFrame, dealt: DataFrame, ways: bool) -> DataFrame:
    """For each wanted node of a cell (trip, cell, node, onto, depth, alpha, part): the entry that it is reached by (as ``src`` and ``edge``), or, with ``ways``, every hop from that entry to it, and the hop over the border to ``onto``."""
    no = F.lit(-1).cast("long")
    cells = labels.join(wanted.select("trip", "cell").distinct(), ["trip", "cell"], "left_semi").select("trip", "cell", "node", "cost", "clock", "src", "alpha", "part").withColumns({"goal": F.lit(False), "onto": no, "depth": F.lit(0)})
    asked = wanted.select("trip", "cell", "node", F.lit(0.0).alias("cost"), F.lit(0.0).alias("clock"), no.alias("src"), "alpha", "part", F.lit(True).alias("goal"), "onto", "depth")
    columns = [c.split()[0] for c in WAY.split(", ")]

    def run(key, rows: pd.DataFrame, streets: pd.DataFrame) -> pd.DataFrame:
        cell, found = Cell(streets), []
        for trip, each in rows.groupby("trip"):
            entries, goals = each[~each["goal"]], each[each["goal"]]
            alpha = float(each["alpha"].iloc[0])
            known, _ = cell.settle(list(zip(entries["cost"], entries["clock"], entries["node"], entries["src"], strict=True)), alpha, set(goals["node"]))
            for node, onto, depth in zip(goals["node"], goals["onto"], goals["depth"], strict=True):
                if node not in known:
                    continue
                if not ways:
                    cost, clock, _, entry = known[node]
                    found.append((trip, key[0], 0, 0, entry[0], node, entry[1], 0.0, cost, clock, 0.0, None, None, None, None))
                    continue
                entry = known[node][3]
                hops = [(node, onto)] if onto >= 0 else []
                while (node, known[node][2]) != entry:
                    hops.append((known[node][2], node))
                    node = known[node][2]
                for place, (a, b) in enumerate(reversed(hops)):
                    cost, clock = known[a][:2]
                    made = [(cost + cell.passed(arc, clock, alpha)[0], clock + arc.seconds / 60, arc) for dst, _, arc in cell.out[a] if dst == b]
                    total, then, arc = min(made, key=lambda m: m[:2])
                    at = cell.passed(arc, clock, alpha)[1]
                    seen = (None, None, None) if at < 0 else (int(arc.index[at]), int(arc.sun[at]), arc.side[at])
                    found.append((trip, key[0], depth, place, a, b, arc.edge, arc.seconds, total, then, arc.length, *seen, arc.segment))
        return pd.DataFrame(found, columns=columns)

    return _met(cells.unionByName(asked), dealt).applyInPandas(run, WAY)


def summary(hops: DataFrame) -> DataFrame:
    """(trip, seconds, meters, index, sun) of whole ways: index and sun weighted by length."""
    n = F.round(F.col("length") * 1e6).cast("long")  # whole micrometres, so that sums do not depend on the order
    weighted = lambda c: F.when(F.sum(n) > 0, F.sum(F.coalesce(F.col(c), F.lit(0)) * n) / F.sum(n)).otherwise(0.0)
    return hops.groupBy("trip").agg(F.max("seconds").alias("seconds"), (F.sum(n) / 1e6).alias("meters"), weighted("index").alias("index"), weighted("sun").alias("sun"))


def departures(edges: DataFrame, nodes: DataFrame, exposures: DataFrame, trips: DataFrame, cell: Column, span: int = 180, step: int = 15, last: int = 1320, **how) -> DataFrame:
    """Each trip at every departure of the next ``span`` minutes, all in one relaxation: trip, departure, seconds, index; and
    ``best`` (the least index, the first of equals), ``gain`` (how much less than leaving at once, rounded) and ``peak`` (the largest index, 1 at least).

    Departures end at ``last``, the end of the computed day; trips with fewer than two have no rows.
    """
    later = F.sequence(F.col("departure"), F.least(F.col("departure") + span, F.lit(last)), F.lit(step))
    ways = trips.where(F.col("departure") + step <= last).withColumn("leave", F.explode(later))
    count = span // step + 1
    each = ways.select((F.col("trip") * count + ((F.col("leave") - F.col("departure")) / step).cast("long")).alias("trip"), "start", "goal", "alpha", F.col("leave").alias("departure"))
    found = summary(routes(edges, nodes, exposures, each, cell, **how))
    named = found.select(F.floor(F.col("trip") / count).alias("trip"), (F.col("trip") % count).alias("k"), "seconds", "index").join(trips.select("trip", "departure"), "trip")
    of = Window.partitionBy("trip")
    first = of.orderBy("k")
    best = F.first("k").over(of.orderBy("index", "k"))
    told = named.withColumns({"leave": F.col("departure") + F.col("k") * step, "is_best": F.col("k") == best, "now": F.first("index").over(first), "least": F.min("index").over(of), "peak": F.greatest(F.lit(1.0), F.max("index").over(of))})
    return told.select("trip", F.col("leave").cast("int").alias("departure"), "seconds", "index", F.col("is_best").alias("best"), F.floor(F.col("now") - F.col("least") + 0.5).cast("int").alias("gain"), "peak")
