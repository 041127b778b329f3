"""Duplicates by exact identity: a destination, or a requisition of one employer, with vetoes where both disagree.

Two members are the same if they share a destination or a requisition and contradict each other in neither. Members join, best
rank first, the first group all of whose members they are the same as, so that a chain A - X - B does not make one
group of two destinations. Members of one identity join alike, so each identity stands for its members; identities that
share a destination or requisition, over any steps, are one component, and components are independent of each other. A
component is grouped in one task, as who joins a group depends on who has joined before, in time about linear in its
identities.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.sources.scratch import stored

IDENTITY = ["destination", "requisition", "requisition_source", "source", "board", "employer", "strong"]


def rank(listing: Column, truncated: Column, discovered: Column, key: Column) -> Column:
    """What makes the better member: open, with its whole text, with a clock, found early, then by key."""
    open_ = F.when(listing == "open", 0).when(listing == "closed", 2).otherwise(1)
    return F.struct(open_.alias("a"), F.coalesce(truncated, F.lit(False)).cast("int").alias("b"), discovered.isNull().cast("int").alias("c"), F.coalesce(discovered, F.lit(0.0)).alias("d"), key.alias("e"))


class _Group:
    """What a new member has to agree with: the group's destination, the strong requisition of those that share it, and, of members
    without a destination, one requisition and the ways in which it is theirs."""

    __slots__ = ("identity", "destination", "strong", "requisition", "ways", "bound", "version")

    def __init__(self, identity: str) -> None:
        self.identity, self.destination, self.strong, self.version = identity, "", "", 0
        self.requisition: str | None = None  # that of all members; "" once they differ
        self.ways = self.bound = frozenset()  # of all members, and of those without a destination

    def add(self, m, way: tuple) -> bool:
        """Whether what later members have to agree with has changed."""
        old = (self.destination, self.strong, self.requisition, self.ways, self.bound)
        self.requisition = m.requisition if self.requisition in (None, m.requisition) else ""
        self.ways = self.ways if way in self.ways else self.ways | {way}
        if m.destination:
            self.destination = m.destination
            self.strong = self.strong or (m.requisition if m.strong else "")
        elif way not in self.bound:
            self.bound = self.bound | {way}
        return old != (self.destination, self.strong, self.requisition, self.ways, self.bound)


class _Waiting:
    """Groups, as heaps of (place, version), by what a member is asked; a group that has changed since is skipped. Those that would
    answer alike are asked once, however many they are."""

    def __init__(self, groups: list[_Group]) -> None:
        self.groups = groups
        self.by: dict = defaultdict(dict)

    def put(self, key: str, asked, at: int) -> None:
        heapq.heappush(self.by[key].setdefault(asked, []), (at, self.groups[at].version))

    def first(self, key: str, takes: Callable) -> int | None:
        best, empty = None, []
        heaps = self.by.get(key, {})
        for asked, heap in heaps.items():
            while heap and self.groups[heap[0][0]].version != heap[0][1]:
                heapq.heappop(heap)
            if not heap:
                empty.append(asked)
            elif (best is None or heap[0][0] < best) and takes(asked):
                best = heap[0][0]
        for asked in empty:
            del heaps[asked]
        return best


def _shared(a: tuple, b: tuple) -> bool:
    """Whether two members' equal requisitions are one: numbers of the same board, or of one employer unless both are boards' own."""
    own = a[0] and b[0]
    return bool((own and a[2] and a[1:3] == b[1:3]) or (not own and a[3] and a[3] == b[3]))


class _Component:
    """The groups of one component's identities, which come best first.

    A member can only join groups of its destination, and those without one that are of its requisition; a member without a
    destination only those of its requisition.
    """

    def __init__(self) -> None:
        self.groups: list[_Group] = []
        self.of_destination, self.open_, self.of_requisition = (_Waiting(self.groups) for _ in range(3))

    def joined(self, m) -> str:
        way = (m.requisition_source == "external_id", m.source, m.board, m.employer)
        agrees = lambda ways: all(_shared(way, w) for w in ways)
        if m.destination:
            found = [self.of_destination.first(m.destination, lambda x: not (m.strong and m.requisition and x[0] not in ("", m.requisition)) and (not x[2] or (x[1] == m.requisition != "" and agrees(x[2]))))]
            found += [self.open_.first(m.requisition, agrees)] if m.requisition else []
        else:
            found = [self.of_requisition.first(m.requisition, agrees)]
        at = min((i for i in found if i is not None), default=None)
        if at is None:
            at = len(self.groups)
            self.groups.append(_Group(m.identity))
        g = self.groups[at]
        if g.add(m, way):
            g.version += 1
            if g.destination:
                self.of_destination.put(g.destination, (g.strong, g.requisition, g.bound), at)
            if g.requisition:
                self.of_requisition.put(g.requisition, g.ways, at)
                if not g.destination:
                    self.open_.put(g.requisition, g.ways, at)
        return g.identity


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(identity, group) of identities that come component by component, the best first in each; what is kept is groups, not members."""
    root, component = None, None
    for b in batches:
        out = []
        for m in b.itertuples(index=False):
            if m.root != root:
                root, component = m.root, _Component()
            out.append((m.identity, component.joined(m)))
        yield pd.DataFrame(out, columns=["identity", "group"])


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of links (node, hub): the smallest node reachable through hubs, by minima passed on until nothing changes."""
    of = stored(links.groupBy("node").agg(F.min("node").alias("root")))
    for _ in range(most_rounds):
        hubs = links.join(of, "node").groupBy("hub").agg(F.min("root").alias("root"))
        new = stored(links.join(hubs, "hub").groupBy("node").agg(F.min("root").alias("root")))
        if new.join(of.withColumnRenamed("root", "was"), "node").where("root <> was").isEmpty():
            return new
        of = new
    raise RuntimeError("the components have not settled")


def duplicates(members: DataFrame, key: str, ranked: Column) -> DataFrame:
    """(key, winner) of each member (key, IDENTITY): winner is the key of its group's best member, its own where it has no identity."""
    m = members.select(key, *IDENTITY, ranked.alias("r")).withColumn("named", (F.coalesce("destination", F.lit("")) != "") | (F.coalesce("requisition", F.lit("")) != ""))
    # without a destination, one identity's members are the same only by a board or an employer; others stand alone
    own = F.col("requisition_source") == "external_id"
    whole = (F.coalesce("destination", F.lit("")) != "") | F.coalesce(F.when(own, F.col("board") != "").otherwise(F.col("employer") != ""), F.lit(False))
    identity = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IDENTITY), F.when(whole, "").otherwise(F.col(key).cast("string"))), 256)
    m = m.where("named").withColumn("identity", identity)
    best = stored(m.groupBy("identity").agg(F.min_by(F.struct(key, "r", *IDENTITY), "r").alias("b")).select("identity", "b.*"))
    hubs = F.array(F.when(F.coalesce("destination", F.lit("")) != "", F.concat(F.lit("d"), "destination")), F.when(F.coalesce("requisition", F.lit("")) != "", F.concat(F.lit("r"), "requisition")))
    root = components(stored(best.select(F.col("identity").alias("node"), F.explode(F.array_compact(hubs)).alias("hub"))))
    # a component's identities are ranked by one number, as structs do not reach the workers in order
    place = F.concat_ws("|", F.lpad(F.col("r.a").cast("string"), 1, "0"), F.col("r.b").cast("string"), F.col("r.c").cast("string"), F.lpad(F.format_string("%.6f", F.col("r.d")), 24, "0"), F.lpad(F.col("r.e").cast("string"), 24, "0"))
    rows = best.join(root.withColumnRenamed("node", "identity"), "identity").select("root", "identity", place.alias("place"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != "strong" else F.coalesce("strong", F.lit(False)).alias("strong") for c in IDENTITY))
    groups = rows.repartition("root").sortWithinPartitions("root", "place").mapInPandas(_grouped, "identity string, group string")
    winner = best.select(F.col("identity").alias("group"), F.col(key).alias("winner"))
    found = m.select(key, "identity").join(groups, "identity").join(winner, "group").select(F.col(key).alias("__k"), "winner")
    return members.select(key).join(found, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("winner", F.col(key)).alias("winner"))
