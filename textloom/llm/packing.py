"""Filling fixed-capacity containers with items of varying length.

Items are routed to context-size tiers by length: windows of the capacity, half of it, a quarter and so on, each
item to the shortest window that holds it. The tiers are packed from the longest down: a tier's own items into
containers of its own, best fit by falling length, and then the gaps of these containers are filled from all
shorter tiers, longest items first. What shorter tiers have left is packed in their turn. Items longer than the
capacity are cut into full containers and a rest. Containers are dealt out to step groups by falling fill, back
and forth, which balances the groups' tokens.

All of this is decided on the histogram of lengths, which has at most ``capacity`` entries whatever the
number of items: whole groups of equal containers are planned at once. Items then look up their place by
their rank among the items of their length. Ranks come from salted groups, so a length that a third of
all items share is no single task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.session import cut_lineage

#: Containers that one training step takes; their token totals are balanced over the groups.
STEP = 8
SALTS = 128
#: Shorter windows than the capacity halved so often are one tier.
LAST_TIER = 12
#: Rows of the plan up to which it is broadcast (about 10 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
PLAN_SCHEMA = "budget string, len int, first_rank bigint, end_rank bigint, per int, first_container bigint, at int, fill int, container_tier int"


class _Group:
    """Containers filled alike. items: (length, first rank, how many in each container)."""

    __slots__ = ("count", "room", "items")

    def __init__(self, count: int, room: int, items: list[tuple[int, int, int]]) -> None:
        self.count, self.room, self.items = count, room, items

    def split(self, n: int) -> _Group:
        """Take the first n containers out of the group."""
        taken = _Group(n, self.room, list(self.items))
        self.items = [(length, first + n * per, per) for length, first, per in self.items]
        self.count -= n
        return taken


def tier_of(length: int, capacity: int) -> int:
    """0 for lengths over half the capacity, 1 over a quarter, and so on: the tier whose window is the shortest that holds the length."""
    tier = 0
    while length * 2 <= capacity and tier < LAST_TIER:
        length, tier = length * 2, tier + 1
    return tier


class _Open:
    """The open containers of one tier, by their room."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rooms: list[int] = []  # rooms with groups, ascending
        self.groups: dict[int, list[_Group]] = defaultdict(list)

    def _put(self, g: _Group) -> None:
        if not self.groups[g.room]:
            insort(self.rooms, g.room)
        self.groups[g.room].append(g)

    def place(self, length: int, left: int, rank: int, new: bool) -> tuple[int, int]:
        """Put items of a length into the fullest containers they fit; if new, open some for the rest. What is left, and the next rank."""
        while left:
            k = bisect_left(self.rooms, length)
            if k < len(self.rooms):
                room = self.rooms[k]
                group = self.groups[room].pop()
                if not self.groups[room]:
                    self.rooms.pop(k)
            elif new:
                group = _Group(max(1, left // (self.capacity // length)), self.capacity, [])
            else:
                break
            per = min(group.room // length, left)
            used = min(group.count, left // per)
            if used < group.count:
                rest, group = group, group.split(used)
                self._put(rest)
            group.items.append((length, rank, per))
            group.room -= per * length
            self._put(group)
            rank += per * used
            left -= per * used
        return left, rank


def plan(histogram: dict[int, int], capacity: int) -> list[_Group]:
    """Groups of equal containers for a histogram {length: number of items}, lengths from 1 to capacity."""
    tiers: dict[int, list[int]] = defaultdict(list)
    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        tiers[tier_of(length, capacity)].append(length)
    state = {length: (histogram[length], 0) for lengths in tiers.values() for length in lengths}  # left, next rank
    done: list[_Group] = []
    for tier in sorted(tiers):
        containers = _Open(capacity)
        for length in tiers[tier]:
            state[length] = containers.place(length, *state[length], new=True)
        for shorter in sorted(t for t in tiers if t > tier):
            for length in tiers[shorter]:
                if state[length][0] and containers.rooms[-1] >= length:
                    state[length] = containers.place(length, *state[length], new=False)
        done += [g for room in containers.rooms for g in containers.groups[room]]
    return done


def plan_rows(budget: str, groups: list[_Group], capacity: int) -> list[tuple]:
    """Look-up rows; containers are numbered from the fullest down."""
    rows, number = [], 0
    for g in sorted(groups, key=lambda g: (g.room, g.items)):
        at = 0
        for length, first, per in g.items:
            rows.append((budget, length, first, first + per * g.count, per, number, at, capacity - g.room, tier_of(g.items[0][0], capacity)))
            at += per * length
        number += g.count
    return rows


def pack(items: DataFrame, budgets: DataFrame, key: str = "doc_id", size: str = "n_tokens", salts: int = SALTS, step: int = STEP) -> DataFrame:
    """One row for each budget, item and piece, with its container.

    items: (key, size); budgets: (budget_name, capacity_tokens), a small table of settings. Result:
    budget_name, capacity_tokens, key, piece_no, start_token, piece_tokens, tier, container_id,
    container_tier, offset_tokens, container_tokens, step_group. Items are split only if longer than the
    capacity: into full pieces and a rest. Items without a size or of size 0 take no room; they get one
    piece of 0 tokens spread over the existing containers (container 0 if there is none). Repeated keys
    are items of their own. Budgets without a positive capacity are an error.
    """
    spark = items.sparkSession
    settings = [(r[0], r[1]) for r in budgets.select("budget_name", "capacity_tokens").distinct().collect()]
    if any(c is None or c < 1 for _, c in settings):
        raise ValueError("a budget needs a positive capacity")
    # the settings are a few literals in the plan: no join
    small = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(c).cast("int").alias("cap")) for b, c in settings])
    lengths = items.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int").alias("n"))
    lengths = cut_lineage(lengths)  # read three times below; tokenising is the dear part
    # histograms: at most the sum of the capacities in rows
    tally = lengths.groupBy("n").count().select("n", "count", F.inline(small))
    full = tally.filter("n >= cap").groupBy("budget", "cap").agg(F.sum(F.expr("n div cap") * F.col("count")).alias("c")).select("budget", F.col("cap").alias("len"), "c")
    rest = tally.filter("n % cap > 0").groupBy("budget", F.expr("n % cap").alias("len")).agg(F.sum("count").alias("c"))
    histograms: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for budget, length, c in full.unionByName(rest).collect():
        histograms[budget][length] += c
    rows, containers = [], []
    for budget, capacity in settings:
        groups = plan(histograms[budget], capacity)
        rows += plan_rows(budget, groups, capacity)
        containers.append((budget, capacity, sum(g.count for g in groups)))
    places = spark.createDataFrame(rows, PLAN_SCHEMA)  # a few rows for each length
    totals = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(c).cast("int").alias("cap"), F.lit(n).cast("bigint").alias("n_containers")) for b, c, n in containers])

    pieces = (
        lengths.select("_key", "n", F.inline(totals))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.expr("(n + cap - 1) div cap").cast("int"), F.lit(1)) - 1)))
        .withColumn("len", F.least(F.col("n") - F.col("piece_no") * F.col("cap"), F.col("cap")))
        .withColumn("salt", F.pmod(F.xxhash64("_key", "piece_no"), F.lit(salts)).cast("int"))
    )
    placed = pieces.filter("len > 0")
    # rank of an item among those of its length: its rank within its salt, after the counts of the salts before
    by_salt = Window.partitionBy("budget", "len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("budget", "len", "salt").count().select("budget", "len", "salt", F.coalesce(F.sum("count").over(by_salt), F.lit(0)).alias("before"))
    ranked = (
        placed.withColumn("r", F.row_number().over(Window.partitionBy("budget", "len", "salt").orderBy("_key", "piece_no")) - 1)
        .join(before, ["budget", "len", "salt"])
        .withColumn("rank", F.col("r") + F.col("before"))
    )
    slot = F.expr("(rank - first_rank) % per")
    places = places.withColumnRenamed("budget", "b").withColumnRenamed("len", "l")
    hits = ranked.join(
        F.broadcast(places) if len(rows) <= BROADCAST_ROWS else places,
        F.expr("budget = b AND len = l AND rank >= first_rank AND rank < end_rank"),
    ).select("budget", "cap", "n_containers", "_key", "piece_no", "len", F.expr("first_container + (rank - first_rank) div per").alias("container_id"), "container_tier", (F.col("at") + slot * F.col("len")).cast("int").alias("offset_tokens"), F.col("fill").alias("container_tokens"))
    empty = pieces.filter("len = 0").select(
        "budget", "cap", "n_containers", "_key", "piece_no", "len", F.pmod(F.xxhash64("_key"), F.greatest("n_containers", F.lit(1))).alias("container_id"),
        F.lit(None).cast("int").alias("container_tier"), F.lit(0).alias("offset_tokens"), F.lit(None).cast("int").alias("container_tokens"),
    )
    # containers are numbered by fill: dealing them out back and forth balances the step groups
    out = hits.unionByName(empty).withColumn("g", F.greatest(F.ceil(F.col("n_containers") / step), F.lit(1)))
    lap, at = F.expr("container_id div g"), F.expr("container_id % g")
    tier = F.when(F.col("len") > 0, F.least(F.floor(F.log2(F.col("cap") / F.col("len"))), F.lit(LAST_TIER)).cast("int"))
    return out.select(
        F.col("budget").alias("budget_name"), F.col("cap").alias("capacity_tokens"), F.col("_key").alias(key), "piece_no", (F.col("piece_no") * F.col("cap")).alias("start_token"),
        F.col("len").alias("piece_tokens"), tier.alias("tier"), "container_id", "container_tier", "offset_tokens", "container_tokens",
        F.when(lap % 2 == 0, at).otherwise(F.col("g") - 1 - at).alias("step_group"),
    )


def packing_report(packed: DataFrame) -> DataFrame:
    """How well the containers of each budget are filled: items, tokens, containers, share of room unused, step groups and the spread of their tokens.

    Waste counts against the room of all containers; the fullest and emptiest step groups are compared by mean tokens a container.
    """
    by_container = packed.groupBy("budget_name", "capacity_tokens", "step_group", "container_id").agg(F.sum("piece_tokens").alias("t"), F.count("*").alias("pieces"), F.max("container_tier").alias("tier"))
    by_group = by_container.groupBy("budget_name", "capacity_tokens", "step_group").agg(
        F.sum("t").alias("t"), F.count("*").alias("c"), F.sum("pieces").alias("pieces"), *[F.count_if(F.coalesce(F.least("tier", F.lit(3)), F.lit(0)) == i).alias(f"c{i}") for i in range(4)]
    )
    return by_group.groupBy("budget_name", "capacity_tokens").agg(
        F.sum("pieces").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.sum("c").alias("n_containers"), F.round(1 - F.sum("t") / (F.sum("c") * F.col("capacity_tokens")), 6).alias("waste"),
        F.count("*").alias("n_steps"), F.round(F.min(F.col("t") / F.col("c")), 3).alias("least_step_mean"), F.round(F.max(F.col("t") / F.col("c")), 3).alias("greatest_step_mean"),
        *[F.sum(f"c{i}").alias(f"containers_tier_{i}" + ("_up" if i == 3 else "")) for i in range(4)],
    )
