"""Filling containers of a fixed capacity: hierarchical packing over several window lengths.

Each text is routed to the tier of the shortest window (an eighth, a quarter, a half, the whole of the capacity) that holds it. The tiers
are packed from the longest down: a text opens a window of its tier, and the window's gap is filled with the longest texts that fit, of its own
tier first, then of shorter ones. A window that would stay emptier than ``LEAST_FILL`` isn't used: its texts are routed on to the whole capacity,
where what is left over is packed longest first. Windows of equal length lie side by side in a container, and no text crosses a window.

Only the number of texts of each size (at most ``capacity`` numbers) comes to the driver, where patterns are planned: how many texts
of which sizes share a window, and how often. Each text then finds its place by its rank among the texts of its size, which is counted
without putting them into one group. Containers are dealt to step groups there and back, so that groups get containers of every tier.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folianto.plans.lineage import cut

CAPACITY, STEP = 2048, 64
#: Share of a window shorter than the capacity that must be filled.
LEAST_FILL = 0.99
#: Rows ranked in one group.
RANKED = 65_536


def windows_of(capacity: int) -> list[int]:
    """An eighth, a quarter, a half and the whole of the capacity."""
    return sorted({max(1, capacity // k) for k in (8, 4, 2, 1)})


@dataclass(frozen=True)
class Slot:
    """``copies * uses`` texts of ``size``, from ``rank`` on, go to containers ``first .. first + uses - 1`` at ``offset``, ``offset + size`` ..."""

    size: int
    rank: int
    uses: int
    copies: int
    first: int
    offset: int
    window: int


def plan(counts: dict[int, int], capacity: int = CAPACITY, windows: list[int] | None = None) -> tuple[list[Slot], int]:
    """The slots of all sizes and the number of containers; ``windows`` are the tiers' lengths, each a divisor of the next, the capacity last.

    A pattern is repeated as often as the counts allow, so each one uses up a size or routes it on: there are at most twice as many patterns as
    sizes, whatever the number of texts.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("sizes must be between 1 and the capacity")
    windows = windows or windows_of(capacity)
    used = dict.fromkeys(left, 0)
    slots: list[Slot] = []
    at = 0  # where the next window begins, counted over all containers

    def put(pattern: list[tuple[int, int]], uses: int, container: int, offset: int, window: int) -> None:
        for size, copies in pattern:
            slots.append(Slot(size, used[size], uses, copies, container, offset, window))
            used[size] += uses * copies
            left[size] -= uses * copies
            offset += size * copies

    def fill(top: int, room: int) -> list[tuple[int, int]]:
        """The longest sizes that fit, from ``top`` down."""
        sizes = sorted(s for s in left if left[s])
        pattern = []
        k = bisect.bisect_right(sizes, top) - 1
        while k >= 0 and room >= sizes[0]:
            k = min(k, bisect.bisect_right(sizes, room) - 1)
            copies = min(room // sizes[k], left[sizes[k]]) if k >= 0 else 0
            if copies:
                pattern.append((sizes[k], copies))
                room -= copies * sizes[k]
            k -= 1
        return pattern

    def use(pattern: list[tuple[int, int]], window: int) -> None:
        nonlocal at
        uses, beside = min(left[s] // c for s, c in pattern), capacity // window
        while uses:
            container, offset = divmod(at, capacity)
            if offset or uses < beside:  # a container begun or left unfinished
                put(pattern, 1, container, offset, window)
                at += window
                uses -= 1
            else:
                whole = uses // beside
                for k in range(beside):
                    put(pattern, whole, container, k * window, window)
                at += whole * capacity
                uses -= whole * beside

    routed_on: dict[int, int] = {}
    for k in range(len(windows) - 1, -1, -1):
        window, shorter = windows[k], windows[k - 1] if k else 0
        for size in sorted((s for s in left if shorter < s <= window), reverse=True):
            while left[size]:
                pattern = fill(size, window)
                if window < capacity and sum(s * c for s, c in pattern) < LEAST_FILL * window:
                    routed_on[size], left[size] = left[size], 0
                else:
                    use(pattern, window)
    left.update(routed_on)
    at = -(-at // capacity) * capacity
    while any(left.values()):
        use(fill(capacity, capacity), capacity)
    return slots, -(-at // capacity)


def pieces(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, start, size)``: one piece for each text within the capacity, full pieces and a rest for longer ones.

    Texts of no tokens (null or empty) have no piece.
    """
    n = F.ceil(F.col(size) / capacity).cast("int")
    each = sizes.filter(F.col(size) > 0).select(key, size, F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece") * capacity
    return each.select(key, "piece", start.alias("start"), F.least(F.lit(capacity), F.col(size) - start).cast("int").alias("size"))


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """``(key, piece, start, size, window, container, offset, step_group)`` of every piece.

    ``key`` must be unique. Every text of at least one token lies in exactly one container, from ``offset`` on; one longer than ``capacity``
    lies in several, from its token ``start`` on. ``window`` is the length of the window it lies in. Null or zero sizes have no row; ties in
    size are ranked by ``key``; an empty table gives no rows; other columns of ``sizes`` are not read. A step group is about ``step`` containers;
    containers of like content are dealt out to the groups there and back, which balances texts, tokens and windows between them.
    """
    spark = sizes.sparkSession
    parts = cut(pieces(sizes, key, size, capacity))
    counts = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots, containers = plan(counts, capacity)
    groups = max(1, -(-containers // step))
    buckets = max(1, sum(counts.values()) // RANKED)
    bucket = F.pmod(F.xxhash64(key, "piece"), F.lit(buckets))
    parts = parts.withColumn("_bucket", bucket)
    before = Window.partitionBy("size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.groupBy("size", "_bucket").agg(F.count("*").alias("_n"))
    ahead = ahead.select("size", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("size", "_bucket").orderBy(key, "piece")) - 1
    ranked = parts.withColumn("_rank", rank).join(ahead, ["size", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    schema = "size int, rank long, uses long, copies long, first long, offset int, window int"
    table = spark.createDataFrame([(s.size, s.rank, s.uses, s.copies, s.first, s.offset, s.window) for s in slots], schema)
    at = F.col("_rank") - F.col("rank")
    # the plan has no more rows than patterns times sizes in them, whatever the number of texts
    placed = ranked.join(F.broadcast(table), "size").filter((at >= 0) & (at < F.col("uses") * F.col("copies")))
    container = F.col("first") + F.pmod(at, F.col("uses"))
    offset = F.col("offset") + F.floor(at / F.col("uses")).cast("int") * F.col("size")
    turn = F.pmod(container, F.lit(groups))
    group = F.when(F.floor(container / groups) % 2 == 0, turn).otherwise(groups - 1 - turn)
    return placed.select(
        key, "piece", "start", "size", "window", container.alias("container"), offset.cast("int").alias("offset"), group.alias("step_group")
    )


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, containers, tokens, the share of the containers that is filled, and the fewest and most tokens of a step group."""
    each = packed.groupBy("step_group", "container").agg(F.sum("size").alias("filled"), F.count("*").alias("n"))
    groups = each.groupBy("step_group").agg(F.sum("n").alias("n"), F.count("*").alias("m"), F.sum("filled").alias("filled"))
    total = groups.agg(F.sum("n").alias("pieces"), F.sum("m").alias("containers"), F.sum("filled").alias("tokens"), F.min("filled").alias("least_group_tokens"), F.max("filled").alias("most_group_tokens"))
    return total.withColumn("share", F.col("tokens") / (F.col("containers") * capacity))
