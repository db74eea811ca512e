"""Filling containers of fixed capacity with texts, measured in tokens.

The sizes are whole numbers, so the range-sorted texts and the range-sorted gaps of the open containers are both held as
runs: how many texts have a size, how many containers have a gap. The runs are cut into ranges of sizes, each of a number
of runs that one task can sweep, and packed by best fit in bulk-synchronous rounds. In a round every gap is offered to the
range it falls into (or to the largest sizes that are still open below it), and all ranges sweep at once: a range takes its
texts from the largest size down, gives each the smallest gap offered that holds it, resolves by rank which of the texts of
a run go into which containers of a run, and updates the gaps. What a gap has left over is offered further down in the next
round. The range of the largest sizes that are left opens containers for what found no gap and is then done, so there are
as many rounds as ranges. The texts find their containers by their rank within their size, in one sweep over texts and
plan sorted together, which splits a size that very many texts share.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tokens import token_counts
from codeloom.operators.skew import range_scan
from codeloom.session import Scratch

RESULT = "budget_id int, container_id long, doc_id long, piece_no long, token_from long, n_tokens long"
#: Runs of sizes that one task sweeps.
RUNS = 2_000
#: Rows of the rounds. ``kind``: item (a: number of texts, b: rank of the first), gap (a: first container, b: number of
#: containers), opened (a: containers so far) or plan (a: rank of the first text, b: texts per container, c: first container).
STATE = "budget_id int, capacity long, kind string, value long, a long, b long, c long"


class Gaps:
    """Open containers by gap: runs of containers, and the smallest gap that holds a size."""

    def __init__(self, runs: Iterable[tuple[int, int, int]] = ()):
        self.sorted: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}
        for gap, first, number in sorted(runs, key=lambda r: (r[0], -r[1])):
            self.put(gap, first, number)

    def put(self, gap: int, first: int, number: int) -> None:
        if number and gap > 0:
            if gap not in self.runs:
                insort(self.sorted, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, number))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """A run of the smallest gap that is at least ``size``: (gap, first, number)."""
        at = bisect_left(self.sorted, size)
        if at == len(self.sorted):
            return None
        gap = self.sorted[at]
        first, number = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.sorted.pop(at)
        return gap, first, number


def sweep(capacity: int, items: list[tuple[int, int, int]], gaps: Gaps, opened: int | None) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]], int | None]:
    """One range's part in a round: ``items`` (size, number of texts, rank of the first) go into the gaps.

    Returns the plan's rows (size, rank_from, per_container, container_from), the items left, and ``opened``. With a number
    ``opened`` what finds no gap opens containers from that number on; without one it is left. Texts of a size with a rank
    from ``rank_from`` up to the next row's fill containers numbered from ``container_from``, ``per_container`` in each.
    Size 0 takes no room; such texts all join the first container, a new one only if there is none.
    """
    plan, left = [], []
    for size, count, rank in sorted(items, reverse=True):
        if size == 0:
            if opened is None:
                left.append((size, count, rank))
            else:
                plan.append((0, 0, max(1, count), 0))
                opened = max(opened, 1)
            continue
        end = rank + count
        while rank < end:
            run = gaps.take(size)
            if run is not None:
                gap, first, number = run
                each = gap // size
            elif opened is not None:
                gap, each = capacity, capacity // size
                number = -(-(end - rank) // each)
                first, opened = opened, opened + number
            else:
                left.append((size, end - rank, rank))
                break
            full = min(number, (end - rank) // each)
            if full:
                plan.append((size, rank, each, first))
                gaps.put(gap - each * size, first, full)
                rank += full * each
            if full < number:
                rest = end - rank
                if rest:
                    plan.append((size, rank, rest, first + full))
                    gaps.put(gap - rest * size, first + full, 1)
                    rank, full = end, full + 1
                gaps.put(gap, first + full, number - full)
    return plan, left, opened


def _round(group: pd.DataFrame) -> pd.DataFrame:
    budget, capacity = int(group["budget_id"].iat[0]), int(group["capacity"].iat[0])
    rows = {kind: part[["value", "a", "b"]].astype("int64").values.tolist() for kind, part in group.groupby("kind")}
    opened = rows["opened"][0][1] if "opened" in rows else None
    gaps = Gaps(rows.get("gap", ()))
    plan, left, opened = sweep(capacity, rows.get("item", []), gaps, opened)
    out = [("plan", size, a, b, c) for size, a, b, c in plan] + [("item", *r, 0) for r in left]
    out += [("gap", gap, first, number, 0) for gap, runs in gaps.runs.items() for first, number in runs]
    if opened is not None:
        out.append(("opened", 0, opened, 0, 0))
    return pd.DataFrame([(budget, capacity, *r) for r in out], columns=["budget_id", "capacity", "kind", "value", "a", "b", "c"])


def plan_containers(counts: DataFrame, scratch: Scratch, runs: int = RUNS) -> DataFrame:
    """The plan for ``counts`` (``budget_id``, ``capacity``, ``size``, ``n``; sizes up to the capacity, each once): rows
    (``budget_id``, ``size``, ``rank_from``, ``per_container``, ``container_from``), as ``sweep`` returns them."""
    # Ranges: the distinct sizes of a budget are at most its capacity + 1, and are numbered from the largest down.
    sized = range_scan(counts.withColumn("down", -F.col("size")), ["budget_id"], ["down"], scratch)
    sized = sized.withColumn("range", F.floor(F.col("_pos") / runs))
    sized, found = scratch.measured(sized, ranges=F.max("range") + 1)
    ranges = sized.groupBy("budget_id", "range").agg(F.max("size").alias("most"), F.min("size").alias("least"))
    ranges = scratch.save(ranges.groupBy("budget_id").agg(F.array_sort(F.collect_list(F.struct("range", "least"))).alias("ranges")))  # sizes / runs entries
    null = F.lit(0).cast("long")
    items = sized.select("budget_id", "capacity", F.lit("item").alias("kind"), F.col("size").alias("value"), F.col("n").alias("a"), null.alias("b"), null.alias("c"))
    opened = sized.groupBy("budget_id").agg(F.max("capacity").alias("capacity")).select("budget_id", "capacity", F.lit("opened").alias("kind"), null.alias("value"), null.alias("a"), null.alias("b"), null.alias("c"))
    state, plan = items.unionByName(opened), None
    for step in range(found["ranges"]):
        # A gap or item belongs to the first range, of those still open, whose smallest size it holds; gaps below all are full.
        at = F.get(F.filter("ranges", lambda r: (r["range"] >= step) & (r["least"] <= F.col("value"))), 0)["range"]
        placed = state.join(ranges, "budget_id").withColumn("range", F.when(F.col("kind") == "opened", F.lit(step).cast("long")).otherwise(at)).where("range is not null").drop("ranges")
        state = scratch.save(placed.groupBy("budget_id", "range").applyInPandas(_round, STATE))
        made = state.where("kind = 'plan'").select("budget_id", F.col("value").alias("size"), F.col("a").alias("rank_from"), F.col("b").alias("per_container"), F.col("c").alias("container_from"))
        plan = made if plan is None else plan.unionByName(made)
        state = state.where("kind <> 'plan'")
    return plan


def best_fit(capacity: int, sizes: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """The plan for ``sizes`` (size, number of texts) in one sweep: best-fit decreasing."""
    return sweep(capacity, [(size, count, 0) for size, count in sizes], Gaps(), 0)[0]


def pieces(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """What is to be packed for each budget: a text as one piece, or, only if it exceeds the capacity, as full pieces and
    the rest. ``sizes``: ``doc_id``, ``n_tokens``; ``budgets``: ``budget_id``, ``capacity``, put into one row that every
    text meets."""
    every = budgets.groupBy().agg(F.collect_list(F.struct("budget_id", "capacity")).alias("b"))
    each = sizes.join(F.broadcast(every)).withColumn("b", F.explode("b")).select("doc_id", "n_tokens", "b.budget_id", "b.capacity")
    many = F.ceil(F.col("n_tokens") / F.col("capacity")) - 1
    return each.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(many, F.lit(0).cast("long"))))).select(
        "budget_id", "capacity", "doc_id", "piece_no", F.least("capacity", F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).alias("size")
    )


def pack(sizes: DataFrame, budgets: DataFrame, runs: int = RUNS) -> DataFrame:
    """Containers of every budget: ``budget_id``, ``container_id``, ``doc_id``, ``piece_no``, ``token_from``, ``n_tokens``.

    Every row of ``sizes`` (``doc_id``, ``n_tokens``) comes out once per budget, or once per piece if it is longer than
    the capacity; no container holds more than the capacity. A null size counts as 0. Texts of equal size are placed in
    the order of their ids. A budget whose capacity is null or below 1 gets no rows; no texts or no budgets give none.
    Repeated ids are packed each. ``budgets`` is a small table, of any number of rows.
    """
    scratch = Scratch(sizes.sparkSession, "packing")
    budgets = budgets.where("budget_id is not null and capacity >= 1").groupBy(F.col("budget_id").cast("int").alias("budget_id")).agg(F.min("capacity").cast("long").alias("capacity"))
    sizes = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    items, found = scratch.measured(pieces(sizes, budgets), rows=F.count(F.lit(1)))
    if not found["rows"]:
        return sizes.sparkSession.createDataFrame([], RESULT)
    counts = items.groupBy("budget_id", "capacity", "size").agg(F.count("*").alias("n"))  # at most capacity + 1 rows a budget
    plan = plan_containers(counts, scratch, runs)
    ranked = range_scan(items.select("budget_id", "size", "capacity", "doc_id", "piece_no"), ["budget_id", "size"], ["doc_id", "piece_no"], scratch)
    null = F.lit(None).cast("long")
    marked = plan.select("budget_id", "size", null.alias("capacity"), null.alias("doc_id"), null.alias("piece_no"), F.col("rank_from").alias("at"), F.lit(0).alias("is_item"), "rank_from", "per_container", "container_from")
    placed = ranked.select("budget_id", "size", "capacity", "doc_id", "piece_no", F.col("_pos").alias("at"), F.lit(1).alias("is_item"), null.alias("rank_from"), null.alias("per_container"), null.alias("container_from"))
    swept = range_scan(marked.unionByName(placed), ["budget_id", "size"], ["at", "is_item"], scratch, fills=["rank_from", "per_container", "container_from"])
    return swept.where("is_item = 1").select(
        "budget_id",
        (F.col("_last_container_from") + F.floor((F.col("at") - F.col("_last_rank_from")) / F.col("_last_per_container"))).alias("container_id"),
        "doc_id",
        "piece_no",
        (F.col("piece_no") * F.col("capacity")).alias("token_from"),
        F.col("size").alias("n_tokens"),
    )


def pack_documents(documents: DataFrame, budgets: DataFrame, **tokenizer) -> DataFrame:
    """``pack`` for the texts of ``documents``, each as long as its number of tokens."""
    return pack(token_counts(documents, **tokenizer), budgets)


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """How well containers are filled, per budget: ``n_containers``, ``n_tokens``, ``least_containers`` (their number if no
    space were unused, which no packing can go below), and ``unused`` (the share of all space)."""
    capacity = budgets.groupBy("budget_id").agg(F.min("capacity").cast("long").alias("capacity"))
    held = packed.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("budget_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    space = F.col("n_containers") * F.col("capacity")
    return held.join(capacity, "budget_id").select("budget_id", "capacity", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), "n_tokens", "fullest", F.round(1 - F.col("n_tokens") / space, 6).alias("unused"))
