"""Mixing sources to target weights (operator 5): Pfair scheduling of the sources' blocks.

A source's documents, in a hashed order, form blocks. With a weight of c/D, a source's i-th block is released at slot
floor((i-1) D/c) and due before slot ceil(i D/c); each slot goes to the released block with the earliest deadline. Then
after any number t of slots a source has had less than one block more or less than t c/D. The pattern repeats every D
slots, so one period, worked out on the driver, places every block, and rows find their slots without exchanging anything.
Once a source has run out, the others' weights are scaled up and a new pattern begins: no row is dropped or repeated.
Of very many sources the largest are scheduled one by one; the others share one place in the schedule, with their weights
together, and follow each other there by deadline.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.llm.common import packed, shuffle_partitions, stored

#: Weights are rounded to this part (at least one for each source), and are reported so.
PARTS = 10_000
BLOCK = 64
#: Places in the schedule, at most: of more sources, those of the least weights share one. The driver's tables have PLACES * PARTS numbers at most.
PLACES = 256
#: Names of places: a source's, and that which sources share.
ALONE, SHARED = "=", "+"


def shares(weights: dict[str, float], parts: int = PARTS) -> dict[str, int]:
    """Weights as whole shares (at least 1 each) of their sum, parts or a divisor of it, by largest remainders."""
    total = sum(weights.values())
    exact = {s: w / total * parts for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    rest = parts - sum(out.values())
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for k in range(rest):
        out[order[k % len(order)]] += 1
    for _ in range(-rest):  # tiny weights were raised to 1: the largest give way
        out[max(out, key=lambda s: (out[s], s))] -= 1
    common = math.gcd(*out.values())
    return {s: c // common for s, c in out.items()}


def period(share: dict[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source's blocks in one period, earliest deadline first among those released."""
    size = sum(share.values())
    out: dict[str, list[int]] = {s: [] for s in share}
    waiting = [(0, -(-size // c), s) for s, c in sorted(share.items())]  # release, deadline, source
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for slot in range(size):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s))
        deadline, s = heapq.heappop(ready)
        out[s].append(slot)
        i, c = len(out[s]) + 1, share[s]
        if i <= c:
            heapq.heappush(waiting, ((i - 1) * size // c, -(-i * size // c), s))
    return {s: np.array(x, np.int64) for s, x in out.items()}


class Phase(NamedTuple):
    """A source's blocks from first on, n of them, in one pattern: at base + (k // share) * size + slots[k % share]."""

    first: int
    n: int
    base: int
    size: int
    slots: np.ndarray


def schedule(blocks: dict[str, int], weights: dict[str, float], parts: int = PARTS) -> dict[str, list[Phase]]:
    """Each source's phases; sources without a positive weight come after all others, in equal shares."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out: dict[str, list[Phase]] = {s: [] for s in left}
    base = 0
    while left:
        own = {s: weights.get(s, 0.0) for s in left if weights.get(s, 0.0) > 0} or dict.fromkeys(left, 1.0)
        share = shares(own, max(parts, len(own)))
        size, pattern = sum(share.values()), period(share)
        # the slot of each source's last block: the earliest of them ends the phase
        length = min((left[s] - 1) // share[s] * size + int(pattern[s][(left[s] - 1) % share[s]]) for s in own) + 1
        for s in own:
            n = length // size * share[s] + int(np.searchsorted(pattern[s], length % size))
            out[s].append(Phase(done[s], n, base, size, pattern[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        base += length
    return out


def numbered(rows: DataFrame, by: list[str], order: str, ties: list[str], counts: DataFrame) -> DataFrame:
    """rows with _k, their number (from 0) by the columns `order` (ranges of rows that follow each other) and ties.

    counts: by, order and _n, the number of rows. Counts are summed up and rows numbered within their range: no group of
    rows is brought together but one of a range.
    """
    window = Window.partitionBy(*by).orderBy(order)
    before = counts.select(*by, order, (F.sum("_n").over(window) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, order).orderBy(*ties))
    return rows.withColumn("_k", within).join(before, [*by, order]).withColumn("_k", F.col("_before") + F.col("_k") - 1).drop("_before")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block: int = BLOCK, parts: int = PARTS, source: str = "source") -> DataFrame:
    """The rows of docs with block (of its source), slot, place (in the block), mix_order and weight.

    mix_order (slot * block + place) is the order of the mixture. weights are relative; without them a source weighs its
    number of rows to the given power. Every row comes once: when a source has run out the others' weights are scaled up.
    Within a source the order is that of a hash of the doc_id and text. A null source is one of its own, named "" in
    weights; rows without a doc_id are ordered by their text; repeated rows take places beside each other; an empty table
    gives no rows. Columns of the five names give way.

    Any number of sources is mixed: of more than PLACES, those beyond the PLACES - 1 of the largest weights share one place
    of the schedule, whose blocks (block counts these) hold their rows by deadline, number / weight. The deviation of
    less than one block then holds for the place as a whole.
    """
    new = ("block", "slot", "place", "mix_order", "weight")
    names = [c for c in docs.columns if c not in new]
    _, rows = packed(docs.select(*[docs[c] for c in names]))
    ranges = 1 << max(1, 4 * shuffle_partitions(docs.sparkSession) - 1).bit_length()
    one = rows.select("row", F.coalesce(F.col(f"row.`{source}`").cast("string"), F.lit("")).alias("_source"), F.xxhash64("row.doc_id", "row.text").alias("_hash"), F.hash("row.doc_id", "row.text").alias("_tie"))
    one = one.withColumn("_range", F.shiftrightunsigned("_hash", 65 - ranges.bit_length()))
    counts = stored(one.groupBy("_source", "_range").agg(F.count("*").alias("_n")))
    sized = counts.groupBy("_source").agg(F.sum("_n").alias("_rows"))
    if weights is None:
        weighed = sized.withColumn("_weight", F.pow(F.col("_rows").cast("double"), F.lit(float(power))))
    else:
        given = docs.sparkSession.createDataFrame([(str(s), float(w)) for s, w in weights.items()], "_source string, _weight double")
        weighed = sized.join(given, "_source", "left").withColumn("_weight", F.greatest(F.coalesce("_weight", F.lit(0.0)), F.lit(0.0)))
    weighed = stored(weighed)
    alone = [tuple(r) for r in weighed.orderBy(F.desc("_weight"), "_source").limit(PLACES + 1).select("_source", "_rows", "_weight").collect()]
    keyed = numbered(one, ["_source"], "_range", ["_hash", "_tie"], counts)  # beyond that rows are alike
    lines, pooled = keyed.withColumn("_line", F.concat(F.lit(ALONE), "_source")).withColumn("_part", F.lit(1.0)), None
    if len(alone) > PLACES:
        alone = alone[: PLACES - 1]
        rest = weighed.where(~F.col("_source").isin([s for s, _, _ in alone]))
        n_rest, w_rest = rest.agg(F.sum("_rows"), F.sum("_weight")).first()
        pooled = (SHARED, n_rest, w_rest)
        lines = lines.where(F.col("_source").isin([s for s, _, _ in alone])).unionByName(shared_line(keyed, rest, ranges, w_rest))
    sizes = {ALONE + s: (n, w) for s, n, w in alone} | ({SHARED: pooled[1:]} if pooled else {})
    plan = schedule({s: -(-n // block) for s, (n, _) in sizes.items()}, {s: w for s, (_, w) in sizes.items()}, parts)

    def look_up(sources: pd.Series, blocks: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        slots, share = np.zeros(len(sources), np.int64), np.zeros(len(sources))
        k = blocks.to_numpy()
        for s in sources.unique():
            mine = (sources == s).to_numpy()
            for p in plan[s]:
                at = np.flatnonzero(mine & (k >= p.first) & (k < p.first + p.n))
                local = k[at] - p.first
                slots[at] = p.base + local // len(p.slots) * p.size + p.slots[local % len(p.slots)]
                share[at] = len(p.slots) / p.size
        return slots, share

    @F.pandas_udf("slot long, weight double")
    def placed(sources: pd.Series, blocks: pd.Series) -> pd.DataFrame:
        slots, share = look_up(sources, blocks)
        return pd.DataFrame({"slot": slots, "weight": share})

    found = lines.select("row", "_part", F.expr(f"_k div {block}").alias("block"), (F.col("_k") % block).alias("place"), placed("_line", F.expr(f"_k div {block}")).alias("_at"))
    return found.select("row.*", "block", F.col("_at.slot").alias("slot"), "place", (F.col("_at.slot") * block + F.col("place")).alias("mix_order"), (F.col("_at.weight") * F.col("_part")).alias("weight"))


def shared_line(keyed: DataFrame, rest: DataFrame, ranges: int, weight: float) -> DataFrame:
    """The rows of the sources in rest, numbered together by deadline; those without a weight come last. _part is a source's part of the weight.

    A row's deadline lies at a place of its own (by its hash) within its source's period, so that no deadline is common to many rows.
    """
    own = keyed.join(rest.drop("_rows"), "_source")
    within = F.shiftrightunsigned("_hash", 11) / F.lit(float(1 << 53))
    due = own.withColumn("_due", (F.col("_k") + within) / F.greatest("_weight", F.lit(1e-30)))
    bounds = np.unique(np.array(due.agg(F.percentile_approx("_due", [(k + 1) / ranges for k in range(ranges)], 20 * ranges)).first()[0] or [], float))

    @F.pandas_udf("long")
    def range_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values.to_numpy(float), side="left"))

    ranged = due.withColumn("_range", range_of("_due"))
    counts = stored(ranged.groupBy("_range").agg(F.count("*").alias("_n")))
    again = numbered(ranged.drop("_k"), [], "_range", ["_due", "_hash", "_tie"], counts)
    return again.select("row", "_source", "_hash", "_tie", "_range", "_k", F.lit(SHARED).alias("_line"), (F.col("_weight") / weight if weight else F.lit(1.0)).alias("_part"))
