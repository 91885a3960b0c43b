"""Mixing sources to target weights: a subset of documents whose sizes fill a budget.

Targets share out all words by weight; none may exceed ``MAX_REPEATS`` times its source.
A source takes all its documents as often as they fit its target, and then some of them
once more, chosen so that their words fill the rest of the budget:

1. count the source's documents by exact length (combined before the shuffle);
2. take the same part of every length, rounded down;
3. fill up with single documents in a seeded order of the lengths until the rest is small;
4. where documents are long, the last long ones of these (all of them, if they are few) are
   given back and chosen anew: bounded-knapsack dynamic programming finds the reachable sum
   nearest to the rest. Reachable sums are the bits of one integer; sums too large for it are
   counted in their common divisor or in larger units;
5. the same, word by word, over the documents of each length that are left brings the sum
   to the rest, or back to it if it is exceeded.

How many documents of a length are taken is thus a number; which, a seeded hash decides.
Hash cells are counted per length, so that only the cell at the border has to be ranked:
no length, source or group of copies is sorted in one task.
"""

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.store import Scratch, only, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 17
# The programme covers rests up to this many units.
REACH = 1 << 16
# Long documents that are given back: all if there are no more than so many, else the last so many.
FEW = 64
_CELLS = 4096
# Ids whose rows get different numbers of copies: so many are picked by a broadcast set, more by the join alone.
BROADCAST_IDS = 1_000_000


def word_count(text: str = "text") -> Column:
    """Number of runs of bytes other than blank, tab, line feed and the like."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets_of(totals: Sequence[int], weights: Sequence[float], most: float = MAX_REPEATS) -> list[float]:
    """Shares of the sum by weight; what exceeds ``most`` times a total is shared anew."""
    out = [0.0] * len(totals)
    open_ = list(range(len(totals)))
    rest = float(sum(totals))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * totals[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * totals[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
        if rest <= 0:
            break
    return out


def knapsack(lengths: Sequence[int], counts: Sequence[int], goal: int) -> list[int]:
    """How many items of each length, for the sum nearest to ``goal`` (the smaller one if tied)."""
    width = (1 << (2 * goal + 1)) - 1
    steps = [1]  # bit s: sum s can be reached with the lengths so far
    parts = []  # (index, items taken at once)
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count, size = min(count, 2 * goal // length if length else 0), 1
        while count > 0:
            size = min(size, count)
            parts.append((i, size))
            steps.append((steps[-1] | (steps[-1] << (size * length))) & width)
            count -= size
            size *= 2
    best = next(
        s for d in range(goal + 1) for s in (goal - d, goal + d) if (steps[-1] >> s) & 1
    )
    taken = [0] * len(lengths)
    for k in range(len(parts), 0, -1):
        if not (steps[k - 1] >> best) & 1:
            i, size = parts[k - 1]
            taken[i] += size
            best -= size * lengths[i]
    return taken


def nearest(lengths: Sequence[int], counts: Sequence[int], goal: int) -> list[int]:
    """As :func:`knapsack` for goals of any size: exact up to ``REACH`` common divisors, else in larger units."""
    if not lengths or goal <= 0:
        return [0] * len(lengths)
    divisor = math.gcd(*lengths)
    unit = divisor * max(1, -(-goal // (divisor * REACH)))
    return knapsack([max(1, round(n / unit)) for n in lengths], counts, max(1, round(goal / unit)))


def fill_budget(lengths: Sequence[int], counts: Sequence[int], budget: int, order: Sequence[int]) -> list[int]:
    """How many documents of each length together have about ``budget`` words.

    ``order`` ranks the lengths where single documents are added.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]

    def rest() -> int:
        return budget - sum(n * t for n, t in zip(lengths, taken, strict=True))

    ranked = sorted(range(len(lengths)), key=lambda i: order[i])
    open_, added = rest(), []
    for i in ranked:
        # one more of this length, while the rest stays out of the programme's reach
        if open_ - lengths[i] >= REACH // 4 and taken[i] < counts[i] and lengths[i]:
            taken[i] += 1
            open_ -= lengths[i]
            added.append(i)

    def change(some: Sequence[int], goal: int, sign: int) -> None:
        """Take more of some lengths, or fewer, for about ``goal`` words."""
        room = {i: counts[i] - taken[i] if sign > 0 else taken[i] for i in some}
        some = [i for i in some if room[i] and 0 < lengths[i] <= 2 * goal]
        for i, t in zip(some, nearest([lengths[i] for i in some], [room[i] for i in some], goal), strict=True):
            taken[i] += sign * t

    long = [i for i in ranked if lengths[i] > REACH // 4]
    if long:
        if sum(counts[i] for i in long) <= FEW:
            for i in long:
                taken[i] = 0
        else:
            for i in [i for i in added if i in set(long)][-FEW:]:
                taken[i] -= 1
        if rest() > 0:
            change(long, rest(), 1)
    for _ in range(3):
        missing, so_far = rest(), list(taken)
        change(ranked, abs(missing), 1 if missing > 0 else -1)
        if abs(rest()) >= abs(missing):
            return so_far
    return taken


def _source_targets(sized: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """One row per source, by code point, null last: ``source, source_size, target``."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [r["source_size"] for r in totals]
    shares = targets_of(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    rows = [(r["source"], n, t) for r, n, t in zip(totals, sizes, shares, strict=True)]
    return sized.sparkSession.createDataFrame(rows, "source string, source_size long, target double")


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, repeats`` of every row.

    ``size`` counts the words of the text (null: 0), ``taken`` is size times ``repeats``. A
    null source is a source of its own. Texts without words are taken as often as their
    whole source. The choice is a function of the seed and the ids, so reruns agree; rows
    that share an id and a size are alike, and it does not matter which of them is taken.
    One number per source passes through the driver. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = only(docs, list(dict.fromkeys([id_col, text_col, source_col]))).select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text_col).alias("size"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string")), F.lit(1 << 40)).alias("place"),
    )
    sized = scratch.table(sized.withColumn("cell", F.col("place") % _CELLS), "sized")
    targets = _source_targets(sized, weights, most)
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("n"))

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        base = min(int(target // total), most) if total else 0
        budget = 0 if base >= most else round(target - base * total)
        sizes, counts = rows["size"].tolist(), rows["n"].tolist()
        order = [hash((seed, s)) for s in sizes]
        extra = fill_budget(sizes, counts, budget, order) if budget > 0 else [0] * len(sizes)
        return pd.DataFrame(
            {"source": rows["source"], "size": rows["size"], "source_size": total, "target": target, "base": base, "extra": extra}
        )

    # a source has as many rows as it has different lengths, however many documents
    same = F.col("source").eqNullSafe(F.col("t_source"))
    counted = lengths.join(
        targets.withColumnRenamed("source", "t_source"), same
    ).drop("t_source")
    plans = counted.groupBy("source").applyInPandas(
        plan, "source string, size long, source_size long, target double, base int, extra long"
    )
    plans = scratch.table(plans, "plan")

    # Per length: whole cells that are taken, and how many of the cell at the border.
    cells = sized.groupBy("source", "size", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    p = plans.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target", "base", "extra")
    on = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    choice = scratch.table(
        cells.join(p, on).select(
            F.col("source").alias("c_source"),
            F.col("size").alias("c_size"),
            F.col("cell").alias("c_cell"),
            "source_size",
            "target",
            "base",
            F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n")).alias("some"),
            "n",
        ),
        "choice",
    )
    placed = sized.join(
        choice,
        F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("cell") == F.col("c_cell")),
    )
    placed = scratch.table(placed.drop("c_source", "c_size", "c_cell"), "placed")
    clear = placed.where("some = 0 or some = n").withColumn("more", (F.col("some") > 0).cast("int"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("place", "doc_id"))
    border = placed.where("some > 0 and some < n").withColumn("more", (rank <= F.col("some")).cast("int"))
    return clear.unionByName(border).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("base") + F.col("more"))).alias("taken"),
        (F.col("base") + F.col("more")).cast("int").alias("repeats"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents, all columns: each row as often as the plan takes it."""
    plan = mix_plan(docs, id_col, text_col, source_col, **options)
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text, source = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    rows = inner.withColumn("m_size", word_count(text)).withColumn("m_part", F.spark_partition_id())
    # rows of one id, source and size are alike; their copies are dealt out evenly
    counted = plan.groupBy("doc_id", "source", "size").agg(F.sum("repeats").alias("copies"), F.count("*").alias("rows"))
    counted = counted.where("copies > 0").select(
        F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "copies", "rows"
    )
    counted = Scratch(docs.sparkSession, "mix").table(counted, "copies")
    uneven = counted.where("copies % rows <> 0")
    same = (
        F.col(key).eqNullSafe(F.col("p_id"))
        & F.col(source).cast("string").eqNullSafe(F.col("p_source"))
        & (F.col("m_size") == F.col("p_size"))
    )
    columns = [*inner.columns, "times"]
    even = rows.join(counted.where("copies % rows = 0"), same).withColumn("times", F.expr("int(copies div rows)"))
    times = even.select(*columns)
    if not uneven.isEmpty():
        times = times.unionByName(_uneven(rows, uneven, same, key).select(*columns))
    times = times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return times.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def _uneven(rows: DataFrame, counted: DataFrame, same: Column, key: str) -> DataFrame:
    """Rows of an id whose copies cannot be dealt out evenly, with their ``times``; only their texts are shuffled if they are few."""
    ids = counted.select(F.col("p_id").alias("u_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(ids), F.col(key).eqNullSafe(F.col("u_id")), "left_semi")
    odd = rows.join(counted, same)
    # The first of such rows get one copy more; they are numbered within the parts of the table as it was read.
    alike = ["p_id", "p_source", "p_size"]
    before = Window.partitionBy(*alike).orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = odd.groupBy(*alike, "m_part").agg(F.count("*").alias("here"))
    parts = parts.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).toDF("q_id", "q_source", "q_size", "q_part", "here", "before")
    within = F.row_number().over(Window.partitionBy(*alike, "m_part").orderBy(key))
    at = [F.col(f"p_{c}").eqNullSafe(F.col(f"q_{c}")) for c in ("id", "source", "size")]
    odd = odd.withColumn("nth", within).join(parts, at[0] & at[1] & at[2] & (F.col("m_part") == F.col("q_part")))
    first = (F.col("before") + F.col("nth") <= F.expr("copies % rows")).cast("int")
    return odd.withColumn("times", (F.expr("copies div rows") + first).cast("int")).where("times > 0")
