"""Mixing sources to target weights by hierarchical budgets and seeded token prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise

MAX_LEAVES = 100_000
PREFIX = 3  # hexadecimal digits of the order that name a bucket: 4,096 buckets an epoch and leaf


def share(budget: int, capacity: Mapping[str, int], weight: Mapping[str, int]) -> dict[str, int]:
    """``budget`` over siblings in proportion to ``weight``, none above its ``capacity``.

    What a sibling can't take goes to the others by their weights: in the order of capacity over weight, a sibling is full
    when its capacity is at most its share of what is left.  Shares of those with room are rounded down.
    """
    out = {k: 0 for k in capacity}
    order = sorted((k for k in capacity if weight[k] > 0), key=lambda k: (capacity[k] / weight[k], k))
    left, total = budget, sum(weight[k] for k in order)
    while order and capacity[order[0]] * total <= left * weight[order[0]]:
        k = order.pop(0)
        out[k] = capacity[k]
        left, total = left - capacity[k], total - weight[k]
    for k in order:
        out[k] = left * weight[k] // total
    return out


def allocate(budget: int, capacity: Mapping[tuple[str, ...], int], weights: Sequence[Mapping[str, int]]) -> dict[tuple[str, ...], int]:
    """Tokens of each leaf of a tree whose levels have ``weights`` by name (``"*"``: any other name; without it, 0).

    A node's capacity is that of the leaves below it, so a leaf's shortage is made up by its siblings while these have
    room, and only then by its parent's siblings.
    """
    if not weights:
        return {(): min(budget, capacity.get((), 0))}
    names = sorted({path[0] for path in capacity})
    below = {n: {p[1:]: c for p, c in capacity.items() if p[0] == n} for n in names}
    weight = {n: weights[0].get(n, weights[0].get("*", 0)) for n in names}
    got = share(budget, {n: _reach(below[n], weights[1:]) for n in names}, weight)
    return {(n, *p): v for n in names for p, v in allocate(got[n], below[n], weights[1:]).items()}


def _reach(capacity: Mapping[tuple[str, ...], int], weights: Sequence[Mapping[str, int]]) -> int:
    """What the leaves of weights above 0 can take."""
    return sum(c for p, c in capacity.items() if all(w.get(n, w.get("*", 0)) > 0 for n, w in zip(p, weights)))


def mix(
    docs: DataFrame, levels: Sequence[Column], weights: Sequence[Mapping[str, int]], tokens: Column, budget: int | float,
    epochs: int = 1, seed: int = 0, id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with the columns ``epoch`` and ``n_tokens``: for each leaf of the tree a prefix of its tokens.

    ``levels`` name the path of a document from the root (null: the empty name), ``weights`` give whole-number weights of
    the names of each level.  ``budget``: tokens in all, or, where a float, a share of all tokens there are.  A leaf can be
    repeated for ``epochs`` epochs; ``allocate`` propagates the budget and moves shortages.  In epoch ``e`` a leaf's documents
    are in the order of ``md5(seed:e:id)``, then id; whole epochs are taken first, then the longest prefix of the next one
    that the budget covers, in whole documents.

    Sums per (leaf, epoch, bucket of the order) find each leaf's boundary bucket; only documents in it are sorted, so a leaf
    with any share of the rows is spread.  There may be at most ``MAX_LEAVES`` leaves (ValueError otherwise): only their
    totals reach the driver, and their plan is broadcast.

    A null or empty text has whatever ``tokens`` says, null counting 0; documents of 0 tokens come with the prefix they lie
    in.  A null id is ordered as the text "null".  Rows that repeat an id are ordered by their token count and each counts.
    Columns ``epoch`` and ``n_tokens`` of ``docs`` are replaced.
    """
    names = [f"__l{i}" for i in range(len(levels))]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col("id")))
    # The document itself travels as one struct, so that no name of its columns can clash with those used here.
    base = docs.select(
        F.struct(*(docs[c] for c in docs.columns if c not in ("epoch", "n_tokens"))).alias("row"), key.alias("id"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(levels, names)),
    )
    every = base.select(*names, "n_tokens", "id", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    sums = materialise(every.groupBy(*names, "epoch", F.substring(order, 1, PREFIX).alias("bucket")).agg(F.sum("n_tokens").alias("n")))
    leaves = sums.filter("epoch = 0").groupBy(*names).agg(F.sum("n").alias("n"))
    if leaves.limit(MAX_LEAVES + 1).count() > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves: name the levels more coarsely")
    size = {tuple(r[:-1]): r[-1] for r in leaves.collect()}
    budget = int(budget * sum(size.values())) if isinstance(budget, float) else budget
    got = allocate(budget, {p: n * epochs for p, n in size.items()}, weights)
    spark = docs.sparkSession
    schema = ", ".join(f"{n} string" for n in names) + ", full int, rest long"
    plan = spark.createDataFrame([(*p, got[p] // n if n else 0, got[p] % n if n else 0) for p, n in size.items()], schema)

    # The bucket in which the prefix of each leaf ends, and the tokens left for it: one row a leaf.
    run = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partly = sums.join(F.broadcast(plan), names).filter("epoch = full and rest > 0").withColumn("sum", F.sum("n").over(run))
    ends = partly.filter("sum > rest").groupBy(*names).agg(F.min(F.struct("bucket", (F.col("rest") - F.col("sum") + F.col("n")).alias("left"))).alias("end"))
    plan = materialise(plan.join(ends, names, "left").select(*names, "full", "rest", "end.bucket", "end.left"))

    planned = base.join(F.broadcast(plan), names)
    whole = planned.filter("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    part = planned.filter("rest > 0").withColumn("epoch", F.col("full")).withColumn("order", order)
    at = F.substring("order", 1, PREFIX)
    number = F.col("row").getField(id_col)
    inside = Window.partitionBy(*names, "bucket").orderBy("order", number, "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = part.filter(F.col("bucket").isNull() | (at < F.col("bucket")))
    border = part.filter(at == F.col("bucket")).withColumn("sum", F.sum("n_tokens").over(inside)).filter(F.col("sum") <= F.col("left"))
    keep = ["row.*", "epoch", "n_tokens"]
    return whole.select(keep).unionByName(before.select(keep)).unionByName(border.select(keep))
