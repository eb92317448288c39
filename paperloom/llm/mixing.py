"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). The token budget flows from the root: every node splits its budget among its
children in proportion to their weights, none takes more than its subtree can supply, and what a child cannot take goes
to its siblings in proportion to their weights. Only what a whole subtree cannot supply reaches the siblings of an
ancestor. With capacities ``c`` and weights ``w`` the split is ``min(c, level * w)``; ``level`` comes in closed form
from running sums over children ordered by ``c / w``, so each level of the tree is one window over the small tree table.

A leaf then gives a token-prefix of its seeded epochs: epoch e orders its rows by md5 of seed, epoch and key, epochs
follow one another, and rows are taken while the running total stays inside the leaf's budget. The running total is
taken over hash buckets first and over rows only in the bucket where the budget ends, so that a source with a third of
all rows isn't sorted in one task.

Cases: null domain, language or source form groups of their own under the name ``?``; null or blank text has 0 tokens and
costs nothing (kept while its position is inside the prefix); nodes without a weight get ``default_weight``; weight 0 gives
nothing; repeated rows are told apart by nothing and taken or left together; an empty table gives no rows; further columns
stay, and those named like a result (``domain``, ``epoch``, ``n_tokens``) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import scratch, written

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Plan:
    """``weights``: (level, name) to weight. ``share``: budget as a part of all tokens (1.0: as many as there are)."""

    share: float = 0.8
    max_epochs: int = 2
    seed: int = 17
    weights: dict[tuple[str, str], float] = field(default_factory=dict)
    default_weight: float = 1.0
    bucket_hex: int = 3

    def weight_of(self, level: str, name: Column) -> Column:
        known = {n: w for (lv, n), w in self.weights.items() if lv == level}
        out = F.lit(float(self.default_weight))
        for n, w in known.items():
            out = F.when(name == n, F.lit(float(w))).otherwise(out)
        return out


#: The tree table is broadcast up to so many leaves and joined by shuffling beyond them.
BROADCAST_LEAVES = 100_000


def small(leaves: DataFrame):
    """A hint for tables of as many rows as the tree has leaves, or fewer."""
    return F.broadcast if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else lambda df: df


def token_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def split_level(children: DataFrame, keys: list[str], plan: Plan) -> DataFrame:
    """Budgets of one level's nodes. ``children``: keys, capacity and ``_budget``, what their parent has to give."""
    level, up = keys[-1], keys[:-1]
    part = f"PARTITION BY {', '.join(up)}" if up else "PARTITION BY 1"
    c = children.withColumn("_w", plan.weight_of(level, F.col(level))).where("_w > 0").withColumn("_fill", F.col("capacity") / F.col("_w"))
    c = c.selectExpr(
        "*",
        f"coalesce(sum(capacity) OVER ({part} ORDER BY _fill, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
        f"sum(_w) OVER ({part} ORDER BY _fill, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _open",
    )
    # The level if all children of lower fill are full. The first child whose fill is above it isn't full, and sets the
    # level for itself and all after it.
    c = c.withColumn("_level", (F.col("_budget") - F.col("_before")) / F.col("_open"))
    c = c.selectExpr("*", f"min_by(_level, CASE WHEN _fill > _level THEN struct(_fill, {level}) END) OVER ({part}) AS _cut")
    capacity = F.col("capacity").cast("double")
    grant = F.when(F.col("_cut").isNull(), capacity).otherwise(F.least(capacity, F.col("_cut") * F.col("_w")))
    return c.select(*keys, F.greatest(F.lit(0.0), grant).alias("budget"))


def budgets(leaves: DataFrame, plan: Plan, few=F.broadcast) -> DataFrame:
    """One row for each leaf of weight over 0 with its budget in whole tokens. ``leaves``: the levels' columns and ``tokens``."""
    got = None
    for i in range(1, len(LEVELS) + 1):
        keys = list(LEVELS[:i])
        level = leaves.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * plan.max_epochs)
        if got is None:
            level = level.selectExpr("*", f"{plan.share!r}D * sum(tokens) OVER (PARTITION BY 1) AS _budget")
        else:
            level = level.join(few(got.withColumnRenamed("budget", "_budget")), keys[:-1])
        got = split_level(level, keys, plan)
    return got.withColumn("budget", F.floor("budget"))


def cuts(slim: DataFrame, plan: Plan) -> DataFrame:
    """For each leaf the epochs it gives whole and where the last one ends: rows of buckets before ``_edge`` are inside
    (all rows where it is null), and rows of that bucket up to the order ``_last``. ``slim``: _key, the levels, n_tokens."""
    keys, part = list(LEVELS), f"PARTITION BY {', '.join(LEVELS)}"
    leaves = written(slim.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    few = small(leaves)
    tree = budgets(leaves, plan, few).join(few(leaves), keys).where("tokens > 0")
    tree = tree.withColumn("_whole", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    tree = written(tree.withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("tokens")), "mix-tree")
    docs = ordered(slim.join(few(tree.where("_rest > 0")), keys), plan, "_key")
    sums = docs.groupBy(*keys, "_bucket", "_rest").agg(F.sum("n_tokens").alias("_t"))
    before = sums.selectExpr("*", f"sum(_t) OVER ({part} ORDER BY _bucket) - _t AS _before")
    edge = before.where("_before + _t > _rest").groupBy(*keys).agg(
        F.min("_bucket").alias("_edge"), F.min_by("_before", "_bucket").alias("_before")
    )
    edge = written(edge, "mix-edge")
    last = docs.join(few(edge.withColumnRenamed("_edge", "_bucket")), [*keys, "_bucket"]).selectExpr(
        *keys, "_order", "_rest", f"_before + sum(n_tokens) OVER ({part} ORDER BY _order) AS _upto"
    )
    last = last.where("_upto <= _rest").groupBy(*keys).agg(F.max("_order").alias("_last"))
    out = tree.join(few(edge.drop("_before")), keys, "left").join(few(last), keys, "left")
    return written(out.select(*keys, "budget", "_whole", "_rest", "_edge", "_last"), "mix-cuts", lasting=True)


def ordered(df: DataFrame, plan: Plan, key: str) -> DataFrame:
    """Adds the row's place in the leaf's last epoch, and the bucket that this place falls into."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("?"))
    df = df.withColumn("_order", F.md5(F.concat(F.lit(f"{plan.seed}:"), F.col("_whole").cast("string"), F.lit(":"), name)))
    return df.withColumn("_bucket", F.substring("_order", 1, plan.bucket_hex))


def mix(df: DataFrame, plan: Plan, domain: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows chosen, once for each epoch that takes them, with ``domain``, ``n_tokens`` and ``epoch`` (from 0).

    Two scans and no shuffle of texts: the first scan writes keys and token counts, from which the leaves' cuts come;
    the second compares each row's own place with the broadcast cut of its leaf.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(f"_{c}") for c in LEVELS[1:]]
    rows = df.drop("domain", "n_tokens", "epoch").select(
        "*", domain.cast("string").alias("domain"), token_count(F.col(text)).alias("n_tokens"), *named
    ).withColumn("_domain", F.coalesce("domain", F.lit("?")))
    with scratch(df.sparkSession):
        slim = written(rows.select(F.col(key).alias("_key"), *[F.col(f"_{c}").alias(c) for c in LEVELS], "n_tokens"), "mix-slim")
        tree = cuts(slim, plan).select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "_whole", "_rest", "_edge", "_last")
    got = ordered(rows.join(small(tree)(tree), [f"_{c}" for c in LEVELS]), plan, key)
    partial = (F.col("_rest") > 0) & (
        F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge")) | ((F.col("_bucket") == F.col("_edge")) & (F.col("_order") <= F.col("_last")))
    )
    times = F.col("_whole") + F.when(partial, 1).otherwise(0)
    got = got.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    return got.drop("_whole", "_rest", "_edge", "_last", "_order", "_bucket", *[f"_{c}" for c in LEVELS])
