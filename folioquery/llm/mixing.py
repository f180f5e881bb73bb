"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.llm.cluster import materialise
from folioquery.llm.sharding import count_tokens

#: What stands for a null at a level of the tree.
NO_VALUE = "(none)"
LEVELS = ["domain", "lang", "source"]

#: Production weights. Sources are dealt to domains by the number in their name.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def source_domain(source: Column) -> Column:
    """``domainN`` with N the source's number modulo 4; sources without a number are in domain0."""
    number = F.coalesce(F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.concat(F.lit("domain"), (number % 4).cast("string"))


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast("decimal(18,0)")


def fill(nodes: DataFrame, parents: list[str], name: str, budget: Column) -> DataFrame:
    """Divide each parent's ``budget`` among its children; adds ``alloc``.

    ``nodes`` has one row per child with ``weight`` (positive) and ``cap``. A child takes
    its weighted share, or its cap if that is less; what it leaves goes to its
    siblings by weight, until all is placed or all are at their caps. In order
    of cap/weight the children at their cap come first, so running sums find
    the water level without iteration. Integers throughout: the units that
    rounding leaves go to the first open children by name.
    """
    among = W.partitionBy(*parents)
    line = among.orderBy((F.col("cap").cast("double") / F.col("weight").cast("double")), name)
    before = line.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(20,0)")
    step = nodes.select(
        "*",
        F.least(budget, F.sum("cap").over(among)).cast("decimal(20,0)").alias("_b"),
        F.coalesce(F.sum("cap").over(before), zero).cast("decimal(20,0)").alias("_c"),
        (F.sum("weight").over(among) - F.coalesce(F.sum("weight").over(before), zero)).cast("decimal(18,0)").alias("_w"),
    )
    full = F.when(F.col("cap") * F.col("_w") <= F.col("weight") * (F.col("_b") - F.col("_c")).cast("decimal(20,0)"), 1).otherwise(0)
    step = step.withColumn("_f", full)
    step = step.withColumn("_f", F.min("_f").over(line.rowsBetween(W.unboundedPreceding, 0)))
    step = step.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("_f") == 1, F.col("cap"))).over(among), zero).cast("decimal(20,0)").alias("_taken"),
        F.coalesce(F.sum(F.when(F.col("_f") == 0, F.col("weight"))).over(among), zero).cast("decimal(18,0)").alias("_open"),
    )
    share = F.expr("(weight * cast(_b - _taken as decimal(20,0))) div nullif(_open, 0)").cast("decimal(20,0)")
    step = step.withColumn("_a", F.when(F.col("_f") == 1, F.col("cap")).otherwise(share))
    step = step.select(
        "*",
        (F.col("_b") - F.sum("_a").over(among)).alias("_rest"),
        F.row_number().over(W.partitionBy(*parents, "_f").orderBy(name)).alias("_n"),
    )
    extra = F.when((F.col("_f") == 0) & (F.col("_n") <= F.col("_rest")), 1).otherwise(0)
    kept = [c for c in nodes.columns]
    return step.select(*kept, (F.col("_a") + extra).cast("decimal(20,0)").alias("alloc"))


def plan_mix(
    docs: DataFrame,
    *,
    budget_percent: int,
    max_epochs: int = 4,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain: Column | None = None,
    domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
    lang_weights: Mapping[str, int] = LANG_WEIGHTS,
    source_weights: Mapping[str, int] | None = None,
) -> DataFrame:
    """Which document is taken in which epochs so that the mix meets its weights.

    The tree is domain, language, source. Weights (1 where none is given) are
    propagated from the root; the caps (``max_epochs`` times a leaf's tokens) are summed
    from the leaves, so a shortage below a node first goes to siblings there and
    reaches the ancestors' siblings only when the whole node is exhausted. A
    leaf with a budget of f whole epochs and a rest takes all its documents f
    times and, in epoch f, the longest prefix of a seeded order whose tokens fit in the rest.

    The order is that of md5(seed:epoch:id). Its first three hex digits cut
    every leaf into 4096 even buckets, whose sums give each bucket its place (by first digit, then within it), so a
    leaf with a third of all rows is never sorted in one task.

    Returns per (leaf, id): ``domain``, ``lang``, ``source``, ``doc_id``, ``n_tokens`` (words plus one for
    the end), ``leaf_budget`` and ``epochs``, an array that is never empty.

    * null language or source: the node "(none)". Null text: one token.
    * null ids of a leaf, and rows of a leaf that share an id: one unit with the sum of their tokens.
    * empty table: empty result. Other columns of the input are not read.
    """
    source = F.coalesce(F.col(source_col), F.lit(NO_VALUE))
    units = materialise(
        docs.select(
            (source_domain(source) if domain is None else F.coalesce(domain, F.lit(NO_VALUE))).alias("domain"),
            F.coalesce(F.col(lang_col), F.lit(NO_VALUE)).alias("lang"),
            source.alias("source"),
            F.col(id_col).alias("doc_id"),
            (count_tokens(F.col(text_col)) + 1).alias("n_tokens"),
        )
        .groupBy(*LEVELS, "doc_id")
        .agg(F.sum("n_tokens").alias("n_tokens")),
        "mix-units",
    )
    weights = {"domain": domain_weights, "lang": lang_weights, "source": source_weights or {}}
    leaves = units.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = materialise(leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("decimal(20,0)")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    budget = F.lit(int(total) * budget_percent // 100).cast("decimal(20,0)")
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS, 1):
        keys, parents = LEVELS[:depth], LEVELS[: depth - 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").cast("decimal(20,0)").alias("cap"))
        nodes = nodes.withColumn("weight", _weight(F.col(level), weights[level]))
        if above is None:
            above = fill(nodes.withColumn("root", F.lit(0)), ["root"], level, budget).drop("root")
        else:
            given = above.select(*parents, F.col("alloc").alias("given"))
            above = fill(nodes.join(given, parents), parents, level, F.col("given")).drop("given")
        above = above.select(*keys, "alloc")
    plan = above.join(leaves.select(*LEVELS, "tokens"), LEVELS).select(
        *LEVELS,
        F.col("alloc").cast("long").alias("leaf_budget"),
        F.expr("cast(alloc as bigint) div tokens").alias("whole"),
        F.expr("cast(alloc as bigint) % tokens").alias("rest"),
    )
    plan = materialise(plan, "mix-plan")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("whole").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    drawn = units.join(plan, LEVELS).withColumn("h", order).withColumn("bucket", F.substring("h", 1, 3))
    buckets = drawn.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("t")).withColumn("head", F.substring("bucket", 1, 1))
    buckets = materialise(buckets, "mix-buckets")

    def before(by: list[str], order: str) -> Column:
        line = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("t").over(line), F.lit(0))

    # 16 sums of a leaf, then 256 of each: no window is longer.
    heads = buckets.groupBy(*LEVELS, "head").agg(F.sum("t").alias("t")).select(*LEVELS, "head", before(LEVELS, "head").alias("head_start"))
    starts = buckets.withColumn("inner_start", before([*LEVELS, "head"], "bucket")).join(heads, [*LEVELS, "head"])
    starts = starts.select(*LEVELS, "bucket", (F.col("head_start") + F.col("inner_start")).alias("start"))
    running = F.sum("n_tokens").over(
        W.partitionBy(*LEVELS, "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    )
    whole = F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).otherwise(F.array().cast("array<long>"))
    last = F.when(F.col("start") + F.col("running") <= F.col("rest"), F.array("whole")).otherwise(F.array().cast("array<long>"))
    return (
        drawn.join(starts, [*LEVELS, "bucket"])
        .withColumn("running", running)
        .select(*LEVELS, "doc_id", "n_tokens", "leaf_budget", F.concat(whole, last).alias("epochs"))
        .where(F.size("epochs") > 0)
    )


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`plan_mix` takes, each once per epoch it is taken in.

    Keeps the columns of the input; texts move once and are multiplied after the join.
    """
    plan = plan_mix(docs, id_col=id_col, lang_col=lang_col, source_col=source_col, domain=domain, **options)
    plan = plan.select(*[F.col(c).alias(f"__fq_{c}") for c in [*LEVELS, "doc_id", "epochs"]])
    source = F.coalesce(docs[source_col], F.lit(NO_VALUE))
    matched = docs.join(
        plan,
        docs[id_col].eqNullSafe(plan["__fq_doc_id"])
        & (source == plan["__fq_source"])
        & (F.coalesce(docs[lang_col], F.lit(NO_VALUE)) == plan["__fq_lang"])
        & ((source_domain(source) if domain is None else F.coalesce(domain, F.lit(NO_VALUE))) == plan["__fq_domain"]),
    )
    return matched.select(*[docs[c] for c in docs.columns], F.explode("__fq_epochs").alias("__fq_epoch")).drop("__fq_epoch")
