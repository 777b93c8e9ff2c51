"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves are (domain, lang, source). A token budget flows down the tree by integer weights. A child takes no more
than its subtree can give, that is its tokens times the number of epochs; what it can't take goes to its siblings by
their weights, and only what the whole family can't take goes to the ancestors' other children. Each leaf then takes
whole epochs, and a prefix of one more epoch in the seeded order of that epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import stored

SEED = 17
EPOCHS = 4
PLACE_BITS, BUCKET_BITS = 60, 12
LEVELS = ("domain", "lang", "source")
_WORDS = r"[^\x20\x09-\x0D]+"


def word_tokens(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("bigint")


def source_domain(source: Column) -> Column:
    """Domain of a source: sources are dealt into four families by the number in their name; without one, 'other'."""
    number = F.regexp_extract(source, "([0-9]+)", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("bigint") % 4).cast("string"))).otherwise(F.lit("other"))


def domain_weight(name: Column) -> Column:
    return F.when(name == "domain0", 4).when(name == "domain1", 3).when(name == "domain2", 2).otherwise(1)


def lang_weight(name: Column) -> Column:
    return F.when(name == "en", 3).when(name == "de", 2).otherwise(1)


def source_weight(name: Column) -> Column:
    return F.lit(1)


WEIGHTS = {"domain": domain_weight, "lang": lang_weight, "source": source_weight}


def _shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Splits ``budget`` of each parent among its children (capacity, w): whole tokens, no more than the capacity.

    Children sorted by capacity / weight are filled in that order as long as their capacity is at most their share of
    what is left, so the filled ones are a prefix; the others share the remainder by weight.
    """
    order = [(F.col("capacity") / F.col("w")).asc(), F.col(name).asc_nulls_first()]
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = siblings.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = siblings.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    up_to = siblings.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    # Products of tokens and weights pass 64 bits on large corpora.
    wide = lambda c: c.cast("decimal(38,0)")
    full = children.withColumn("_full", wide(F.col("capacity")) * F.sum("w").over(ahead) <= wide(left) * F.col("w"))
    rest = full.withColumn("_rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(siblings), F.lit(0)))
    open_w = F.when(F.col("_full"), 0).otherwise(F.col("w"))
    rest = rest.withColumn("_all", F.sum(open_w).over(siblings)).withColumn("_upto", F.sum(open_w).over(up_to))
    share = lambda w: F.expr(f"cast(_rest AS decimal(28,0)) * ({w}) div greatest(_all, 1)").cast("bigint")
    own = share("_upto") - share(f"_upto - w")
    return rest.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(own)).drop("_full", "_rest", "_all", "_upto")


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: int = EPOCHS, weights: dict = WEIGHTS) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens); budgets are whole tokens.

    They sum to the least of the asked budget and all capacity. Null names are values of their own. ``budget`` is
    an expression over the sums of all leaves (column ``all_tokens``).
    """
    capacity = (F.col("tokens") * epochs).alias("capacity")
    low = leaves.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).select(*LEVELS, "tokens", capacity)
    total = low.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("_most"))
    total = total.select(F.least(budget.cast("bigint"), F.col("_most")).alias("budget"))
    parents: list[str] = []
    above = total
    for k, level in enumerate(LEVELS):
        keys = [*LEVELS[: k + 1]]
        nodes = low.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("w", weights[level](F.col(level)).cast("bigint"))
        if parents:
            named = above.select(*[F.col(p).alias(f"_{p}") for p in parents], "budget")
            same = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parents]
            nodes = nodes.join(named, same).drop(*[f"_{p}" for p in parents])
        else:
            nodes = nodes.crossJoin(F.broadcast(above))  # one row
        above = _shared_out(nodes, parents, level)
        parents = keys
    leaf = above.select(*[F.col(p).alias(f"_{p}") for p in LEVELS], "budget")
    return low.join(leaf, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in LEVELS]).select(*LEVELS, "tokens", "budget")


def _place(epoch: Column, seed: int) -> Column:
    """Place of a document in the seeded order of an epoch: 60 bits of a digest, the same in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("bigint")


def mixture(
    docs: DataFrame, budget: Column, epochs: int = EPOCHS, seed: int = SEED, domain=source_domain, tokens=word_tokens, weights: dict = WEIGHTS
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies, budget, leaf_tokens) for every row of ``docs``.

    ``copies`` says how often the row is taken: once per whole epoch of its leaf, and once more if it lies in the
    prefix of the next epoch, which ends before the first document that would pass the leaf's budget. Null names of
    lang or source are leaves of their own; a row without tokens, a null text too, takes part with 0 tokens and gets
    the whole epochs only. Ties in the seeded order are settled by doc_id; repeated rows are taken one by one.
    An empty table gives an empty result.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), domain(F.col("source")).alias("domain"), F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"), tokens(F.col("text")).alias("n_tokens"),
        ),
        "mix",
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    # One row per leaf, far below the documents; written, so that the joins below read it without computing it anew.
    plan = stored(
        leaf_budgets(leaves, budget, epochs, weights).select(
            *[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("tokens").alias("leaf_tokens"), "budget",
            F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("whole"),
            F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("part"),
        ),
        "plan",
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LEVELS]
    placed = rows.join(plan, same).drop(*[f"_{c}" for c in LEVELS]).withColumn("_place", _place(F.col("whole"), seed))
    # A leaf may hold a third of all rows: the prefix is found among bucket sums first, then inside one bucket.
    placed = stored(placed.withColumn("_bucket", F.shiftright("_place", PLACE_BITS - BUCKET_BITS).cast("int")), "placed")
    sums = placed.groupBy(*LEVELS, "part", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    running = Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_end", F.sum("_sum").over(running))
    border = stored(
        sums.filter((F.col("_end") > F.col("part"))).groupBy(*LEVELS)
        .agg(F.min(F.struct("_bucket", (F.col("_end") - F.col("_sum")).alias("_before"))).alias("_b"))
        .select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("_b._bucket").alias("_border"), F.col("_b._before").alias("_before")),
        "border",
    )
    cut = placed.join(border, same, "left").drop(*[f"_{c}" for c in LEVELS])
    inside = cut.filter(F.col("_bucket") == F.col("_border"))
    order = Window.partitionBy(*LEVELS).orderBy("_place", F.col("doc_id").asc_nulls_first())
    inside = inside.withColumn("_more", F.col("_before") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("part"))
    outside = cut.filter(F.col("_border").isNull() | (F.col("_bucket") != F.col("_border"))).withColumn("_more", F.col("_bucket") < F.col("_border"))
    extra = F.coalesce(F.col("_more") & (F.col("part") > 0), F.lit(False)).cast("bigint")
    return inside.unionByName(outside).select(
        "doc_id", "domain", "lang", "source", "n_tokens", (F.col("whole") + extra).alias("copies"), "budget", "leaf_tokens"
    )


def mixed_documents(docs: DataFrame, budget: Column, epochs: int = 1, **how) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it; all columns stay as they are.

    Rows are told apart by doc_id; several rows of one doc_id are each taken as often as the most taken of them.
    """
    taken = mixture(docs, budget, epochs, **how).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").cast("int").alias("_copies"))
    joined = docs.join(taken.filter("_copies > 0"), F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id"))).drop("_id")
    return joined.withColumn("_copies", F.explode(F.expr("sequence(1, _copies)"))).drop("_copies")
