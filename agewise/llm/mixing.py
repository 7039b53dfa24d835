"""Mixing sources to target weights by a temperature found by bisection, realised as block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agewise.llm.common import WHITE, materialise, need



def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def powered(shares: list[float], exponent: float) -> list[float]:
    logs = [exponent * math.log(p) for p in shares]
    top = max(logs)
    parts = [math.exp(x - top) for x in logs]
    return [x / sum(parts) for x in parts]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect_exponent(fits: Callable[[float], bool], steps: int = 60) -> float:
    """The smallest exponent from 0 to 1 that fits; ``fits`` holds from some exponent on."""
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def temperature_weights(totals: dict[str, int], *, max_repeats: float | None = 1.5, target_entropy: float | None = None) -> dict[str, float]:
    """Weights proportional to a power of the token shares of the sources that have tokens.

    With ``target_entropy`` (nats), the exponent from 0 to 1 whose weights come down to it: the flattest weights whose
    entropy is at most that. Else the smallest exponent, so the flattest weights, with which no source is repeated more
    than ``max_repeats`` times as often as the least repeated.
    """
    live = {s: t for s, t in totals.items() if t > 0}
    if not live:
        return {}
    whole = sum(live.values())
    shares = [t / whole for t in live.values()]
    spread = math.log(max(shares) / min(shares))
    if target_entropy is not None:
        a = bisect_exponent(lambda a: entropy(powered(shares, a)) <= target_entropy)
    else:
        a = bisect_exponent(lambda a: (1 - a) * spread <= math.log(max_repeats) + 1e-12)
    return dict(zip(live, powered(shares, a), strict=True))


def source_exponent(totals: DataFrame, *, max_repeats: float | None, target_entropy: float | None, points: int = 32) -> float:
    """The exponent of :func:`temperature_weights` for a table of totals (t > 0, one row a source) of any length: the driver
    only gets sums. A repetition limit needs the least and the largest total; an entropy is summed for ``points`` exponents at
    once, between the two that enclose the target."""
    ends = totals.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    if ends["low"] is None:
        return 1.0
    if target_entropy is None:
        spread = math.log(ends["high"] / ends["low"])
        return bisect_exponent(lambda a: (1 - a) * spread <= math.log(max_repeats) + 1e-12)

    def entropies(exponents: list[float]) -> list[float]:
        logs = F.log(F.col("t") / F.lit(float(ends["high"])))
        parts = [x for k, a in enumerate(exponents) for x in (F.sum(F.exp(a * logs)).alias(f"z{k}"), F.sum(a * logs * F.exp(a * logs)).alias(f"e{k}"))]
        row = totals.agg(*parts).first()
        return [math.log(row[f"z{k}"]) - row[f"e{k}"] / row[f"z{k}"] for k in range(len(exponents))]

    low, high = 0.0, 1.0
    if entropies([0.0])[0] <= target_entropy:
        return 0.0
    while high - low > 1e-15:
        tried = [low + (high - low) * k / points for k in range(1, points)]
        met = [a for a, e in zip(tried, entropies(tried), strict=True) if e <= target_entropy]
        width = (high - low) / points
        high = min(met, default=high)
        low = max(low, high - width) if met else tried[-1]
        if width < 1e-16:
            break
    return high


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    tokens: Column | None = None,
    max_repeats: float | None = 1.5,
    target_entropy: float | None = None,
    budget: int | None = None,
    block_docs: int = 2000,
    seed: int = 17,
) -> DataFrame:
    """Rows of ``docs`` as often as the mixture takes them, with the column epoch (from 1) after their own.

    ``tokens`` (default: words of the text) is summed for each source; :func:`temperature_weights` gives the weights.
    With weights w, a ``budget`` of B tokens takes w * B / tokens epochs of a source; without a budget, B is the least with
    which every source has one whole epoch, so no row is lost. Whole epochs take every row. The rest of a source's budget
    takes its hash blocks of about ``block_docs`` rows in permuted order while they fit, and of the block at the border the
    rows in permuted order up to the one that reaches the budget.

    A null source is a source of its own. Sources without tokens are taken once. Null texts have no tokens; rows
    without tokens go with their block. Equal rows fall in the same block. An own column named epoch is replaced. An
    empty table gives no rows. Sources may be of any number: their totals, weights and epochs stay in a table, which Spark
    broadcasts only if it is small.
    """
    need(docs, [id_col, source_col, text_col])
    own = [c for c in docs.columns if c.lower() != "epoch"]
    count = word_count(F.col(text_col)) if tokens is None else tokens
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    row = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = materialise(docs.select(name.alias("__s"), count.cast("long").alias("__t"), row.alias("__h")), "sized")
    stats = sized.groupBy("__s").agg(F.coalesce(F.sum("__t"), F.lit(0)).alias("t"), F.count("*").alias("n"))
    stats = materialise(stats, "sources")
    live = stats.where(F.col("t") > 0)
    exponent = source_exponent(live, max_repeats=max_repeats, target_entropy=target_entropy)
    top = live.agg(F.max("t")).first()[0] or 1
    part = F.exp(F.lit(exponent) * F.log(F.col("t") / F.lit(float(top))))
    whole, most = live.agg(F.sum(part), F.max(F.col("t") / part)).first()
    if budget is None:
        budget = (whole or 0.0) * (most or 0.0)
    epochs = F.when(F.col("t") > 0, part / F.lit(whole or 1.0) * F.lit(float(budget)) / F.col("t")).otherwise(1.0)
    near = F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs)
    full = F.floor(F.col("e")).cast("int")
    plans = stats.withColumn("e", near).select(
        "__s", full.alias("__full"), F.round((F.col("e") - full) * F.col("t"), 6).alias("__need"), F.greatest(F.lit(1), F.ceil(F.col("n") / block_docs)).cast("long").alias("__n")
    )
    plans = materialise(plans, "plan")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(plans, "__s").withColumn("__b", F.pmod("__h", F.col("__n"))).withColumn("__o", F.xxhash64("__b", F.lit(seed + 1)))

    blocks = placed(sized).where(F.col("__need") > 0).groupBy("__s", "__o", "__b").agg(F.sum("__t").alias("__bt"), F.first("__need").alias("__bn"))
    # running totals within ranges of the order, and over the ranges' totals, so that no source's blocks are one task's
    blocks = materialise(blocks.withColumn("__r", F.shiftright("__o", 54)), "blocks")
    ranges = blocks.groupBy("__s", "__r").agg(F.sum("__bt").alias("__rt"))
    earlier = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__s", "__r", F.coalesce(F.sum("__rt").over(earlier), F.lit(0)).alias("__before"))
    order = Window.partitionBy("__s", "__r").orderBy("__o", "__b").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.join(ranges, ["__s", "__r"]).withColumn("__end", F.col("__before") + F.sum("__bt").over(order)).where(F.col("__end") >= F.col("__bn"))
    # one row a source: the block at the border of its budget, and what is left for it
    cuts = blocks.groupBy("__s").agg(F.min(F.struct("__o", "__b", (F.col("__bn") - F.col("__end") + F.col("__bt")).alias("left"))).alias("__cut"))
    dealt = placed(docs.select(*own, name.alias("__s"), row.alias("__h"))).join(materialise(cuts, "cuts"), "__s", "left")
    here, before = F.col("__o") == F.col("__cut.__o"), F.col("__o") < F.col("__cut.__o")
    at_border = F.coalesce(here & (F.col("__b") == F.col("__cut.__b")), F.lit(False))
    whole = F.coalesce(before | (here & (F.col("__b") < F.col("__cut.__b"))), F.lit(False))
    inner = dealt.where(~at_border).withColumn("__more", whole.cast("int"))
    rows = Window.partitionBy("__s", "__b").orderBy(F.xxhash64("__h", F.lit(seed + 2)), F.col(id_col)).rowsBetween(Window.unboundedPreceding, 0)
    size = count.cast("long")
    border = dealt.where(at_border).withColumn("__t", size)
    border = border.withColumn("__more", (F.sum("__t").over(rows) - F.col("__t") < F.col("__cut.left")).cast("int")).drop("__t")
    taken = inner.unionByName(border).withColumn("__times", F.col("__full") + F.col("__more")).where(F.col("__times") > 0)
    return taken.select(*own, F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("epoch"))
