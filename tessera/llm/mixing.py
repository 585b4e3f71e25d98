"""Mixing sources to target weights by entropy balancing.

The rates closest to one in entropy, weighted by tokens, that meet a token target for each source are exponential tilts of its documents,
exp(lambda); Newton steps on the convex dual find the multipliers. Rates are then rounded into copies whose tokens meet the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, save, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BINS, PASSES = 1024, 3
#: Least words of the classes of sizes.
CLASSES = (2048, 256, 0)
#: Sources that may be broadcast to documents, of under 100 bytes and a name each; beyond it the join shuffles.
BROADCAST_SOURCES = 10_000
_KEY = ["__name", "__null"]


def word_count(text: str) -> Column:
    """Number of words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: str) -> Column:
    kind = F.lit(len(CLASSES) - 1)
    for c in range(len(CLASSES) - 2, -1, -1):
        kind = F.when(F.col(size) >= CLASSES[c], c).otherwise(kind)
    return kind


def source_key(df: DataFrame) -> dict[str, Column]:
    source = F.col("source").cast("string") if "source" in df.columns else F.lit(None).cast("string")
    return {"__name": F.coalesce(source, F.lit("")), "__null": source.isNull()}


def place(doc_id: str, seed: int) -> Column:
    """A number in [0, 1) fixed for each document, in steps of 2^-40."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 24) / F.lit(float(1 << 40))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sources`` (key, source_size) with target: weights repeat over the sources by code point, null last; ``share`` of all sizes is
    dealt by weight; a target stops at ``most`` times its source, and the excess is dealt again."""
    by_name = Window.orderBy("__null", "__name")
    ranked = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("full", most * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("w"))
    order = Window.orderBy("ratio", "__null", "__name")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (share * F.sum("source_size").over(every) - before) / rest).withColumn("at", F.row_number().over(order))
    level = level.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("at"))).over(every))
    return level.select(*_KEY, "source_size", F.least("full", F.coalesce(F.col("level") * F.col("w"), F.col("full"))).alias("target"))


def multipliers(sources: DataFrame, tolerance: float = 1e-10, most_steps: int = 60) -> DataFrame:
    """``sources`` (key, source_size, target) with the dual solution ``lam``: source_size * exp(lam) = target.

    All documents of a source share a tilt, so the dual's gradient and Hessian need only its token sums, summed once. A Newton step moves
    every source's multiplier at once; steps are a few rows each and end when no constraint is off by more than ``tolerance``.
    """
    state = save(sources.withColumn("lam", F.lit(0.0)), "dual")
    for _ in range(most_steps):
        tokens = F.col("source_size") * F.exp("lam")
        some = (F.col("source_size") > 0) & (F.col("target") > 0)
        worst = state.where(some).agg(F.max(F.abs(tokens - F.col("target")) / F.col("target"))).first()[0]
        if worst is None or worst <= tolerance:
            break
        new = save(state.withColumn("lam", F.when(some, F.col("lam") - (tokens - F.col("target")) / tokens).otherwise(F.lit(0.0))), "dual")
        drop(state)
        state = new
    return state


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with whole copies ``base`` of each document and, for each class of sizes, a ``cut``: documents placed below it get one more.

    A cut comes from histograms of token sums by place, each refining the bin in which the running sum passed the need. Classes go
    from long documents to short ones, and what a class misses is made up by the next.
    """
    rate = F.least(F.exp("lam"), F.lit(MOST))
    state = sources.withColumn("base", F.when(F.col("source_size") > 0, F.floor(rate + 1e-12)).otherwise(F.lit(0)).cast("int"))
    extra = F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0)) / F.greatest(F.col("source_size"), F.lit(1))
    state = state.withColumn("part", F.when(F.col("base") < MOST, extra).otherwise(F.lit(0.0))).withColumn("need", F.lit(0.0))
    state = save(state.withColumns({f"cut{c}": F.lit(0.0) for c in range(len(CLASSES))}), "cuts")
    for c in range(len(CLASSES)):
        cut, width = f"cut{c}", 1.0
        state = state.withColumn("need", F.col("need") + F.col("part") * F.col(f"size{c}"))
        for last in [False] * (PASSES - 1) + [True]:
            width /= BINS
            some = with_sources(sized.where(F.col("class") == c), state.where("need > 0").select(*_KEY, cut), _KEY).where(F.col(cut).isNotNull())
            sums = some.withColumn("bin", F.floor((F.col("u") - F.col(cut)) / F.lit(width))).where(F.col("bin").between(0, BINS - 1))
            sums = sums.groupBy(*_KEY, "bin").agg(F.sum("size").alias("tokens"))
            running = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy(*_KEY).orderBy("bin"))).join(state.select(*_KEY, "need"), _KEY)
            below = F.col("upto") <= F.col("need")
            found = running.groupBy(*_KEY).agg(
                F.max(F.when(below, F.col("upto"))).alias("spent"), F.min(F.when(~below, F.col("bin"))).alias("bin"), F.min_by(F.when(~below, F.col("tokens")), F.when(~below, F.col("bin"))).alias("tokens")
            )
            new = state.join(found, _KEY, "left")
            left = F.col("need") - F.coalesce("spent", F.lit(0))
            # the last bin is in as a whole if that comes nearer to the need
            whole = F.lit(last) & F.col("bin").isNotNull() & (left * 2 >= F.col("tokens"))
            moved = F.col(cut) + F.coalesce(F.col("bin") + F.when(whole, 1).otherwise(0), F.lit(BINS)) * width
            new = new.withColumn(cut, F.when(F.col("need") > 0, moved).otherwise(F.col(cut))).withColumn("need", left - F.when(whole, F.col("tokens")).otherwise(0))
            state = save(new.drop("spent", "bin", "tokens"), "cuts")
    return state


def with_sources(df: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    if sources.count() <= BROADCAST_SOURCES:
        return df.join(F.broadcast(sources), key, "left")
    return df.join(sources, key, "left")


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42
) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, rate and copies; the mix takes ``copies`` of each document.

    Sources (null is one of its own, sorted last) share ``share`` of all words by weight, repeated over the sources by code point, and
    at most ``most`` = 2 times their own. A null or empty text has size 0 and takes part in no sum. Copies are 0, 1 or 2, fixed by a
    hash of doc_id, so reruns agree; rows repeated under an id get the same. Each source's words come within about half a
    short document of its target. Columns named like the new ones are replaced. An empty table gives an empty one.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies")
    source = source_key(docs)
    sized = docs.select(*(x.alias(name) for name, x in source.items()), word_count("text").alias("size"), place("doc_id", seed).alias("u"))
    sized = save(sized.withColumn("class", size_class("size")), "sizes")
    sums = [F.coalesce(F.sum(F.when(F.col("class") == c, F.col("size"))), F.lit(0)).alias(f"size{c}") for c in range(len(CLASSES))]
    sources = save(sized.groupBy(*_KEY).agg(F.sum("size").alias("source_size"), *sums), "sources")
    dual = multipliers(targets(sources.select(*_KEY, "source_size"), weights, share, most))
    state = thresholds(sized, dual.join(sources.drop("source_size"), _KEY))
    drop(sized)
    inner = [*_KEY, "base", *(f"cut{c}" for c in range(len(CLASSES)))]
    own = dict(zip(inner, unused([*docs.columns, "size", "source_size", "target", "rate", "copies"], *inner), strict=True))
    state = state.select(*(F.col(c).alias(own[c]) for c in inner), "source_size", "target", F.exp("lam").alias("rate"))
    key = [own[c] for c in _KEY]
    out = with_sources(docs.withColumns({own[c]: x for c, x in source.items()}), state, key).withColumn("size", word_count("text"))
    cut = F.element_at(F.array(*(own[f"cut{c}"] for c in range(len(CLASSES)))), size_class("size") + 1)
    return out.withColumn("copies", F.least(F.col(own["base"]) + F.when(place("doc_id", seed) < cut, 1).otherwise(0), F.lit(int(most)))).drop(*own.values())
