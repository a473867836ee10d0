"""Mixing sources to target weights: token weights are raked to marginals, then documents are sampled.

Tokens are summed by cell (source, language, topic). Iterative proportional fitting scales the cells until the sums by
source, by language and by topic have the target shares; a cell's rate is its fitted share over its own, divided by the
largest rate so that no document need be repeated, times what `budget` asks for. A document is kept if a hash of its key
falls below its cell's rate, so the outcome is the same on every run and in any partitioning. `most` bounds the weights:
where targets contradict each other, as those of a language and of a topic that only it has, fitting them would blow up
a few odd cells, and all other rates would be next to nothing; what a bounded cell can't take the others share.

Targets name shares of tokens by value. What they leave is shared by the values that they don't name, in proportion to
those values' own shares to the power `temper`. Topics are clusters of words (topics.py), or any column that is given.

Where the cells are few (at most CELLS, by a count) the fitting runs on the driver over cells alone; beyond that the same
steps run as grouped sums over the table of cells. Both end when a round changes no cell's share by more than `tolerance`.
Cells that are few are sent to all tasks; a larger table is joined by its key, whose hot values adaptive execution splits.

Defined cases: null or empty texts have no tokens, belong to their cell and are sampled like any other row of it; null
source, language or topic is a value of its own, which a target names by None; a target for a value that doesn't occur is
dropped and the rest renormalised; repeated rows share a key and so a fate; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import topics
from .common import written

CELLS = 200_000
AXES = ("source", "lang", "topic")
TOPICS = 8
_NONE = "\x00none"
_FITTED = "source string, lang string, topic string, tokens bigint, fit double"


def n_words(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def goals(cells: DataFrame, axis: str, given: dict[str | None, float], temper: float) -> DataFrame:
    """value, goal: the share of tokens that each value of the axis shall have."""
    if any(v < 0 for v in given.values()):
        raise ValueError("targets must not be negative")
    own = cells.groupBy(F.col(axis).alias("value")).agg(F.sum("tokens").cast("double").alias("own"))
    named = cells.sparkSession.createDataFrame([(_NONE if k is None else k, float(v)) for k, v in given.items()], "value string, given double")
    both = own.join(F.broadcast(named), "value", "left").withColumn("mass", F.when(F.col("given").isNull() & (F.col("own") > 0), F.pow("own", F.lit(temper))).otherwise(F.lit(0.0)))
    both = both.withColumn("given", F.when(F.col("own") > 0, F.col("given")))
    total = both.agg(F.coalesce(F.sum("given"), F.lit(0.0)).alias("given"), F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mass")).first() or (0.0, 0.0)
    rest = max(0.0, 1.0 - sum(given.values())) if total[1] > 0 else 0.0
    whole = total[0] + rest or 1.0
    share = F.coalesce("given", F.col("mass") * (rest / (total[1] or 1.0))) / whole
    return both.select("value", share.alias("goal"))


def _fitted(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float, most: float) -> tuple[DataFrame, bool]:
    """cells with `fit`, the share of tokens each shall have; and whether they are few."""
    spark = cells.sparkSession
    if cells.count() <= CELLS:
        rows = cells.collect()
        total = sum(r["tokens"] for r in rows) or 1
        fit = np.array([r["tokens"] / total for r in rows], np.float64)
        places = {}
        for axis in AXES:
            goal = {r["value"]: r["goal"] for r in targets[axis].collect()}  # no more values than cells
            at = {x: i for i, x in enumerate(goal)}
            places[axis] = (np.array([at[r[axis]] for r in rows], int), np.array(list(goal.values()), np.float64))
        own = fit.copy()
        for _ in range(rounds):
            before = fit
            for place, goal in places.values():
                now = np.bincount(place, fit, len(goal))
                fit = fit * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[place]
            if math.isfinite(most):
                fit = np.minimum(fit, most * own)
            if np.abs(fit - before).max(initial=0) <= tolerance:
                break
        table = [(*[r[a] for a in AXES], int(r["tokens"]), float(f)) for r, f in zip(rows, fit, strict=True)]
        return spark.createDataFrame(table, _FITTED), True
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    own = F.col("tokens") / total
    now = written(cells.select(*AXES, "tokens", own.alias("fit")), "cells")
    goal = {axis: written(x, "goals") for axis, x in targets.items()}
    for _ in range(rounds):
        new = now.withColumn("old", F.col("fit"))
        for axis in AXES:
            sums = new.groupBy(F.col(axis).alias("value")).agg(F.sum("fit").alias("sum")).join(goal[axis], "value").withColumnRenamed("value", axis)
            scale = F.coalesce(F.try_divide(F.col("fit") * F.col("goal"), F.col("sum")), F.lit(0.0))
            new = written(new.join(sums, axis).select(*AXES, "tokens", "old", scale.alias("fit")), "cells")
        new = new.withColumn("fit", F.least("fit", own * most))
        worst = new.agg(F.max(F.abs(F.col("fit") - F.col("old")))).first()[0] or 0.0
        now = new.drop("old")
        if worst <= tolerance:
            break
    return now, False


def weigh(
    docs: DataFrame, *, topic: Column | None = None, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang",
    targets: dict[str, dict[str | None, float]] | None = None, temper: float = 0.7, budget: float = 1.0, rounds: int = 100, tolerance: float = 1e-6,
    seed: int = 6, most: float = math.inf, carry: tuple[str, ...] = (),
) -> DataFrame:
    """key, carried columns, source, lang, topic, n_tokens, weight (fitted over own share), rate and kept of every row.

    targets: by axis (source, lang, topic) the share of tokens of some or all values. budget: the share of the largest
    sample without repeats that is wanted. most: the largest weight.
    """
    value = lambda c: F.coalesce(c.cast("string"), F.lit(_NONE))
    held = dict.fromkeys((key, *carry))
    asked = docs.select(*held, value(F.col(source)).alias("_source"), value(F.col(lang)).alias("_lang"), F.col(text).alias("_text"), (value(topic) if topic is not None else F.lit("")).alias("_topic"))
    if topic is not None:
        rows = asked.withColumn("n_tokens", n_words("_text"))
    else:
        model = topics.fit(docs, TOPICS, text=text, key=key)
        rows = topics.describe(asked.drop("_topic"), model, text="_text").withColumnRenamed("topic", "_topic")
    rows = rows.select(*held, "_source", "_lang", "_topic", "n_tokens")
    if not carry or topic is None:
        rows = written(rows, "token-counts")  # the texts are read once
    cells = written(rows.groupBy(*[F.col(f"_{a}").alias(a) for a in AXES]).agg(F.sum("n_tokens").alias("tokens")), "cells")
    wanted = {a: goals(cells, a, (targets or {}).get(a) or {}, temper) for a in AXES}
    fitted, few = _fitted(cells, wanted, rounds, tolerance, most)
    total = fitted.agg(F.sum("tokens").alias("t"), F.sum("fit").alias("f")).first()
    share, fit_sum = (total["t"] or 1), (total["f"] or 1.0)
    weight = F.coalesce(F.try_divide(F.col("fit") / fit_sum, F.col("tokens") / share), F.lit(1.0))
    fitted = fitted.withColumn("weight", weight)
    top = fitted.where("tokens > 0").agg(F.max("weight")).first()[0] or 1.0
    rate = F.least(F.lit(1.0), F.col("weight") / top * budget)
    fitted = fitted.select(*[F.col(a).alias(f"_{a}") for a in AXES], "weight", rate.alias("rate"))
    out = rows.join(F.broadcast(fitted) if few else fitted, [f"_{a}" for a in AXES])
    chance = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    named = [F.when(F.col(f"_{a}") != _NONE, F.col(f"_{a}")).alias(f"mix_{a}") for a in AXES]
    return out.select(*held, *named, "n_tokens", "weight", "rate", (chance < F.col("rate")).alias("kept"))
