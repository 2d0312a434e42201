"""Mixing of sources to target shares of tokens by entropy balancing."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealcast.llm.common import SPACE_WORD
from arealcast.session import materialize

#: No document is taken more often than this, so no source can give more than this times its size.
CAP = 3
ROUNDS, TOLERANCE = 200, 1e-9
#: Mean length of the documents that a mix takes, as a multiple of the source's: a wish that may be missed in part. SLACK is
#: how little missing it costs; the tokens of a source are met in full.
LENGTH_RATIO, SLACK = 1.1, 0.1
WEIGHTS = (1, 2, 3)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares of the whole size by weight, at most ``cap`` times the size.

    Weights repeat over the sources in code-point order, null last. What a source cannot take is shared again among the
    others by weight until none is above its cap: target = min(cap * size, weight * t) with one t for all, which is
    found by taking the capped ones out round by round. Only two sums come to the driver in a round.
    """
    # One row per source; the order of names is all that needs them together.
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    rows = materialize(rows.withColumn("most", cap * F.col("source_size")), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    t = 0.0
    while True:
        free = F.col("most") > F.col("weight") * t
        left, weight = rows.agg(
            F.sum(F.when(~free, F.col("most")).otherwise(0)), F.sum(F.when(free, F.col("weight")).otherwise(0))
        ).first()
        if not weight:
            break
        level = (total - left) / weight
        if level <= t:
            break
        t = level
    return rows.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(t))))


def balance(
    cells: DataFrame, targets: DataFrame, cap: float = CAP, length_ratio: float = LENGTH_RATIO, slack: float = SLACK
) -> DataFrame:
    """Rates of the entropy-balancing problem: ``targets`` (key, alpha, beta) such that a document's rate is
    min(cap, exp(alpha + beta * size / mean size of its source)).

    Two constraints a source, its tokens and its documents (their mean length is to be ``length_ratio`` times before):

        sum r * size = target
        sum r        = want = target / (mean * length_ratio)

    Of all rates r between 0 and ``cap`` that meet the first, these have the least

        sum (r log(r / q) - r)  +  (sum r - want)^2 / (2 * slack * want),      q = target / source size, the equal rate.

    Where sizes or the cap do not allow the wanted length the second is missed in part; with ``slack`` 0 it is met or the
    problem has no answer. The dual is concave in the multipliers (alpha - log q, beta):

        D = (alpha - log q) * want - slack * want * (alpha - log q)^2 / 2 + beta * target / mean - sum phi(alpha + beta * x)

    with phi' the capped rate. Newton steps begin at equal rates. A step is one distributed aggregation of value, gradient
    and Hessian over ``cells`` (key, size, n) and a 2 x 2 solve per source, all in columns. A step that does not raise D
    by the usual small share of what its slope promises is halved from where it began, so the rounds cannot circle. A source
    that has not come to its answer after ``ROUNDS`` rounds is an error.
    """
    x, log_cap = F.col("size") / F.col("mean"), math.log(cap)
    log_q = F.log(F.col("target") / (F.col("mean") * F.col("docs")))
    state = targets.select(
        "key", "target", "mean", (F.col("target") / (F.col("mean") * length_ratio)).alias("want"),
        (F.col("target") / F.col("mean")).alias("want_x"), log_q.alias("log_q"),
        log_q.alias("alpha"), F.lit(0.0).alias("beta"), F.lit(0.0).alias("step0"), F.lit(0.0).alias("step1"),
        F.lit(0.0).alias("promise"), F.lit(float("-inf")).alias("value"), F.lit(False).alias("still"),
    )
    state = materialize(state, "multipliers")
    power = F.col("alpha") + F.col("beta") * x
    # Above the cap the rate stays; its slope is zero there, so that only documents below it steer.
    free = power < log_cap
    rate = F.when(free, F.exp(power)).otherwise(float(cap))
    phi = F.when(free, F.exp(power)).otherwise(cap * (1 + power - log_cap))
    for _ in range(ROUNDS):
        moving = state.where("not still")
        if moving.isEmpty():
            break
        joined = cells.join(moving, "key").withColumn("r", rate * F.col("n")).withColumn("f", F.when(free, F.col("r")).otherwise(0.0))
        sums = joined.groupBy("key").agg(
            F.sum("r").alias("g0"), F.sum(F.col("r") * x).alias("g1"), F.sum(phi * F.col("n")).alias("phi"),
            F.sum("f").alias("h00"), F.sum(F.col("f") * x).alias("h01"), F.sum(F.col("f") * x * x).alias("h11"),
        )
        state = materialize(state.join(sums, "key", "left").select("*", *newton_step(slack)).select(*_next()), "multipliers")
    if not state.where("not still").isEmpty():
        raise ArithmeticError(f"rates of some source not found in {ROUNDS} Newton steps")
    # Sums come in any order; their last digits must not reach the copies.
    return state.select("key", "target", "mean", F.round("alpha", 10).alias("alpha"), F.round("beta", 10).alias("beta"))


def newton_step(slack: float) -> list[Column]:
    """What a state and its sums say: whether it is the answer, whether its last step failed, and the step from here."""
    c = F.col
    off = c("alpha") - c("log_q")
    value = off * c("want") - slack * c("want") * off * off / 2 + c("beta") * c("want_x") - c("phi")
    e0, e1 = c("want") - c("g0") - slack * c("want") * off, c("want_x") - c("g1")
    # Sizes that hardly vary leave beta undetermined; the small ridge then keeps it at zero.
    ridge = 1e-9 * (c("h00") + c("h11")) + 1e-12
    a, b, d = c("h00") + slack * c("want") + ridge, c("h01"), c("h11") + ridge
    det = a * d - b * b
    step0, step1 = (d * e0 - b * e1) / det, (a * e1 - b * e0) / det
    # No step is longer than 2; shortened ones keep their direction, which goes uphill.
    shorter = F.least(F.lit(1.0), 2 / F.greatest(F.abs(step0), F.abs(step1), F.lit(1e-300)))
    # With every document at the cap there is no more to take.
    done = (F.greatest(F.abs(e0), F.abs(e1)) <= TOLERANCE * c("want")) | ((c("h00") <= 0) & (e1 >= -TOLERANCE * c("want")))
    noise = 1e-13 * (F.abs(c("phi")) + F.abs(c("want_x") * c("beta")) + c("want"))
    failed = value < c("value") + 1e-4 * c("promise") - noise
    small = F.greatest(F.abs(c("step0")), F.abs(c("step1"))) < 1e-13
    return [
        (c("still") | done | (failed & small)).alias("now_still"), failed.alias("failed"), value.alias("now_value"),
        (step0 * shorter).alias("new0"), (step1 * shorter).alias("new1"), ((step0 * e0 + step1 * e1) * shorter).alias("new_promise"),
    ]


def _next() -> list[Column]:
    c = F.col

    def pick(at_end: Column, halved: Column, onward: Column) -> Column:
        return F.when(c("now_still"), at_end).when(c("failed"), halved).otherwise(onward)

    return [
        *map(c, ("key", "target", "mean", "want", "want_x", "log_q")),
        pick(c("alpha"), c("alpha") - c("step0") / 2, c("alpha") + c("new0")).alias("alpha"),
        pick(c("beta"), c("beta") - c("step1") / 2, c("beta") + c("new1")).alias("beta"),
        pick(c("step0"), c("step0") / 2, c("new0")).alias("step0"),
        pick(c("step1"), c("step1") / 2, c("new1")).alias("step1"),
        pick(c("promise"), c("promise") / 2, c("new_promise")).alias("promise"),
        pick(c("value"), c("value"), c("now_value")).alias("value"),
        c("now_still").alias("still"),
    ]


def copies_of_cells(cap: int):
    """For one source's cells, largest size first: whole copies ``taken`` of each, following the expected tokens.

    What a cell takes too much or too little is carried to the next, smaller size, so that in the end the source misses
    its target by about its smallest sizes. A source has at most as many cells as there are different sizes.
    """

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False)
        key, due, taken = cells["key"].iloc[0], 0.0, []
        tokens = cells["n"] * cells["size"]
        behind = zip((tokens * cells["rate"]).to_numpy()[::-1].cumsum()[::-1], tokens.to_numpy()[::-1].cumsum()[::-1])
        for size, n, rate, (expected, all_) in zip(cells["size"], cells["n"], cells["rate"], behind):
            due += n * rate * size
            # A draw that follows from the source and the size keeps sizes from being rounded the same way throughout.
            draw = zlib.crc32(f"{size} {key}".encode()) / 2**32
            # What is then left must be within reach of the smaller sizes: neither below zero nor above their cap.
            left = due + expected - n * rate * size
            low, high = math.ceil((left - cap * (all_ - n * size)) / size), math.floor(left / size + 1e-9)
            c = int(min(cap * n, max(0, low, min(high, math.floor(due / size + draw)))))
            due -= c * size
            taken.append(c)
        return cells.assign(copies=np.array(taken, np.int64))[["key", "size", "n", "copies"]]

    return run


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length_ratio: float = LENGTH_RATIO,
) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target of its source, copies, taken = copies * size.

    Documents without a word and of sources without one are taken zero times. Null is a source of its own. Rows that
    repeat are documents of their own. Reruns agree: which documents of equal size and source get one copy more
    follows from a hash of their id.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE_WORD)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), size.alias("size"))
    rows = materialize(rows, "sizes")
    cells = materialize(rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    sources = cells.groupBy("key", "source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs")
    )
    targets = source_targets(sources).withColumn("mean", F.try_divide("source_size", "docs"))
    targets = materialize(targets.select("key", "source_size", "docs", "target", "mean"), "targets")
    full = cells.where("size > 0").select("key", "size", "n")
    tilts = balance(full, targets.where("source_size > 0"), CAP, length_ratio)
    rate = F.least(F.lit(float(CAP)), F.exp(F.col("alpha") + F.col("beta") * F.col("size") / F.col("mean")))
    rated = full.join(tilts, "key").select("key", "size", "n", rate.alias("rate"))
    dealt = rated.groupBy("key").applyInPandas(copies_of_cells(CAP), "key string, size long, n long, copies long")
    return deal(rows, materialize(dealt, "copies"), targets)


def deal(rows: DataFrame, cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Give each document its share of its cell's copies: all the same number, and the first ones by hash one more.

    A cell of n documents is cut into about sqrt(n) parts by hash. Which part holds how many of those ones follows from
    the parts' counts, so that neither ordering ever holds more than about sqrt(n) rows of a cell.
    """
    h = F.xxhash64("doc_id", F.lit(1))
    marked = rows.join(cells, ["key", "size"], "left").withColumn(
        "part", F.coalesce(F.pmod(h, F.ceil(F.sqrt("n")).cast("long")), F.lit(0).cast("long"))
    )
    parts = marked.where("copies % n > 0").groupBy("key", "size", "part", "copies", "n").agg(F.count(F.lit(1)).alias("m"))
    sofar = F.sum("m").over(Window.partitionBy("key", "size").orderBy("part"))
    parts = parts.withColumn("upto", sofar).withColumn("extra", F.col("copies") % F.col("n"))

    def share(c: Column) -> Column:
        return F.floor(c * F.col("extra") / F.col("n"))

    more = (share(F.col("upto")) - share(F.col("upto") - F.col("m"))).cast("long")
    parts = materialize(parts.select("key", "size", "part", more.alias("more")), "parts")
    ranked = marked.join(parts, ["key", "size", "part"], "left")
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id"))
    whole = ranked.where("more is null").withColumn("one", F.lit(0))
    some = ranked.where("more is not null").withColumn("one", (place <= F.col("more")).cast("int"))
    both = whole.unionByName(some).join(targets.select("key", "source_size", "target"), "key")
    copies = F.coalesce(F.floor(F.col("copies") / F.col("n")).cast("long") + F.col("one"), F.lit(0).cast("long"))
    return both.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "source"
    )
