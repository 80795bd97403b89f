"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import broadcast_if_small, fresh, quoted, stage

#: Power that present token shares of sources are taken to for the default targets: below 1, small ones gain.
TEMPER = 0.7
#: Constraints of languages and bands up to which the Hessian is added up whole; with more, each step solves
#: its system by conjugate gradients, whose products are distributed passes.
DENSE = 1000
TOLERANCE = 1e-9
#: Bound of the multipliers of languages and bands, which only targets reach that contradict each other, or that
#: ask for more than some hundred times the present share.
TILT = 5.0


def token_count(text: str) -> Column:
    """Words parted by white space; 0 for null."""
    return F.coalesce(F.regexp_count(quoted(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def _band(tokens: Column) -> Column:
    """Texts of alike length: the whole part of the logarithm to base 2."""
    return F.floor(F.log2(F.greatest(tokens, F.lit(1)))).cast("int")


def _weights(batch: pa.RecordBatch, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sources with their cells: (goal, log of the tilted tokens) by source; (source, f, share of it) by cell.

    ``f`` has the constraints of the cell, -1 where it has none; ``at`` ends with a 0 for those.
    """
    goal, cells = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    lengths = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = cells.flatten()
    f = np.stack([flat.field("f_lang").to_numpy(zero_copy_only=False), flat.field("f_band").to_numpy(zero_copy_only=False)], 1).astype(np.int64)
    tokens = flat.field("tokens").to_numpy(zero_copy_only=False).astype(float)
    owner, starts = np.repeat(np.arange(len(goal)), lengths), np.cumsum(lengths) - lengths
    some = tokens > 0
    log = np.where(some, np.log(np.where(some, tokens, 1.0)) + at[f].sum(1), -np.inf)
    top = np.maximum.reduceat(log, starts)
    top = np.where(np.isfinite(top), top, 0.0)
    e = np.exp(log - top[owner])
    z = np.maximum(np.add.reduceat(e, starts), 1e-300)
    return np.nan_to_num(goal), top + np.log(z), owner, f, e / z[owner]


def _sums(groups: DataFrame, at: np.ndarray, along: np.ndarray | None = None, whole: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
    """One distributed pass: value and gradient of the reduced dual, and its Hessian (or its product with ``along``)."""
    k = len(at)
    shared = groups.sparkSession.sparkContext.broadcast((np.append(at, 0.0), None if along is None else np.append(along, 0.0)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, along = shared.value
        value, gradient = 0.0, np.zeros(k + 1)
        second = np.zeros((k + 1, k + 1) if whole else k + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            goal, z, owner, f, share = _weights(batch, at)
            mass = goal[owner] * share
            value += float(goal @ z)
            for d in range(2):
                gradient += np.bincount(f[:, d] % (k + 1), mass, k + 1)
            if whole:
                for d in range(2):
                    for c in range(2):
                        np.add.at(second, (f[:, d], f[:, c]), mass)
                step = max(1, (1 << 21) // (k + 1))
                for a in range(0, len(goal), step):
                    on = slice(np.searchsorted(owner, a), np.searchsorted(owner, a + step))
                    mean = np.zeros((min(step, len(goal) - a), k + 1))
                    for d in range(2):
                        np.add.at(mean, (owner[on] - a, f[on, d]), share[on])
                    second -= (mean * goal[a : a + step, None]).T @ mean
            elif along is not None:
                dot = along[f].sum(1)
                inner = mass * (dot - np.bincount(owner, share * dot, len(goal))[owner])
                for d in range(2):
                    second += np.bincount(f[:, d] % (k + 1), inner, k + 1)
        i = np.concatenate([[-1], np.arange(k)])
        j, x = np.full(k + 1, -1), np.concatenate([[value], gradient[:k]])
        if whole:
            r, c = np.nonzero(second[:k, :k])
            i, j, x = np.concatenate([i, r]), np.concatenate([j, c]), np.concatenate([x, second[r, c]])
        elif along is not None:
            i, j, x = np.concatenate([i, np.arange(k)]), np.concatenate([j, np.zeros(k, np.int64)]), np.concatenate([x, second[:k]])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(x)], names=["i", "j", "x"])

    value, gradient, second = 0.0, np.zeros(k), np.zeros((k, k) if whole else k)
    for i, j, x in groups.select("goal", "cells").mapInArrow(part, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toLocalIterator():
        if i < 0:
            value = x
        elif j < 0:
            gradient[i] = x
        elif whole:
            second[i, j] = x
        else:
            second[i] = x
    shared.unpersist()
    return value, gradient, second


def _conjugate(product, right: np.ndarray) -> np.ndarray:
    """x with product(x) = right, for a matrix that is not negative, to a hundred-thousandth."""
    x, rest = np.zeros_like(right), right.copy()
    step, size = rest.copy(), float(right @ right)
    first = size
    for _ in range(4 * len(right)):
        if size <= 1e-10 * first:
            break
        image = product(step)
        if (curve := float(step @ image)) <= 1e-14 * float(step @ step):
            break
        x += size / curve * step
        rest -= size / curve * image
        before, size = size, float(rest @ rest)
        step = rest + size / before * step
    return x


def newton(groups: DataFrame, goals: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The minimum of the dual over the multipliers of languages and bands.

    The dual's other multipliers, those of sources, have a closed form for given ones of these (each cell is of
    one source: its multiplier is the log of its goal over its tilted tokens) and are eliminated, so that the
    number of sources has no bound.  What is left is convex too:
    sum over sources of goal * log(sum over cells of tokens * exp(multipliers of the cell)) - multipliers . goals.
    ``groups`` has a row for each source.  Each round is a distributed pass that adds up value, gradient and
    Hessian; the step is halved while the value would grow.
    """
    k = len(goals)
    whole = k <= DENSE

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, gradient, matrix = _sums(groups, at, whole=whole)
        return value - float(at @ goals), gradient - goals, matrix

    at = np.zeros(k)
    value, gradient, matrix = sums(at)
    for _ in range(rounds):
        # multipliers at their bound that would go beyond it stay there
        free = ~((at >= TILT) & (gradient < 0) | (at <= -TILT) & (gradient > 0))
        if np.abs(gradient[free]).max(initial=0) < TOLERANCE:
            break
        # dimensions all add up to the same total, so the system has directions without effect
        step = np.zeros(k)
        if whole:
            step[free] = -np.linalg.lstsq(matrix[np.ix_(free, free)] + 1e-13 * np.eye(int(free.sum())), gradient[free], rcond=1e-11)[0]
        else:
            step = _conjugate(lambda v, at=at, free=free: np.where(free, _sums(groups, at, along=np.where(free, v, 0.0))[2], 0.0), np.where(free, -gradient, 0.0))
        size = 1.0
        while True:
            to = np.clip(at + size * step, -TILT, TILT)
            new = sums(to)
            if new[0] <= value + 1e-13 * abs(value) + 1e-15 or size < 1e-6:
                break
            size /= 2
        if size < 1e-6:
            break
        at, (value, gradient, matrix) = to, new
    if (left := np.abs(gradient).max(initial=0)) > 1e-6:
        warnings.warn(f"the targets are not met: a constraint is off by {left:.2g} of all tokens; the sources' targets and these may contradict each other", stacklevel=3)
    return at


def mixing_rates(
    docs: DataFrame,
    targets: dict[str, dict] | None = None,
    budget: float | None = None,
    source: str = "source",
    lang: str = "lang",
    tokens: str = "tokens",
) -> DataFrame:
    """(source, lang, band, tokens, documents, rate) for each cell of ``docs``, which has a count of tokens.

    Of all rates that meet the token constraints, those of least relative entropy to the present corpus:
    exp(s + l + b) with a multiplier for the document's source, language and band of length.
    ``targets`` gives weights by value for ``source``, ``lang`` or ``band``; what it leaves out of a
    dimension (or a whole dimension) keeps its present share of tokens, except that sources default to
    their share to the power TEMPER.  ``budget`` is the number of tokens wanted; by default the least with
    which no cell has a rate below 1, so that no document is lost.

    Null sources and languages are a value of their own.  Targets for values that no document has are
    left out, and the rest rescaled.  Cells without tokens take part in no constraint.  Sources may be any
    number.  Targets that contradict each other are met as far as multipliers
    of TILT allow, with a warning.
    """
    cells = stage(
        docs.select(quoted(source).alias("source"), quoted(lang).alias("lang"), quoted(tokens).alias("tokens"))
        .groupBy("source", "lang", _band(F.col("tokens")).alias("band"))
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")),
        "cells",
    )
    for dim, weights in (targets or {}).items():
        if weights and min(weights.values()) <= 0:
            raise ValueError(f"target weights of {dim} must be above 0; leave the documents out beforehand instead")
    spark = docs.sparkSession
    full = cells.where("tokens > 0")
    total = float(full.agg(F.sum("tokens")).first()[0] or 0)
    numbers: dict[str, dict] = {}
    goals: list[float] = []
    for dim in ("lang", "band"):
        present = {r[0]: float(r[1]) / total for r in full.groupBy(dim).agg(F.sum("tokens")).toLocalIterator()}
        wanted = dict(present)
        given = {v: w for v, w in ((targets or {}).get(dim) or {}).items() if v in present}
        if given:
            factor = sum(present[v] for v in given) / sum(given.values())
            wanted |= {v: w * factor for v, w in given.items()}
        numbers[dim] = {v: len(goals) + i for i, v in enumerate(sorted(wanted, key=lambda v: (v is None, str(v))))}
        goals += [wanted[v] for v in numbers[dim]]
    sources = full.groupBy("source").agg((F.sum("tokens") / F.lit(total or 1.0)).alias("present"))
    if given := (targets or {}).get("source"):
        weights = spark.createDataFrame([(v, float(w)) for v, w in given.items()], cells.select(F.col("source").alias("named")).schema.add("weight", "double"))
        sources = stage(sources.join(broadcast_if_small(weights), F.col("source").eqNullSafe(F.col("named")), "left"), "sources")
        in_all = sources.where("weight is not null").agg(F.sum("present"), F.sum("weight")).first()
        goal = F.when(F.col("weight").isNotNull(), F.col("weight") * F.lit((in_all[0] or 0.0) / (in_all[1] or 1.0))).otherwise(F.col("present"))
    else:
        sources = stage(sources.withColumn("weight", F.pow("present", F.lit(TEMPER))), "sources")
        goal = F.col("weight") / F.lit(sources.agg(F.sum("weight")).first()[0] or 1.0)
    with_f = cells
    for dim in ("lang", "band"):
        known = spark.createDataFrame([(v, n) for v, n in numbers[dim].items()], cells.select(F.col(dim).alias("known")).schema.add(f"f_{dim}", "integer"))
        with_f = with_f.join(broadcast_if_small(known), F.col(dim).eqNullSafe(F.col("known")), "left").drop("known").withColumn(f"f_{dim}", F.coalesce(f"f_{dim}", F.lit(-1)))
    # a source has at most as many cells as there are languages and bands together
    grouped = with_f.groupBy("source").agg(F.collect_list(F.struct("lang", "band", "tokens", "documents", "f_lang", "f_band")).alias("cells"))
    wanted = sources.select(F.col("source").alias("named"), goal.alias("goal"))
    groups = stage(grouped.join(wanted, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "goal", "cells"), "groups")
    at = newton(groups.where("goal is not null"), np.array(goals)) if goals else np.zeros(0)
    multipliers = np.append(at, 0.0)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            goal, z, owner, f, _ = _weights(pa.RecordBatch.from_arrays(batch.columns[1:], names=["goal", "cells"]), multipliers)
            own = np.where(goal > 0, np.log(np.where(goal > 0, goal * total, 1.0)) - z, 0.0)
            got = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(goal)))]).astype(np.int32)), pa.array(np.exp(own[owner] + multipliers[f].sum(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), got], names=["source", "cells", "rates"])

    each = groups.mapInArrow(rates, groups.drop("goal").schema.add("rates", T.ArrayType(T.DoubleType()))).select("source", F.explode(F.arrays_zip("cells", "rates")).alias("c"))
    rated = stage(each.select("source", *[F.col(f"c.cells.{n}").alias(n) for n in ("lang", "band", "tokens", "documents")], F.col("c.rates").alias("rate")), "rated")
    row = rated.agg(F.min("rate"), F.sum(F.col("rate") * F.col("tokens"))).first()
    if row[0] is None:
        return rated
    factor = 1 / row[0] if budget is None else budget / row[1] if row[1] else 1.0
    return rated.withColumn("rate", F.when(F.abs(F.col("rate") * factor - F.round(F.col("rate") * factor)) < 1e-6, F.round(F.col("rate") * factor)).otherwise(F.col("rate") * factor))


def _copies(rate: Column, keys: list[Column], seed: int) -> Column:
    """The rate rounded down or up, up with the chance of what is left, by a hash of the row."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mixed_copies(
    docs: DataFrame,
    targets: dict[str, dict] | None = None,
    budget: float | None = None,
    seed: int = 29,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
) -> DataFrame:
    """For every row of ``docs``: (doc_id, source, lang, tokens, rate, copies), see :func:`mixing_rates`.

    ``copies`` is the rate rounded to a whole number at random, by a hash of doc_id and text, so that its
    mean is the rate.  Null and empty texts have 0 tokens and the rate of their source and language;
    repeated rows have equal rates and copies; texts count whole; an empty table gives no rows; other
    columns are not looked at.
    """
    narrow = stage(
        docs.select(
            quoted(doc_id).alias("doc_id"),
            quoted(source).alias("source"),
            quoted(lang).alias("lang"),
            token_count(text).alias("tokens"),
            F.xxhash64(quoted(doc_id), quoted(text)).alias("row"),
        ),
        "tokens",
    )
    rated = _join_rates(narrow, mixing_rates(narrow, targets, budget), "source", "lang", "tokens", "rate")
    return rated.select("doc_id", "source", "lang", "tokens", "rate", _copies(F.col("rate"), [F.col("row")], seed).alias("copies"))


def _join_rates(docs: DataFrame, rates: DataFrame, source: str, lang: str, tokens: str, rate: str) -> DataFrame:
    table = stage(rates.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("band").alias("_b"), F.col("rate").alias("_r")), "rates")
    s, l, b = fresh(docs.columns, "mix_s", "mix_l", "mix_b")
    table = table.select(F.col("_s").alias(s), F.col("_l").alias(l), F.col("_b").alias(b), F.col("_r").alias(rate))
    on = quoted(source).eqNullSafe(quoted(s)) & quoted(lang).eqNullSafe(quoted(l)) & (_band(quoted(tokens)) == quoted(b))
    return docs.join(broadcast_if_small(table), on, "left").drop(s, l, b)


def mix(
    docs: DataFrame,
    targets: dict[str, dict] | None = None,
    budget: float | None = None,
    seed: int = 29,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as :func:`mixed_copies` says.

    Null and empty texts have no tokens and the rate of their source and language; null sources and languages
    are a value of their own; a null doc_id is hashed like a value; repeated rows have equal copies; texts
    count whole; an empty table gives no rows; other columns, whatever their names, stay as they are.
    """
    tokens, rate, times = fresh(docs.columns, "tokens", "rate", "times")
    counted = docs.withColumn(tokens, token_count(text))
    rates = mixing_rates(counted.select(quoted(source).alias("source"), quoted(lang).alias("lang"), quoted(tokens).alias("tokens")), targets, budget)
    rated = _join_rates(counted, rates, source, lang, tokens, rate)
    copies = _copies(quoted(rate), [F.xxhash64(quoted(doc_id), quoted(text))], seed)
    return rated.where(copies > 0).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*[quoted(c) for c in docs.columns])
