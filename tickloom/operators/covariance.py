"""Covariance estimators: (date, i, j, cov) with i <= j, all dates in one job.

A matrix is symmetric, so every pair is there once, under its names in order;
``both_triangles`` gives the other half where a caller wants it.

A covariance matrix has every pair by definition, but the returns need not be
multiplied out pair by pair.  ``gram`` hashes a window's assets into blocks of a
few hundred, ships every block once per partner block and multiplies the two as
matrices, so the shuffle carries (rows x assets x blocks) numbers rather than
(rows x assets^2), no group exceeds two blocks, and the estimators are column
arithmetic on the resulting pair sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.calendar import Offset
from tickloom.operators.estimators import QUARTER, TEN_YEARS, coverage_filter, history, of_pool
from tickloom.operators.expected_returns import decay_of
from tickloom.operators.support import with_group_totals
from tickloom.session import cut_lineage

# Assets per block; two blocks of a ten-year daily window take about 10 MB.
BLOCK = 256

# fixed values: default (volatility, correlation) half-lives of the blended estimate
HALFLIFE_PAIRS = [(10, 21), (21, 63), (63, 125), (125, 250), (250, 500)]

_SUMS = "n double, sw double, sw2 double, sx double, sy double, sxy double"
_GRAM = f"now date, i string, j string, k int, {_SUMS}"


def _matrix(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.zeros((len(rows), length))
    mask = np.zeros((len(rows), length))
    for at, (positions, numbers) in enumerate(zip(rows["at"], rows["vals"])):
        values[at, positions] = numbers
        mask[at, positions] = 1.0
    return values, mask


def _block_product(decays: Sequence[float]):
    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        length = int(rows["rlen"].iloc[0])
        lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
        left = rows[rows["block"] == lo]
        right = rows[rows["block"] == hi]
        x, m = _matrix(left, length)
        y, o = (x, m) if lo == hi else _matrix(right, length)
        names_i, names_j = left["asset"].to_numpy(), right["asset"].to_numpy()
        out = []
        count = m @ o.T
        for k, decay in enumerate(decays):
            w = decay ** np.arange(length - 1, -1, -1, dtype=float)
            sums = {
                "sw": (m * w) @ o.T,
                "sw2": (m * (w * w)) @ o.T,
                "sx": (x * w) @ o.T,
                "sy": (m * w) @ y.T,
                "sxy": (x * w) @ y.T,
            }
            a, b = np.nonzero(count > 0)
            if lo == hi:
                ordered = names_i[a] <= names_j[b]
                a, b = a[ordered], b[ordered]
            frame = pd.DataFrame({"i": names_i[a], "j": names_j[b], "k": k, "n": count[a, b]})
            for name, table in sums.items():
                frame[name] = table[a, b]
            turned = (frame["i"] > frame["j"]).to_numpy()
            out.append(frame[~turned])
            if turned.any():
                out.append(frame[turned].rename(columns={"i": "j", "j": "i", "sx": "sy", "sy": "sx"}))
        result = pd.concat(out, ignore_index=True)
        result.insert(0, "now", rows["now"].iloc[0])
        return result[["now", "i", "j", "k", "n", "sw", "sw2", "sx", "sy", "sxy"]]

    return multiply


def gram(rows: DataFrame, decays: Sequence[float] = (1.0,), center: bool = False, block: int = BLOCK) -> DataFrame:
    """Pair sums of window values over the rows both assets have.

    Per (now, i, j) and decay ``k``: count, weight sums and the weighted sums of
    x, y and xy, for i <= j.  Pairs without a common row are absent.  ``center`` takes each
    asset's window mean off first: covariances stay, the sums lose less precision.
    """
    vectors = rows.groupBy("now", "asset").agg(
        F.first("rlen").alias("rlen"),
        F.collect_list("rpos").alias("at"),
        F.collect_list("value").alias("vals"),
        (F.avg("value") if center else F.lit(0.0)).alias("_mean"),
    )
    if center:
        vectors = vectors.withColumn("vals", F.transform("vals", lambda v: v - F.col("_mean")))
    sized = with_group_totals(vectors, ["now"], _p=F.count(F.lit(1)))
    blocks = F.ceil(F.col("_p") / block).cast("int")
    placed = sized.withColumn("_blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("asset"), F.col("_blocks").cast("long")).cast("int")
    )
    sent = placed.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_partner")
    ).select(
        "now",
        F.least("block", "_partner").alias("lo"),
        F.greatest("block", "_partner").alias("hi"),
        "block",
        "asset",
        "rlen",
        "at",
        "vals",
    )
    return sent.groupBy("now", "lo", "hi").applyInPandas(_block_product(list(decays)), _GRAM)


def both_triangles(cov: DataFrame) -> DataFrame:
    """Every pair of different names in both orders; other columns, which must be symmetric, are copied."""
    own = F.struct("i", "j")
    orders = F.when(F.col("i") == F.col("j"), F.array(own)).otherwise(
        F.array(own, F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    rest = [c for c in cov.columns if c not in ("i", "j")]
    return cov.select(*rest, F.explode(orders).alias("_pair")).select(
        *[F.col(f"_pair.{c}").alias(c) if c in ("i", "j") else c for c in cov.columns]
    )


def _named(df: DataFrame, cov: Column) -> DataFrame:
    return df.select(F.col("now").alias("date"), "i", "j", cov.alias("cov"))


def _pool_history(panel, calendar, pool, lookback, lag, **window) -> DataFrame:
    return of_pool(history(panel, calendar, pool, lookback, lag, **window), pool)


def cov_sample(panel, calendar, pool, lookback=QUARTER, lag=Offset(), ddof: int = 1, **window) -> DataFrame:
    """Pairwise-complete covariance."""
    sums = gram(_pool_history(panel, calendar, pool, lookback, lag, **window), center=True)
    freedom = F.col("n") - ddof
    value = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.when(freedom > 0, freedom)
    return _named(sums, value).where(F.col("cov").isNotNull())


def cov_log(panel, calendar, pool, lookback=QUARTER, lag=Offset(), ddof: int = 1, **window) -> DataFrame:
    return cov_sample(panel, calendar, pool, lookback, lag, ddof, log=True, **window)


def cov_semi(panel, calendar, pool, lookback=QUARTER, lag=Offset(), threshold_return: float = 0.0, **window) -> DataFrame:
    """Mean product of the shortfalls below a threshold over the joint rows."""
    rows = _pool_history(panel, calendar, pool, lookback, lag, **window)
    short = rows.withColumn("value", F.least(F.col("value") - threshold_return, F.lit(0.0)))
    return _named(gram(short), F.col("sxy") / F.col("n"))


def _ew_cov() -> Column:
    """Bias-corrected weighted covariance; null where one row carries all weight."""
    biased = F.col("sxy") / F.col("sw") - (F.col("sx") / F.col("sw")) * (F.col("sy") / F.col("sw"))
    mass = F.col("sw") * F.col("sw")
    rest = mass - F.col("sw2")
    return F.when(F.col("n") > 1, biased * mass / F.when(rest > 0, rest))


def cov_ewma(panel, calendar, pool, lookback=TEN_YEARS, lag=Offset(), alpha=None, halflife=None, **window) -> DataFrame:
    """Exponentially weighted pairwise covariance at the end of the window."""
    rows = _pool_history(panel, calendar, pool, lookback, lag, **window)
    sums = gram(rows, [decay_of(alpha, halflife)], center=True)
    return _named(sums, _ew_cov()).where(F.col("cov").isNotNull())


def _complete(panel, calendar, pool, lookback, lag, min_coverage, log, **window) -> DataFrame:
    """Coverage-filtered complete cases; logs are taken of the kept returns."""
    # both frames are read several times over; written once they are not computed again
    rows = cut_lineage(_pool_history(panel, calendar, pool, lookback, lag, **window))
    rows = cut_lineage(coverage_filter(rows, min_coverage))
    return rows.withColumn("value", F.log1p("value")) if log else rows


def cov_regime_blended(
    panel,
    calendar,
    pool,
    lookback=TEN_YEARS,
    lag=Offset(),
    halflife_pairs: Sequence[tuple[float, float]] = HALFLIFE_PAIRS,
    min_coverage: float = 0.8,
    use_log_returns: bool = True,
    **window,
) -> DataFrame:
    """Mean over half-life pairs of (correlation at one, volatilities at the other).

    All half-lives come out of one pass over the blocks.
    """
    rows = _complete(panel, calendar, pool, lookback, lag, min_coverage, use_log_returns, **window)
    lives = sorted({h for pair in halflife_pairs for h in pair})
    sums = gram(rows, [1.0, *[decay_of(halflife=h) for h in lives]], center=True)
    plain = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.when(F.col("n") > 1, F.col("n") - 1)
    valued = sums.withColumn("_c", F.when(F.col("k") == 0, plain).otherwise(_ew_cov()))
    wide = cut_lineage(valued.groupBy("now", "i", "j").agg(
        F.max(F.when(F.col("k") == 0, F.col("_c"))).alias("_plain"),
        *[F.max(F.when(F.col("k") == at + 1, F.col("_c"))).alias(f"_c{at}") for at in range(len(lives))],
    ))
    own = wide.where(F.col("i") == F.col("j"))

    def variance(a: int) -> Column:
        return F.when(F.col(f"_c{a}").isNotNull(), F.greatest(F.col(f"_c{a}"), F.lit(0.0)))

    left = own.select("now", "i", *[variance(a).alias(f"_vi{a}") for a in range(len(lives))])
    right = own.select("now", F.col("i").alias("j"), *[variance(a).alias(f"_vj{a}") for a in range(len(lives))])
    width = own.groupBy("now").agg(F.count(F.lit(1)).alias("_p"))
    joined = wide.join(left, ["now", "i"]).join(right, ["now", "j"]).join(width, "now")
    total = None
    for vol, cor in halflife_pairs:
        v, c = lives.index(vol), lives.index(cor)
        scale = F.sqrt(F.col(f"_vi{c}")) * F.sqrt(F.col(f"_vj{c}"))
        raw = F.when(scale > 0, F.col(f"_c{c}") / F.when(scale > 0, scale)).otherwise(0.0)
        correlation = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0)))
        term = correlation * F.sqrt(F.col(f"_vi{v}")) * F.sqrt(F.col(f"_vj{v}"))
        total = term if total is None else total + term
    blended = F.when(F.col("_p") == 1, F.col("_plain")).otherwise(total / len(halflife_pairs))
    return _named(joined, blended).where(F.col("cov").isNotNull())


def cov_excess(panel, calendar, pool, benchmark: DataFrame, estimator=cov_sample, **parameters) -> DataFrame:
    """An estimator over returns less the benchmark's; ``benchmark`` is (date, benchmark)."""
    return estimator(panel, calendar, pool, benchmark=benchmark, **parameters)


def cov_realized(panel, calendar, pool, lookforward: Offset, estimator=cov_sample, **parameters) -> DataFrame:
    """An estimator over a window that reaches past the date; for evaluation only."""
    return estimator(panel, calendar, pool, lookforward=lookforward, **parameters)


def cov_empirical(
    panel, calendar, pool, lookback=QUARTER, lag=Offset(), min_coverage=0.8, use_log_returns=True, **window
) -> DataFrame:
    """Maximum-likelihood covariance of the complete cases."""
    rows = _complete(panel, calendar, pool, lookback, lag, min_coverage, use_log_returns, **window)
    return _named(gram(rows, center=True), _population())


def _population() -> Column:
    return (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.col("n")


def _shrunk(sample: DataFrame, shrinkage: DataFrame) -> DataFrame:
    """(1 - s) S + s mu I with per-date s and mu."""
    joined = sample.join(shrinkage.select("now", "_s", "_mu"), "now")
    target = F.when(F.col("i") == F.col("j"), F.col("_s") * F.col("_mu")).otherwise(0.0)
    return _named(joined, (1 - F.col("_s")) * F.col("_cov") + target)


def _moments(sample: DataFrame) -> DataFrame:
    """Per date: assets, rows, trace and sum of squares of the sample matrix."""
    diagonal = F.when(F.col("i") == F.col("j"), F.col("_cov"))
    return sample.groupBy("now").agg(
        F.count(diagonal).alias("_p"),
        F.max("n").alias("_n"),
        F.sum(diagonal).alias("_trace"),
        # a pair of different names stands for two cells
        F.sum(F.col("_cov") * F.col("_cov") * F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)).alias("_squares"),
    )


def cov_oas(panel, calendar, pool, lookback=QUARTER, lag=Offset(), min_coverage=0.8, **window) -> DataFrame:
    """Oracle-approximating shrinkage towards a scaled identity."""
    rows = _complete(panel, calendar, pool, lookback, lag, min_coverage, False, **window)
    sample = cut_lineage(gram(rows, center=True).withColumn("_cov", _population()))
    p, mean = F.col("_p"), F.col("_trace") / F.col("_p")
    alpha = F.col("_squares") / (p * p)
    top, below = alpha + mean * mean, (F.col("_n") + 1) * (alpha - mean * mean / p)
    share = F.when(below == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(top, below)))
    return _shrunk(sample, _moments(sample).select("now", share.alias("_s"), mean.alias("_mu")))


def cov_ledoit_wolf(panel, calendar, pool, lookback=QUARTER, lag=Offset(), min_coverage=0.8, **window) -> DataFrame:
    """Linear shrinkage with the optimal intensity.

    The sum over all pairs of the products of squares equals the squared row
    norms summed over the rows, which needs no pairs.
    """
    rows = _complete(panel, calendar, pool, lookback, lag, min_coverage, False, **window)
    sample = cut_lineage(gram(rows, center=True).withColumn("_cov", _population()))
    centered = with_group_totals(rows, ["now", "asset"], _mean=F.avg("value"))
    off = F.col("value") - F.col("_mean")
    norms = centered.groupBy("now", "rpos").agg(F.sum(off * off).alias("_q"))
    fourth = norms.groupBy("now").agg(F.sum(F.col("_q") * F.col("_q")).alias("_fourth"))
    per_date = _moments(sample).join(fourth, "now")
    p, n, squares = F.col("_p"), F.col("_n"), F.col("_squares")
    mean = F.col("_trace") / p
    beta = (F.col("_fourth") / n - squares) / (p * n)
    delta = (squares - 2 * mean * F.col("_trace") + p * mean * mean) / p
    capped = F.least(beta, delta)
    share = F.when(capped == 0, 0.0).otherwise(F.coalesce(F.try_divide(capped, delta), F.lit(0.0)))
    return _shrunk(sample, per_date.select("now", share.alias("_s"), mean.alias("_mu")))


def annualize_cov(cov: DataFrame, factor: float = 252) -> DataFrame:
    return cov.withColumn("cov", F.col("cov") * factor)
