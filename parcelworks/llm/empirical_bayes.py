"""What the empirical-Bayes operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strength(children: DataFrame) -> float:
    """Pseudo-counts of the beta-binomial prior between a level and the one above, by moments: the spread
    of the children's rates round their parents' means beyond what binomial noise explains. Reads (n, hits,
    mean); returns one number, 2 at least and 1,000 at most (that if there is no such spread)."""
    rate = F.col("hits") / F.col("n")
    noise = F.col("mean") * (1 - F.col("mean"))
    sums = children.where((F.col("n") > 0) & (noise > 0)).agg(
        F.sum(F.col("n") * (rate - F.col("mean")) ** 2), F.sum(noise), F.sum(F.col("n") * noise)
    )
    spread, base, weighted = (float(x or 0) for x in sums.first())
    # E[n (rate - mean)^2] = noise * (1 + (n - 1) rho), rho = 1 / (strength + 1)
    extra = weighted - base
    rho = (spread - base) / extra if extra > 0 else 0.0
    return min(1000.0, max(2.0, 1 / rho - 1)) if rho > 0 else 1000.0


def shrunk(children: DataFrame) -> tuple[DataFrame, float]:
    """``children`` (n, hits, mean of the level above) with ``posterior``, their own shrunken rate; and the strength."""
    s = strength(children)
    return children.withColumn("posterior", (F.col("hits") + s * F.col("mean")) / (F.col("n") + s)), s


def global_mean(level: DataFrame) -> float:
    """Rate over all of a level, with one hit and one miss more."""
    n, hits = level.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("hits"), F.lit(0))).first()
    return (float(hits) + 1) / (float(n) + 2)
