"""Loss values and schedules over pair vectors, as joins within batches of bounded size and plain aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import vector as V


def _batch_scores(pairs: DataFrame, temperature: float) -> DataFrame:
    """(batch_id, i, j, logit) of every anchor with every positive of its batch."""
    a = pairs.select("batch_id", F.col("pair_id").alias("i"), V.l2_normalise(F.col("anchor")).alias("a"))
    p = pairs.select("batch_id", F.col("pair_id").alias("j"), V.l2_normalise(F.col("positive")).alias("p"))
    return a.join(p, "batch_id").select("batch_id", "i", "j", (V.dot(F.col("a"), F.col("p")) / temperature).alias("logit"))


def infonce(pairs: DataFrame, temperature: float = 0.05, masked: DataFrame | None = None) -> DataFrame:
    """(batch_id, loss): symmetric in-batch contrastive loss; pairs has batch_id, pair_id, anchor, positive vectors, masked (batch_id,
    i, j) the candidates that do not count. A row with one candidate adds 0. No extra negatives."""
    s = _batch_scores(pairs, temperature)
    if masked is not None:
        s = s.join(masked.select("batch_id", "i", "j"), ["batch_id", "i", "j"], "left_anti")
    sides = s.select("batch_id", F.col("i").alias("row"), F.lit("a").alias("side"), "logit", (F.col("i") == F.col("j")).alias("own")).unionByName(s.select("batch_id", F.col("j").alias("row"), F.lit("p").alias("side"), "logit", (F.col("i") == F.col("j")).alias("own")))
    # cosines are bounded, so 1 / temperature is a shift that keeps the exponentials small
    shift = 1.0 / temperature
    rows = sides.groupBy("batch_id", "side", "row").agg((F.log(F.sum(F.exp(F.col("logit") - shift))) + shift - F.max(F.when(F.col("own"), F.col("logit")))).alias("l"))
    return rows.groupBy("batch_id").agg((F.sum("l") / F.count("*")).alias("loss"))


def cosent(pairs: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(batch_id, loss) = log(1 + sum over pairs with a higher gold score of exp((cos_l - cos_k) / temperature)); pairs has batch_id,
    pair_id, cosine, score."""
    k = pairs.select("batch_id", F.col("cosine").alias("ck"), F.col("score").alias("yk"))
    l = pairs.select("batch_id", F.col("cosine").alias("cl"), F.col("score").alias("yl"))
    terms = k.join(l, "batch_id").withColumn("t", F.when(F.col("yk") > F.col("yl"), F.exp((F.col("cl") - F.col("ck")) / temperature)))
    return terms.groupBy("batch_id").agg(F.log1p(F.coalesce(F.sum("t"), F.lit(0.0))).alias("loss"))


def regression(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("batch_id").agg(F.avg((F.col("cosine") - F.col("score")) * (F.col("cosine") - F.col("score"))).alias("loss"))


def matryoshka(pairs: DataFrame, dims: list[int], temperature: float = 0.05) -> DataFrame:
    """(batch_id, loss): the mean contrastive loss over prefix dimensions."""
    out = None
    for d in dims:
        part = infonce(pairs.withColumns({"anchor": V.prefix(F.col("anchor"), d), "positive": V.prefix(F.col("positive"), d)}), temperature)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("batch_id").agg(F.avg("loss").alias("loss"))


def learning_rate(step: Column, total: int, rate: float = 5e-4, warm_up: float = 0.1) -> Column:
    """Linear warm-up, then half a cosine to 0."""
    warm = int(warm_up * total)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - warm) / F.lit(float(max(1, total - warm)))))
    return F.when(step < warm, F.lit(rate) * (step + 1) / F.lit(float(max(1, warm)))).otherwise(F.lit(rate) * 0.5 * (1 + F.cos(F.lit(math.pi) * t)))
