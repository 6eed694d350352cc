"""Full periodicity analysis: three tests, step-down adjustment and claim, for all variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.operators import hypotheses as hy
from gapspark.operators import periodicity as pe
from gapspark.operators.ordered import join_on
from gapspark.session import materialize

BANDS = {"7d": (7.0, 0.5), "24d": (24.0, 1.0)}


def periodicity_claims(
    daily: DataFrame, variants: dict[str, tuple[list[str], str]], start: str,
    n_perm: int = pe.N_PERM, seed: int = pe.SEED, alpha: float = pe.ALPHA,
) -> DataFrame:
    """A claim needs an adjusted p below alpha; for weekdays also a large enough effect."""
    keys = ["variant"]
    resid = materialize(pe.detrended(pe.variant_series(pe.log_series(daily), variants, start)), "residuals")
    arrays = materialize(pe.as_arrays(resid, keys), "series")
    weekday = pe.weekday_permutation_test(arrays, keys, n_perm, seed)
    bands = pe.periodicity_test(arrays, keys, BANDS, n_perm, seed, pe.ar1_fit(resid, keys))
    both = join_on(weekday.select(*keys, "n_days", "H", "eps2", F.col("p").alias("p_weekday")), bands.drop("n_days"), keys)
    tests = both.select(*keys, "eps2", F.inline(F.array(*[
        F.struct(F.lit(t).alias("test"), F.col(f"p_{t}").alias("p_value")) for t in ("weekday", *BANDS)])))
    adjusted = hy.holm(tests, keys, tie=["test"])
    claim = (F.col("p_holm") < alpha) & ((F.col("test") != "weekday") | (F.col("eps2") >= pe.EPS2_FLOOR))
    verdict = adjusted.groupBy(*keys).agg(
        *[F.max(F.when(F.col("test") == t, F.col("p_holm"))).alias(f"p_holm_{t}") for t in ("weekday", *BANDS)],
        F.bool_or(claim).alias("claim_periodicity"))
    return join_on(both, verdict, keys)
