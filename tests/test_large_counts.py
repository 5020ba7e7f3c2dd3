"""Statistics over counts whose cubes do not fit a long."""

from pyspark.sql import functions as F

from arborix.operators import stats


def test_wilcoxon_of_two_million_cases(spark):
    n = 2_000_000
    cases = spark.range(n).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("method"), F.col("id").alias("case_id"))
    # all differences are different, and every fifth is the other way round
    scores = cases.withColumn("score", F.when(F.col("method") == 2, 0.0).otherwise(F.when(F.col("case_id") % 5 == 0, -1.0).otherwise(1.0) * (F.col("case_id") + 1)))
    r = stats.wilcoxon_pairs(scores).where("method_1 = 1 AND method_2 = 2").first()
    minus = sum(range(1, n + 1, 5))
    assert (r.n, r.w_minus, r.w_plus) == (n, minus, n * (n + 1) // 2 - minus) and r.p_value == 0.0
    assert stats.multiple_wilcoxon(scores).where("reject").count() == 2


def test_wilcoxon_of_one_large_tie(spark):
    n = 2_200_000  # its cube is over the largest long
    cases = spark.range(n).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("method"), F.col("id").alias("case_id"))
    scores = cases.withColumn("score", F.when(F.col("method") == 2, 0.0).otherwise(F.when(F.col("case_id") % 2 == 0, -1.0).otherwise(1.0)))
    r = stats.wilcoxon_pairs(scores).where("method_1 = 1 AND method_2 = 2").first()
    assert (r.n, r.w_plus, r.w_minus) == (n, n * (n + 1) / 4, n * (n + 1) / 4) and abs(r.p_value - 1) < 1e-7
