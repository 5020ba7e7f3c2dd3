"""Histograms, ranks and significance tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import ranked, ranked_within


def histogram(values: DataFrame, value: str, bins: int = 20, keys: list[str] = (), lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(keys, bin, n): equal bins over a range, by default each key's own; the last bin is closed, empty bins have 0."""
    keys = list(keys)
    v = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    ends = v.groupBy(*keys).agg((F.min("v") if lo is None else F.first(F.lit(float(lo)))).alias("lo"), (F.max("v") if hi is None else F.first(F.lit(float(hi)))).alias("hi"))
    j = v.join(ends, keys) if keys else v.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width))).cast("int")
    n = j.where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(n, [*keys, "bin"], "left").na.fill(0, ["n"])


def joint_histogram(values: DataFrame, a: str, b: str, bins: int = 20, keys: list[str] = ()) -> DataFrame:
    """(keys, bin_a, bin_b, n): square bins over each metric's range; empty ones are left out."""
    keys = list(keys)
    v = values.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ends = v.groupBy(*keys).agg(*(f(c).alias(f"_{n}{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))))
    j = v.join(ends, keys) if keys else v.crossJoin(F.broadcast(ends))
    at = lambda c: F.when(F.col(f"_hi{c}") == F.col(f"_lo{c}"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"_lo{c}")) / ((F.col(f"_hi{c}") - F.col(f"_lo{c}")) / bins)))).cast("int")
    return j.groupBy(*keys, at(a).alias("bin_a"), at(b).alias("bin_b")).agg(F.count("*").alias("n"))


def shared_ranges(branches: DataFrame, metrics: list[str], given: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """(metric, lo, hi) over all networks; a given end replaces the data's."""
    given = given or {}
    rows = branches.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("r")).select("r.*")
    out = rows.groupBy("metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    for i, end in enumerate(("lo", "hi")):
        set_to = [F.when(F.col("metric") == m, F.lit(float(g[i]))) for m, g in given.items() if g[i] is not None]
        out = out.withColumn(end, F.coalesce(*set_to, F.col(end)))
    return out


def holm(tests: DataFrame, alpha: float = 0.05, p: str = "p_value", step_down: bool = False, order: list[str] = ()) -> DataFrame:
    """tests with `threshold` alpha / (m - rank) and `reject`; with step_down a test is kept once a smaller p was kept."""
    placed = ranked(tests, [F.col(p).asc_nulls_last(), *order], "_k")
    out = placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("_all"))))  # one row
    out = out.withColumn("threshold", F.lit(alpha) / (F.col("_all") - F.col("_k"))).withColumn("reject", F.coalesce(F.col(p) < F.col("threshold"), F.lit(False)))
    if step_down:
        first = out.agg(F.min(F.when(~F.col("reject"), F.col("_k"))).alias("_first"))
        out = out.crossJoin(F.broadcast(first)).withColumn("reject", F.col("_k") < F.coalesce("_first", F.col("_all"))).drop("_first")
    return out.drop("_k", "_all")


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal at z >= 0 by a rational approximation, absolute error below 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


#: Differences up to which signed-rank tests are exact.
EXACT = 25


def exact_tail(n: str, low: Column) -> Column:
    """Twice the share of all subsets of the ranks 1 .. n whose sum is at most `low`: subsets are counted by their sums, rank after rank."""
    total = F.expr(f"int({n} * ({n} + 1) div 2)")
    none = F.transform(F.sequence(F.lit(0), total), lambda s: F.when(s == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    more = lambda c, k: F.transform(c, lambda x, s: x + F.when(s >= k, F.get(c, s - k)).otherwise(F.lit(0)))
    counts = F.aggregate(F.sequence(F.lit(1), F.col(n).cast("int")), none, more)
    under = F.aggregate(F.slice(counts, 1, low.cast("int") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return 2 * under / F.pow(F.lit(2.0), F.col(n))


def wilcoxon_pairs(scores: DataFrame, method: str = "method", case: str = "case_id", value: str = "score") -> DataFrame:
    """(method_1, method_2, n, w_plus, w_minus, p_value) of signed-rank tests of all ordered pairs of methods.

    Zero differences are dropped and ties have mean ranks. Up to EXACT differences without ties p is exact, by counting the subsets of the ranks with a sum of at most the
    smaller one; else it comes from the normal approximation with tie correction. Pairs of a method with itself have null. Differences are ranked within a pair of methods, whose rows a range sort spreads only by pair.
    """
    a = scores.select(F.col(method).alias("method_1"), F.col(case).alias("_c"), F.col(value).alias("_a"))
    b = scores.select(F.col(method).alias("method_2"), F.col(case).alias("_c"), F.col(value).alias("_b"))
    keys = ["method_1", "method_2"]
    pairs = a.select("method_1").distinct().crossJoin(b.select("method_2").distinct())  # methods are few
    # one direction is enough: the other has plus and minus exchanged
    d = a.join(b, "_c").where(F.col("method_1") < F.col("method_2")).select(*keys, (F.col("_a") - F.col("_b")).alias("d")).where("d <> 0")
    size = d.groupBy(*keys, F.abs("d").alias("m")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("plus"))
    below = F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = size.withColumn("rank", below + (F.col("t") + 1) / 2)
    s = ranked.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("plus"))).alias("w_minus"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    both = s.unionByName(s.select(F.col("method_2").alias("method_1"), F.col("method_1").alias("method_2"), "n", F.col("w_minus").alias("w_plus"), F.col("w_plus").alias("w_minus"), "ties"))
    n = F.col("n").cast("double")  # the cube of a count of two million does not fit a long
    mean = n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.abs(F.least("w_plus", "w_minus") - mean) / sd
    low = F.least("w_plus", "w_minus")
    p = F.when((F.col("n") <= EXACT) & (F.col("ties") == 0), exact_tail("n", low)).when(z.isNotNull(), 2 * normal_tail(z))
    return pairs.join(both, keys, "left").select(*keys, "n", "w_plus", "w_minus", F.when(p.isNotNull(), F.least(F.lit(1.0), p)).alias("p_value"))


def multiple_wilcoxon(scores: DataFrame, alpha: float = 0.05, **names) -> DataFrame:
    return holm(wilcoxon_pairs(scores, **names), alpha, order=["method_1", "method_2"])


#: Places of a series that one window holds, besides their neighbours.
RUN = 4096


def running_median(history: DataFrame, keys: list[str], order: str, value: str, size: int = 51, run: int = RUN) -> DataFrame:
    """history with the median of a centred window; beyond its ends a series goes on mirrored, its last value repeated.

    A series is cut into runs, which get the rows within reach of their ends besides, so no window holds a whole series.
    """
    half, rest = size // 2, size - 1 - size // 2
    rows = ranked_within(history, keys, [order], "_i", "_n")
    # a series of n has the period 2n: row i also stands at 2nk + i and 2nk - 1 - i
    turns = F.expr(f"sequence(-1 - {half} div (2 * _n), 1 + {half} div (2 * _n))")
    places = F.flatten(F.transform(turns, lambda k: F.array(2 * F.col("_n") * k + F.col("_i"), 2 * F.col("_n") * k - 1 - F.col("_i"))))
    wide = rows.withColumn("_at", F.explode(F.filter(places, lambda x: (x >= -half) & (x < F.col("_n") + half))))
    wide = wide.withColumn("_run", F.explode(F.sequence(F.floor((F.col("_at") - rest) / run), F.floor((F.col("_at") + half) / run))))
    w = Window.partitionBy(*keys, "_run").orderBy("_at").rowsBetween(-half, rest)
    middle = wide.withColumn("median", F.percentile(value, F.lit(0.5)).over(w))
    return middle.where(f"_at = _i AND _run = floor(_at / {run})").drop("_i", "_n", "_at", "_run")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip01(x: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), x))


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.when(b == 0, 1e-10).otherwise(b)


def diameter_of(distance: Column, scale: float = 100.0) -> Column:
    """Twice the distance to background, of a map that is held in parts of 1 / scale."""
    return 2 * distance / scale


def factor_pairs(n: Column) -> Column:
    """All (f, n / f) of a positive n: the factors up to its root, and theirs the other way round."""
    small = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.sqrt(n)).cast("int"))), lambda f: n % f == 0)
    pair = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    both = F.concat(F.transform(small, lambda f: pair(f, n / f)), F.transform(F.filter(small, lambda f: f * f != n), lambda f: pair(n / f, f)))
    return F.when(n >= 1, F.array_sort(both)).otherwise(F.slice(both, 1, 0))


def skeleton_strength(d: Column, most: Column, k: float = 2.0) -> Column:
    return F.pow((F.exp(d / most) - 1) / (F.exp(F.lit(1.0)) - 1), F.lit(k))


def eigen2(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Eigenvalues of [[a, b], [b, c]], the larger first."""
    mid, half = (a + c) / 2, F.sqrt(((a - c) / 2) ** 2 + b * b)
    return mid + half, mid - half


def principal_angle(a: Column, b: Column, c: Column) -> Column:
    """Angle of the principal axis of [[a, b], [b, c]], in [0, pi)."""
    t = 0.5 * F.atan2(2 * b, a - c)
    return F.when(t < 0, t + F.pi()).otherwise(t)


def eigen3(xx, yy, zz, xy, xz, yz) -> Column:
    """Eigenvalues of a symmetric 3 x 3 matrix in closed form, as an array sorted by absolute value."""
    q = (xx + yy + zz) / 3
    p1 = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * p1) / 6)
    a, b, c, d, e, f = ((xx - q), (yy - q), (zz - q), xy, xz, yz)
    det = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / (p * p * p)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    e1 = q + 2 * p * F.cos(phi)
    e3 = q + 2 * p * F.cos(phi + 2 * F.pi() / 3)
    three = F.when(p == 0, F.array(q, q, q)).otherwise(F.array(e1, 3 * q - e1 - e3, e3))
    return F.transform(F.array_sort(F.transform(three, lambda v: F.struct(F.abs(v).alias("k"), v.alias("v")))), lambda s: s["v"])


def vesselness(eigen: Column, alpha: float = 0.5, beta: float = 0.5, c: float = 15.0) -> Column:
    """Plate, blob and background factors of eigenvalues sorted by size; 0 where the second or third is positive."""
    l1, l2, l3 = eigen[0], eigen[1], eigen[2]
    ra, rb = safe_divide(F.abs(l2), F.abs(l3)), safe_divide(F.abs(l1), F.sqrt(F.abs(l2 * l3)))
    s = l1 * l1 + l2 * l2 + l3 * l3
    value = (1 - F.exp(-ra * ra / (2 * alpha * alpha))) * F.exp(-rb * rb / (2 * beta * beta)) * (1 - F.exp(-s / (2 * c * c)))
    return F.when((l2 > 0) | (l3 > 0), 0.0).otherwise(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)))


def least_known(df: DataFrame, value: str, place: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, place, value): where the least value is, of all rows or by key; the smallest place of equal values.

    Null and not-a-number are no values: a key that has nothing else has no row, and so has an empty table.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    least = known.groupBy(*keys).agg(F.min(F.struct(F.col(value).alias("_value"), *place)).alias("_m")).where("_m IS NOT NULL")
    return least.select(*keys, *(F.col(f"_m.{c}").alias(c) for c in place), F.col("_m._value").alias(value))
