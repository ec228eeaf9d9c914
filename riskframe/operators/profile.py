"""Profiling of a table: the numbers behind each exploratory chart.

Every operator is one or two aggregate passes over the whole table; the
unpivot-to-long form (column, value) lets one ``groupBy("feature")`` cover
all columns at once, with partial aggregation before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, read_once
from . import gram
from .metrics import histogram_bins
from .running import join_on, quantiles_wide, top_k_per_group


def long_form(df: DataFrame, columns: list[str], value_type: str = "double", extra: list[str] | None = None) -> DataFrame:
    """(extra..., column, value) with one row per input row and column."""
    extra = extra or []
    return df.select(*extra, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast(value_type).alias("value")) for c in columns
    ])).alias("_kv")).select(*extra, "_kv.feature", "_kv.value")


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_numeric(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 % (linear), max per numeric column."""
    basic = [F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
             F.min("value").alias("min"), F.max("value").alias("max")]
    with read_once(df.select(*columns)) as kept:
        q = quantiles_wide(long_form(kept, columns), ["feature"], "value", QUARTILES, approx=approx, small=True, extra_aggs=basic)
    return q.select("feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count, percent) over non-null values; percent of the non-null total."""
    lf = long_form(df, columns, "string").where(F.col("value").isNotNull())
    counts = lf.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("feature").agg(F.sum("count").alias("_total"))
    return join_on(counts, totals, ["feature"], small=True).select(
        "feature", "value", "count", (F.col("count") * 100.0 / F.col("_total")).alias("percent"))


def top_categories(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """The ``k`` most frequent values of each column (ties: smaller value first)."""
    lf = long_form(df, columns, "string").where(F.col("value").isNotNull())
    counts = lf.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))
    return top_k_per_group(counts, ["feature"], [F.col("count").desc(), F.col("value").asc()], k, "value")


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing_count, missing_percent rounded to 2 dp) from one wide aggregate."""
    columns = columns or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_count"),
                 F.round(F.try_divide(F.col(c) * 100.0, F.col("_n")), 2).alias("missing_percent"))
        for c in columns])).alias("m")).select("m.*")


def missing_patterns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows grouped by which columns are missing: pattern string of 0/1 flags in column order."""
    columns = columns or df.columns
    pattern = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("count"))


def table_overview(df: DataFrame) -> DataFrame:
    """Schema with non-null counts: (column, position, data_type, non_null, rows)."""
    fields = df.schema.fields
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f.name)).alias(f"_c{i}") for i, f in enumerate(fields)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("feature"), F.lit(i).alias("position"),
                 F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"_c{i}").alias("non_null"),
                 F.col("_n").alias("rows"))
        for i, f in enumerate(fields)])).alias("o")).select("o.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long (row_feature, col_feature, corr) of every pair of columns, pairwise complete.

    Masked Gram matrices (``gram``): a task returns one row a pair, so the
    shuffle carries pairs x tasks rows, and the work grows with rows x columns.
    A pair without common rows, or a table without rows, gives NULL; a NaN gives
    NaN in its column's pairs.
    """
    kept = cut_lineage(df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))
    names = [f"x{i}" for i in range(len(columns))]
    pairs = kept.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("i")).select(
        "i", F.explode(F.sequence("i", F.lit(len(columns) - 1))).alias("j"))            # also those without common rows
    return gram.correlations(pairs.join(gram.pair_moments(kept, names), ["i", "j"], "left"), columns)


def target_correlation(corr: DataFrame, targets: list[str]) -> DataFrame:
    """Correlations against each target, ranked descending (NULL last, then by name)."""
    t = corr.where(F.col("col_feature").isin(targets)).select(
        F.col("col_feature").alias("target"), F.col("row_feature").alias("feature"), "corr")
    w = Window.partitionBy("target").orderBy(F.col("corr").desc_nulls_last(), F.col("feature"))
    return t.withColumn("rank", F.row_number().over(w))


def histogram_fixed(df: DataFrame, columns: list[str], n_bins: int = 10) -> DataFrame:
    return histogram_bins(long_form(df, columns), ["feature"], "value", n_bins)


def histogram_auto(df: DataFrame, columns: list[str]) -> DataFrame:
    """numpy 'auto' bins: width = min(Freedman-Diaconis, Sturges), bins over [min, max].

    Per column: n, range and exact IQR -> bin count -> bins exploded per
    column -> counts; the last bin is closed.
    """
    lf = long_form(df, columns).where(F.col("value").isNotNull())
    with read_once(df.select(*columns)) as kept:
        s = quantiles_wide(long_form(kept, columns), ["feature"], "value", {"q25": 0.25, "q75": 0.75}, small=True, extra_aggs=[
            F.count("value").alias("n"), F.min("value").alias("mn"), F.max("value").alias("mx")])
    s = s.where(F.col("n") > 0)
    ptp = F.col("mx") - F.col("mn")
    sturges = ptp / (F.log(F.col("n").cast("double")) / F.lit(math.log(2.0)) + 1.0)
    fd = F.lit(2.0) * (F.col("q75") - F.col("q25")) * F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3.0))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    nb = F.when(width > 0, F.ceil(ptp / width)).otherwise(F.lit(1)).cast("int")
    s = s.select("feature", F.when(ptp == 0, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                 F.when(ptp == 0, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"),
                 F.when(ptp == 0, F.lit(1)).otherwise(nb).alias("n_bins"))
    binned = join_on(lf, s, ["feature"], small=True).withColumn(
        "bin", F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("n_bins")),
                       F.col("n_bins") - 1).cast("int"))
    counts = binned.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = s.select("feature", "lo", "hi", "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / F.col("n_bins").cast("double")
    grid = grid.select("feature", "bin", "n_bins", (F.col("lo") + F.col("bin") * w).alias("bin_lo"),
                       (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"))
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", "n_bins", "bin_lo", "bin_hi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def density(df: DataFrame, columns: list[str], grid_points: int = 200, fine_bins: int = 1024) -> DataFrame:
    """Gaussian kernel density per column, Scott bandwidth h = std * n^(-1/5).

    Linear-binned KDE: values are first counted into ``fine_bins`` equal bins
    (one aggregate), then each non-empty bin's weight is spread over the
    evaluation grid (grid from min - range/2 to max + range/2, as the chart
    uses).  Cost after the first pass is bins x grid per column, whatever the
    row count.  Rows: (column, point, x, density).
    """
    lf = long_form(df, columns).where(F.col("value").isNotNull())
    st = lf.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("mn"),
                                  F.max("value").alias("mx"), F.stddev_samp("value").alias("sd"))
    B = float(fine_bins)
    binned = join_on(lf, st, ["feature"], small=True).withColumn(
        "b", F.when(F.col("mx") == F.col("mn"), F.lit(0)).otherwise(
            F.least(F.floor((F.col("value") - F.col("mn")) / (F.col("mx") - F.col("mn")) * B), F.lit(fine_bins - 1))))
    w = binned.groupBy("feature", "b").agg(F.count(F.lit(1)).alias("cnt"))
    st = st.select("feature", "n", "mn", "mx",
                   (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
                   (F.col("mx") - F.col("mn")).alias("rng"))
    centers = join_on(w, st, ["feature"], small=True).select(
        "feature", "cnt", "n", "h", "mn", "mx", "rng",
        (F.col("mn") + (F.col("b") + 0.5) * (F.col("rng") / B)).alias("c"))
    g = float(grid_points - 1)
    pts = centers.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("point"))
    x = (F.col("mn") - 0.5 * F.col("rng")) + F.col("point") * (2.0 * F.col("rng") / g)
    z = (x - F.col("c")) / F.col("h")
    contrib = F.col("cnt") * F.exp(-0.5 * z * z)
    pts = pts.withColumn("x", x).withColumn("k", contrib)
    agg = pts.groupBy("feature", "point", "x").agg(F.sum("k").alias("_s"), F.first("n").alias("n"), F.first("h").alias("h"))
    return agg.select("feature", "point", "x",
                      F.try_divide(F.col("_s"), F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))).alias("density"))


def box_stats(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Quartiles, whiskers (extreme values inside 1.5 IQR fences) and outlier counts."""
    lf = long_form(df, columns).where(F.col("value").isNotNull())
    with read_once(df.select(*columns)) as kept:
        q = quantiles_wide(long_form(kept, columns).where(F.col("value").isNotNull()), ["feature"], "value",
                           {"q1": 0.25, "median": 0.5, "q3": 0.75}, approx=approx, small=True)
    q = q.select("*", (F.col("q3") - F.col("q1")).alias("iqr"))
    q = q.select("*", (F.col("q1") - 1.5 * F.col("iqr")).alias("lower_fence"),
                 (F.col("q3") + 1.5 * F.col("iqr")).alias("upper_fence"))
    v, lo, hi = F.col("value"), F.col("lower_fence"), F.col("upper_fence")
    agg = join_on(lf, q.select("feature", "lower_fence", "upper_fence"), ["feature"], small=True).groupBy("feature").agg(
        F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.count_if((v < lo) | (v > hi)).alias("n_outliers"))
    return join_on(q, agg, ["feature"], small=True).select("feature", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
                                        "whisker_low", "whisker_high", "n_outliers")


def group_quartiles(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Per group of ``group``: quartiles, min, max and count of ``measure`` (violin inner lines)."""
    d = df.select(F.col(group).alias("group"), F.col(measure).cast("double").alias("value")).where(
        F.col("value").isNotNull())
    with read_once(d) as kept:
        q = quantiles_wide(kept, ["group"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, extra_aggs=[
            F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("count")])
    return q.select("group", "q1", "median", "q3", "min", "max", "count")


def grid_density(df: DataFrame, pairs: list[tuple[str, str]], label: str, n_bins: int = 10) -> DataFrame:
    """2-D binned counts per label for each (x, y) pair over rows where both are present."""
    lf = df.select(label, F.explode(F.array(*[
        F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in pairs])).alias("_p")).select(F.col(label).alias("label"), "_p.*")
    lf = lf.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    r = lf.groupBy("pair").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                               F.max("y").alias("y1"))

    def b(v, lo, hi):
        return F.when(F.col(hi) == F.col(lo), F.lit(0)).otherwise(
            F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * n_bins), F.lit(n_bins - 1))).cast("int")

    return join_on(lf, r, ["pair"], small=True).groupBy("pair", "label", b("x", "x0", "x1").alias("bx"), b("y", "y0", "y1").alias("by")) \
        .agg(F.count(F.lit(1)).alias("count"))
