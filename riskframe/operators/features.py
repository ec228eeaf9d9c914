"""Feature preparation: splits, one-hot encoding, standardisation, assembly."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.hashing import unit_hash
from ..session import cut_lineage, read_once
from .cleaning import long_values, params_of
from .running import join_on, running_totals

def split_label(u, bounds=config.SPLIT_BOUNDS):
    lo, hi = bounds
    return F.when(u < lo, "train").when(u < hi, "validation").otherwise("test")


def hash_split(df: DataFrame, key: str = config.ID_COL, salt: int = config.SPLIT_SALT,
               bounds=config.SPLIT_BOUNDS, out: str = "dataset") -> DataFrame:
    """80/10/10 split from a keyed hash: independent of partitioning and reruns."""
    return df.withColumn(out, split_label(unit_hash(key, salt), bounds))


def stratified_split(df: DataFrame, label: str = config.TARGET_COL, key: str = config.ID_COL,
                     salt: int = config.SPLIT_SALT, bounds=config.SPLIT_BOUNDS,
                     out: str = "dataset") -> DataFrame:
    """Split each class by its own hash order: percent_rank within the label.

    percent_rank = (rank - 1) / (n - 1) with rank over the hash within the
    class; a NULL label is a class, repeated rows stay.  The global per-class
    order runs through bucketed running counts, so no class is sorted in a
    single task, and a class's size comes with its bucket offsets.
    """
    h = df.withColumn("_u", unit_hash(key, salt))
    counts = h.groupBy(label, "_u").agg(F.count(F.lit(1)).alias("_n"))
    cum = running_totals(counts, [label], "_u", ["_n"], totals_prefix="_all")
    ranked = cum.select(label, "_u", F.coalesce(F.try_divide((F.col("cum__n") - F.col("_n")).cast("double"),
                                                             (F.col("_all_n") - 1).cast("double")), F.lit(0.0)).alias("_pr"))
    j = join_on(h, ranked, [label, "_u"])
    return j.withColumn(out, split_label(F.col("_pr"), bounds)).select(*df.columns, out)


def fit_levels(fit_df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: sorted array of the levels of each categorical column."""
    return fit_df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def known_levels(src: DataFrame, columns: list[str], max_levels: int = 10_000) -> dict[str, list[str]]:
    """Each column's levels in byte order, or an error beyond ``max_levels`` of one."""
    # collect_set buffers every level: bound the distinct counts first (HyperLogLog).
    ndv = src.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in columns]).first().asDict()
    wide = [c for c in columns if (ndv[c] or 0) > max_levels]
    if wide:
        raise ValueError(f"{wide}: more than {max_levels} levels; not categorical columns")
    row = fit_levels(src, columns).first()
    return {c: list(row[c] or []) for c in columns}


def one_hot(df: DataFrame, columns: list[str], fit_df: DataFrame | None = None,
            levels: dict[str, list[str]] | None = None, keep: list[str] | None = None,
            max_levels: int = 10_000) -> DataFrame:
    """One 0/1 double per level, named ``<col>_<level>``, levels in byte order.

    Every level is kept (no dropped base level).  Unknown levels at transform
    time give all zeros.  Each level is a column of the plan, so the distinct
    levels are fetched once to the driver, never row data; a column with more
    than ``max_levels`` of them raises an error instead of being cut.
    """
    if levels is None:
        levels = known_levels(fit_df if fit_df is not None else df, columns, max_levels)
    keep = [c for c in df.columns if c not in columns] if keep is None else keep
    encoded = [F.when(F.col(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}")
               for c in columns for v in levels[c]]
    return df.select(*keep, *encoded)


def encoded_names(columns: list[str], levels: dict[str, list[str]]) -> list[str]:
    return [f"{c}_{v}" for c in columns for v in levels[c]]


def fit_index(fit_df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level, index): each column's non-null levels numbered from 0 in byte order.

    A table: its levels are counted and numbered on the executors, however many.
    """
    levels = long_values(fit_df, columns, "string").where(F.col("value").isNotNull()).select("column", F.col("value").alias("level")).distinct()
    ranked = running_totals(levels.withColumn("_one", F.lit(1)), ["column"], "level", ["_one"])
    return cut_lineage(ranked.select("column", "level", (F.col("cum__one") - 1).alias("index")))


def index_sizes(index: DataFrame, columns: list[str]) -> dict[str, int]:
    """Levels of each column; a column without any is left out."""
    n = {r["column"]: r["n"] for r in index.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}   # a row a column
    return {c: n[c] for c in columns if c in n}


def vector_positions(index: DataFrame, columns: list[str], n_numeric: int = 0) -> DataFrame:
    """(position, column, level): what each entry of ``encode_sparse``'s vector behind the numeric ones stands for."""
    at, out = n_numeric, F.lit(None).cast("long")
    for c, n in index_sizes(index, columns).items():
        out = F.when(F.col("column") == c, F.lit(at).cast("long")).otherwise(out)
        at += n
    return index.select((out + F.col("index")).alias("position"), "column", "level").where(F.col("position").isNotNull())


def encode_sparse(df: DataFrame, columns: list[str], index: DataFrame, numeric: list[str] = (), out: str = "features") -> DataFrame:
    """``df`` with a vector of its numeric columns and a 1 at each categorical's level.

    The levels are joined from ``fit_index``'s table (Spark broadcasts it under
    its own threshold, else both sides are shuffled and a hot level is split by
    the adaptive join), so neither the plan nor the driver grows with them.  A
    NULL or unknown level has no entry, as zeros in ``one_hot``; a NULL number is
    an error.  Columns of ``df`` stay as they are, whatever their names.
    """
    sizes = index_sizes(index, columns)
    taken = set(df.columns)

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        taken.add(name)
        return name

    keep, at, hot = df.columns, {}, {}
    for c, n in sizes.items():
        level, at[c], hot[c] = free(f"_level_{c}"), free(f"_index_{c}"), free(f"_hot_{c}")
        own = index.where(F.col("column") == c).select(F.col("level").alias(level), F.col("index").cast("double").alias(at[c]))
        df = df.join(own, F.col(c).cast("string") == F.col(level), "left").drop(level)
        df = df.withColumn(at[c], F.coalesce(at[c], F.lit(float(n))))         # beyond the last level: dropped by the encoder
    if sizes:
        last = df.sparkSession.createDataFrame([tuple(float(n - 1) for n in sizes.values())], [at[c] for c in sizes])
        encoder = OneHotEncoder(inputCols=list(at.values()), outputCols=list(hot.values()), dropLast=True, handleInvalid="keep")
        df = encoder.fit(last).transform(df)
    df = VectorAssembler(inputCols=[*numeric, *hot.values()], outputCol=out, handleInvalid="error").transform(df)
    return df.select(*keep, out)


def fit_scaler(fit_df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population std per column (sklearn StandardScaler)."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return fit_df.agg(*aggs)


def standardize(df: DataFrame, columns: list[str], fit_df: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std with std 0 replaced by 1; fitted on ``fit_df`` only."""
    p = params_of(fit_scaler(fit_df if fit_df is not None else df, columns))
    out = {}
    for c in columns:
        mean, sd = p[f"{c}__mean"], p[f"{c}__std"]
        if mean is None:
            continue
        out[c] = (F.col(c) - F.lit(float(mean))) / F.lit(1.0 if not sd else float(sd))
    return df.withColumns(out)


class PrepModel:
    """Fitted cleaning + scaling parameters (a few numbers per column)."""

    def __init__(self, medians: dict, modes: dict, scaler: dict, categoricals: list[str], scaled: list[str],
                 levels: dict[str, list[str]] | None = None):
        self.medians, self.modes, self.scaler = medians, modes, scaler
        self.categoricals, self.scaled = categoricals, scaled
        # Training levels of the categoricals (one-hot vocabulary), if the fit
        # was asked for them; None means ``encode`` fits them apart.
        self.levels = levels

    def encode(self, prepared_df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
        """One-hot block on a transformed frame, levels from the training rows."""
        known = self.levels if self.levels is not None and all(c in self.levels for c in columns) else None
        return one_hot(prepared_df, columns, fit_df=prepared_df.where(F.col("dataset") == "train"),
                       levels=known, keep=keep)

    def clean(self, df: DataFrame) -> DataFrame:
        """Impute and log-scale an already renamed frame."""
        from .cleaning import apply_fill, log_transform
        df = apply_fill(df, self.medians, [c for c in config.NUMERIC_COLS if c in df.columns])
        df = apply_fill(df, self.modes, self.categoricals)
        return log_transform(df).withColumns({c: F.col(c).cast("double") for c in self.scaled})

    def transform(self, raw: DataFrame) -> DataFrame:
        """Map-only: works on batch and streaming frames alike."""
        from .cleaning import drop_columns, rename_columns
        df = self.clean(with_split(drop_columns(rename_columns(raw))))
        out = {}
        for c in self.scaled:
            mean, sd = self.scaler.get(f"{c}__mean"), self.scaler.get(f"{c}__std")
            if mean is not None:
                out[c] = (F.col(c) - F.lit(float(mean))) / F.lit(1.0 if not sd else float(sd))
        return df.withColumns(out).select("id", "dataset", "status", *self.scaled, *self.categoricals)


def with_split(df: DataFrame) -> DataFrame:
    return df.withColumn("dataset", split_label(unit_hash("id", config.SPLIT_SALT)))


def fit_prep(raw: DataFrame, categoricals: list[str] | None = None, approx: bool = False, levels: bool = False) -> PrepModel:
    """Fit imputers, then the scaler (and the categoricals' levels), on the training split of a batch raw table."""
    from .cleaning import drop_columns, fit_imputers, rename_columns
    cats = config.FIXTURE_CATEGORICALS if categoricals is None else categoricals
    df = with_split(drop_columns(rename_columns(raw)))
    nums = [c for c in config.NUMERIC_COLS if c in df.columns]
    scaled = [c for c in config.SCALED_COLS if c in df.columns]
    # Several fits scan the training rows: read them once, as Spark ML
    # estimators do with their input; released when fitting is done.
    columns = list(dict.fromkeys([*nums, *scaled, *cats]))
    with read_once(df.where(F.col("dataset") == "train").select(*columns)) as train:
        medians, modes = fit_imputers(train, nums, cats, approx)
        clean = PrepModel(medians, modes, {}, cats, scaled).clean(train)
        scaler = params_of(fit_scaler(clean, scaled))
        known = known_levels(clean, cats) if levels else None
    return PrepModel(medians, modes, scaler, cats, scaled, known)


def prepared_encoded(raw: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Prepared table with the one-hot block, its levels from the same kept training rows."""
    model = fit_prep(raw, levels=True)
    return model.encode(model.transform(raw), columns, keep)


def prepared(raw: DataFrame, categoricals: list[str] | None = None) -> DataFrame:
    """Model input: split, clean (fit on train), standardise (fit on train).

    Keeps categoricals as strings; ``one_hot`` adds the encoded block.
    Columns: id, dataset, status, scaled numerics + year, categoricals.
    """
    return fit_prep(raw, categoricals).transform(raw)
