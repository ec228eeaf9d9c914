"""Running totals and exact order statistics without a single-task window.

``Window.orderBy(x)`` with no partition key sends every row to one task.  The
helpers here range-partition (group, value), cut the order into runs, add the
offsets of the few groups that a boundary cuts, and run the window inside (run,
group) only.  The result is exact, whatever the boundaries.

Callers pre-aggregate so that the order column is unique within a group
(``groupBy(group, value).count``): duplicates, and with them hot keys,
collapse to one row before anything is shuffled by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, through_files

ROWS_PER_BUCKET = 1_000_000
RUNS_PER_TASK = 32             # runs that one task of the range partitioning sorts, at most
SKETCH_ACCURACY = 10000
WINDOW_ROWS = 100_000          # cells of a group that a window of the quantiles holds, at most
_ONE = "_one_group"


def _with_group(df: DataFrame, group_cols: list[str]) -> tuple[DataFrame, list[str]]:
    """A table without groups is one group keyed by a constant column."""
    if group_cols:
        return df, list(group_cols)
    return df.withColumn(_ONE, F.lit(0)), [_ONE]


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Equi-join in which NULL keys meet; ``left``'s keys stay.

    ``small`` broadcasts ``right``: only for a side whose rows are bounded by
    the call (one per column, per model and dataset, per class), not by the data.
    """
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(F.broadcast(right) if small else right, cond, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(df: DataFrame, group_cols: list[str], order_col: str, sum_cols: list[str],
                   descending: bool = False, n_buckets: int | None = None,
                   prefix: str = "cum_", materialize: bool = True,
                   totals_prefix: str | None = None) -> DataFrame:
    """Adds ``prefix+c``: inclusive running sum of each ``c`` along ``order_col``.

    ``order_col`` must be unique within each group and non-null; a NULL group
    is a group.  With ``materialize`` the input is checkpointed once to the
    shared checkpoint folder, which also cuts the lineage a lost executor would
    have to replay.  ``totals_prefix`` adds each group's whole sums as well.

    A prefix scan: beyond one bucket the rows are range-partitioned and sorted by
    (group, value) and cut into numbered runs, so only a run's first and last
    group can go on in another one.  Their offsets are a row a run, joined by the
    run's number: nothing is joined or windowed on a whole group.
    """
    if materialize:
        df = cut_lineage(df)
    # The input is materialised by now and cheap to count: about ROWS_PER_BUCKET rows per window task, however many.
    size = ROWS_PER_BUCKET
    if n_buckets is None or n_buckets > 1:
        rows = df.count()
        n_buckets = n_buckets or max(1, -(-rows // size))
        size = max(1, -(-rows // n_buckets))
    cols = df.columns
    df, groups = _with_group(df, group_cols)
    row_order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    if n_buckets > 1:
        # Runs of ``size`` rows within sorted range partitions.  The bounds come from a sample, so the
        # numbered rows are kept: both uses below must see the same runs.
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = df.repartitionByRange(max(min(n_buckets, width), n_buckets // RUNS_PER_TASK), *groups, row_order)
        ordered = ordered.sortWithinPartitions(*groups, row_order)
        run = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(size))
        part = F.shiftleft(F.spark_partition_id().cast("long"), 33) + run
        df = through_files(ordered.withColumn("_part", part), "prefix-scan")
        edges = _edges(df, groups, sum_cols)
        df = df.join(F.broadcast(edges) if n_buckets <= 1024 else edges, "_part")
        here = F.get(F.filter("_edges", lambda e: e["_g"].eqNullSafe(F.struct(*groups))), 0)
        df, keys = df.withColumn("_edge", here), ["_part", *groups]
    else:
        keys = groups
    w = Window.partitionBy(*keys).orderBy(row_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)

    def running(c):
        own = F.sum(c).over(w)
        return own if n_buckets == 1 else F.coalesce(F.col(f"_edge._o_{c}"), F.lit(0)) + own

    def total(c):
        own = F.sum(c).over(whole)
        return own if n_buckets == 1 else F.coalesce(F.col(f"_edge._w_{c}"), own)

    return df.select(*cols, *[running(c).alias(prefix + c) for c in sum_cols],
                     *[total(c).alias(f"{totals_prefix}{c}") for c in (sum_cols if totals_prefix else [])])


def _edges(parts: DataFrame, groups: list[str], sum_cols: list[str]) -> DataFrame:
    """A row a run: its first and last group, each with the group's sums before the run and its whole sums."""
    held = parts.groupBy("_part", F.struct(*groups).alias("_g")).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    one = F.struct("_g", *[f"_t_{c}" for c in sum_cols])
    ends = held.groupBy("_part").agg(F.min(one).alias("first"), F.max(one).alias("last"))
    cut = ends.select("_part", F.explode(F.array_distinct(F.array("first", "last"))).alias("e")).select("_part", "e.*")
    whole = Window.partitionBy("_g")            # a row for each run that the group reaches
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("_part", F.struct("_g", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
                                       *[F.sum(f"_t_{c}").over(whole).alias(f"_w_{c}") for c in sum_cols]).alias("e"))
    return cut.groupBy("_part").agg(F.collect_list("e").alias("_edges"))


def value_counts_long(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """(group, value, n) over non-null values: the pre-aggregation every order statistic starts from."""
    return (df.where(F.col(value_col).isNotNull())
              .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n")))


def exact_quantiles(long_df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                    small: bool = False, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Exact linear-interpolated quantiles per group, in two passes at every size.

    Returns (group..., prob, quantile), equal to numpy's default
    ``percentile`` and SQL ``quantile_cont``; NULL values are skipped, a NULL
    group is a group.  Pass one brackets each quantile with a bounded sketch
    (rank error at most 1 / accuracy).  Pass two turns each group into cells in
    the order of their values: one a distinct value inside a bracket, one a gap
    between brackets with its row count and ends.  Running totals over the cells,
    a prefix scan, place the ranks floor/ceil(p * (n - 1)): no window holds more
    than ``WINDOW_ROWS`` cells, however many rows a group has.  Where a rank lies
    inside a gap, that gap alone is read again and cut into its values.  The cells
    and the result are written to the checkpoint folder.  ``small`` says that the
    number of groups is bounded by the call.
    """
    keyed, groups = _with_group(long_df, group_cols)
    small = small or groups == [_ONE]
    found = _quantiles(keyed, groups, value_col, probs, _bracketed(keyed, groups, value_col, probs, accuracy), small, accuracy)
    return found.select(*group_cols, "prob", "quantile")


def _bracket_ends(probs: list[float], accuracy: int) -> tuple[list[float], list[int]]:
    """Bracket ends as ascending fractions, and the numbers of the gaps below an end that lie in a bracket."""
    margin = 4.0 / accuracy
    spans = [(max(0.0, p - margin), min(1.0, p + margin)) for p in probs]
    ends = sorted({e for span in spans for e in span})
    return ends, [i for i in range(1, len(ends)) if any(lo <= ends[i - 1] and ends[i] <= hi for lo, hi in spans)]


def _bracketed(keyed: DataFrame, groups: list[str], value_col: str, probs: list[float], accuracy: int,
               extra_aggs: list | None = None) -> DataFrame:
    """A row a group: the values ``_ends`` at the bracket ends (NULL without a value) and ``extra_aggs``, from one pass.

    Written, so that a join with it is planned by its size."""
    ends, _ = _bracket_ends(probs, accuracy)
    sketch = F.percentile_approx(F.col(value_col).cast("double"), ends, accuracy)
    return through_files(keyed.groupBy(*groups).agg(sketch.alias("_ends"), *(extra_aggs or [])), "quantile-brackets")


def _quantiles(keyed: DataFrame, groups: list[str], value_col: str, probs: list[float], brackets: DataFrame,
               small: bool, accuracy: int) -> DataFrame:
    """(group..., prob, quantile) from the brackets of ``_bracketed``."""
    ends, inner = _bracket_ends(probs, accuracy)
    base = keyed.select(*groups, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    v = join_on(base, brackets.select(*groups, "_ends"), groups, small=small)
    below, kept = F.lit(0), F.lit(False)
    for k in range(len(ends)):
        below = below + (F.col("_ends")[k] < F.col("_v")).cast("int")
        kept = kept | (F.col("_ends")[k] == F.col("_v"))
    v = v.select(*groups, "_v", below.alias("_gap"), F.when(kept | below.isin(inner), F.col("_v")).alias("_in"))
    cells = v.groupBy(*groups, "_gap", "_in").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    cells = through_files(cells.select(*groups, "_n", "_mn", "_mx"), "quantile-cells")
    hits = _rank_hits(cells, groups, probs)
    found = through_files(_interpolated(hits, groups), "quantiles")
    if not found.where(F.col("quantile").isNull()).isEmpty():
        inside = F.col("_unknown_lo") | F.col("_unknown_hi")
        gaps = through_files(hits.where(inside).select(*groups, "_mn", F.col("_mx").alias("_end")).distinct(), "quantile-gaps")
        values = join_on(base, gaps, groups, small=small).where((F.col("_v") >= F.col("_mn")) & (F.col("_v") <= F.col("_end")))
        values = values.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n"))
        rest = join_on(cells, gaps.drop("_end"), [*groups, "_mn"], "left_anti", small=small)
        cells = rest.unionByName(values.select(*groups, "_n", F.col("_v").alias("_mn"), F.col("_v").alias("_mx")))
        cells = through_files(cells, "quantile-cells")
        found = through_files(_interpolated(_rank_hits(cells, groups, probs), groups), "quantiles")
    return found


def _rank_hits(cells: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """The cells that hold a rank of a quantile, a row a quantile, with the values at the ranks.

    A rank inside a cell of several values, at neither of its ends, is unknown."""
    placed = running_totals(cells, groups, "_mn", ["_n"], n_buckets=max(1, -(-cells.count() // WINDOW_ROWS)),
                            materialize=False, totals_prefix="_all")
    start, end = F.col("cum__n") - F.col("_n"), F.col("cum__n")
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("_all_n") - 1)).alias("_pos")) for p in probs])
    here = F.filter(wanted, lambda t: (F.ceil(t["_pos"]) >= start) & (F.floor(t["_pos"]) < end))
    hits = placed.withColumn("_here", here).where(F.size("_here") > 0)
    hits = hits.select(*groups, "_n", "_mn", "_mx", "cum__n", F.explode("_here").alias("_t")).select("*", "_t.*")

    def at(rank, name):
        inside = (rank >= start) & (rank < end)
        known = F.when(rank == start, F.col("_mn")).when((rank == end - 1) | (F.col("_mn") == F.col("_mx")), F.col("_mx"))
        return [F.when(inside, known).alias(f"_v_{name}"), (inside & known.isNull()).alias(f"_unknown_{name}")]

    return hits.select(*groups, "prob", "_pos", "_mn", "_mx", *at(F.floor("_pos"), "lo"), *at(F.ceil("_pos"), "hi"))


def _interpolated(hits: DataFrame, groups: list[str]) -> DataFrame:
    """(group..., prob, quantile); NULL where a rank's value is unknown."""
    picked = hits.groupBy(*groups, "prob").agg(F.max("_v_lo").alias("_v_lo"), F.max("_v_hi").alias("_v_hi"),
                                               F.max(F.col("_pos") - F.floor("_pos")).alias("_frac"))
    q = F.when(F.col("_v_lo") == F.col("_v_hi"), F.col("_v_lo")).otherwise(
        (F.lit(1.0) - F.col("_frac")) * F.col("_v_lo") + F.col("_frac") * F.col("_v_hi"))
    return picked.select(*groups, "prob", q.alias("quantile"))


def quantiles_wide(long_df: DataFrame, group_cols: list[str], value_col: str, probs: dict[str, float],
                   approx: bool = False, small: bool = False, extra_aggs: list | None = None) -> DataFrame:
    """One row per group with one column per named probability.

    ``approx=True`` uses the bounded ``percentile_approx`` sketch (one pass);
    the default is exact (see ``exact_quantiles``).  ``extra_aggs`` are aliased
    aggregate columns over all of ``long_df``'s rows, NULL values included, from
    the sketch's pass; a group without any value has NULL quantiles.
    """
    names = list(probs)
    ps = [float(probs[n]) for n in names]
    keyed, groups = _with_group(long_df, group_cols)
    if approx:
        res = keyed.groupBy(*groups).agg(F.percentile_approx(value_col, ps, SKETCH_ACCURACY).alias("_q"), *(extra_aggs or []))
        rest = [c for c in res.columns if c not in (*groups, "_q")]
        return res.select(*group_cols, *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)], *rest)
    small = small or groups == [_ONE]
    every = _bracketed(keyed, groups, value_col, ps, SKETCH_ACCURACY, extra_aggs)
    q = _quantiles(keyed, groups, value_col, ps, every, small, SKETCH_ACCURACY)
    wide = q.groupBy(*groups).agg(*[F.max(F.when(F.col("prob") == F.lit(p), F.col("quantile"))).alias(n)
                                    for n, p in zip(names, ps, strict=True)])
    out = join_on(every.drop("_ends"), wide, groups, "left", small=small)
    return out.select(*group_cols, *names, *[c for c in every.columns if c not in (*groups, "_ends")])


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list, k: int, key_col: str,
                    salt_buckets: int = 64, rank_col: str = "rank") -> DataFrame:
    """Top ``k`` rows per group in two rounds, so no task sorts a whole group.

    Round one ranks inside (group, hash(key) % salt_buckets); the true top k
    of a group is contained in the union of those per-bucket top k.  Round
    two ranks at most ``k * salt_buckets`` rows per group.
    """
    salted = df.withColumn("_salt", F.abs(F.xxhash64(F.col(key_col))) % salt_buckets)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    cand = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
