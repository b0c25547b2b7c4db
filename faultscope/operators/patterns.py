"""Summaries of clustered messages: counts, top patterns, sources and destinations, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.functions import text, values
from faultscope.session import cut_lineage


# -- joins with the original messages -------------------------------------------------------


def merge_predictions(
    original: DataFrame,
    predictions: DataFrame,
    orig_id: str = "msg_id",
    pred_id: str = "msg_id",
    out_cols: list[str] | None = None,
) -> DataFrame:
    """Full outer join on the id: all original columns, then the prediction columns not among
    them. ``out_cols`` limits the prediction columns."""
    wanted = predictions.columns if out_cols is None else out_cols
    extra = [c for c in wanted if c not in original.columns]
    left, right = original.alias("o"), predictions.select(pred_id, *[c for c in extra if c != pred_id]).alias("p")
    return left.join(right, F.col(f"o.{orig_id}") == F.col(f"p.{pred_id}"), "full_outer").select(
        *[F.col(f"o.{c}") for c in original.columns], *[F.col(f"p.{c}") for c in extra]
    )


def hosts_to_sites(
    dataset: DataFrame, registry: DataFrame, host_cols: list[str]
) -> DataFrame:
    """Replace each host column by the site the registry gives for that host, null if none.

    ``registry`` has one row per ``hostname`` with its ``site``. The join is left to Spark: it
    broadcasts the registry while that is small and shuffles with skew splitting otherwise.
    """
    for i, column in enumerate(host_cols):
        lookup = registry.select(F.col("hostname").alias("_host"), F.col("site").alias(f"_site_{i}"))
        dataset = dataset.join(lookup, F.col(column) == F.col("_host"), "left").drop("_host")
    sites = {c: F.col(f"_site_{i}").alias(c) for i, c in enumerate(host_cols)}
    kept = [c for c in dataset.columns if not c.startswith("_site_")]
    return dataset.select(*[sites.get(c, F.col(c)) for c in kept])


# -- counts and ranks -----------------------------------------------------------------------


def pattern_counts(dataset: DataFrame, clust_col: str, value_col: str, out_col: str) -> DataFrame:
    return dataset.groupBy(clust_col, value_col).agg(F.count("*").alias(out_col))


def summary_counts(dataset: DataFrame, clust_col: str, value_cols: list[str]) -> dict[str, DataFrame]:
    """``pattern_counts`` of several columns from one pass over the data.

    One aggregate over the grouping sets (cluster, column) reads and shuffles the data once for
    all columns. Its result holds distinct values only and is written, so that the tables of the
    summary start from it instead of from the messages.
    """
    sets = [[F.col(clust_col), F.col(c)] for c in value_cols]
    counts = cut_lineage(
        dataset.select(clust_col, *value_cols)
        .groupingSets(sets, clust_col, *value_cols)
        .agg(F.grouping_id().alias("_set"), F.count("*").alias("n"))
    )
    # The grouping id has a 0 bit for each column of the set, the first column being the highest.
    every = 2 ** len(value_cols) - 1
    bits = {c: every - 2 ** (len(value_cols) - 1 - i) for i, c in enumerate(value_cols)}
    return {
        c: counts.filter(F.col("_set") == bits[c]).select(clust_col, c, "n") for c in value_cols
    }


def cluster_stats(
    dataset: DataFrame,
    clust_col: str = "prediction",
    tokens_col: str = "stop_token_1",
    pattern_col: str | None = "abstract_message",
) -> DataFrame:
    """Messages, distinct token lists and distinct patterns per cluster, largest first."""
    counts = summary_counts(dataset, clust_col, [tokens_col, *([pattern_col] if pattern_col else [])])
    return stats_of_counts(counts, clust_col, tokens_col, pattern_col)


def stats_of_counts(
    counts: dict[str, DataFrame], clust_col: str, tokens_col: str, pattern_col: str | None
) -> DataFrame:
    """``cluster_stats`` from the counts of its columns.

    Equal lists have collapsed per (cluster, list) before anything is counted per cluster, so a
    cluster with a large share of the rows is spread over many tasks.
    """
    zero = F.lit(0).cast("bigint")
    strings = counts[tokens_col].select(
        clust_col,
        F.when(F.col(tokens_col).isNotNull(), F.col("n")).otherwise(zero).alias("n_messages"),
        F.col(tokens_col).isNotNull().cast("bigint").alias("unique_strings"),
        zero.alias("unique_patterns"),
    )
    parts = strings
    if pattern_col:
        patterns = counts[pattern_col].select(
            clust_col,
            zero.alias("n_messages"),
            zero.alias("unique_strings"),
            F.col(pattern_col).isNotNull().cast("bigint").alias("unique_patterns"),
        )
        parts = strings.unionByName(patterns)
    stats = parts.groupBy(clust_col).agg(
        F.sum("n_messages").alias("n_messages"),
        F.sum("unique_strings").alias("unique_strings"),
        F.sum("unique_patterns").alias("unique_patterns"),
    )
    stats = stats if pattern_col else stats.drop("unique_patterns")
    return stats.orderBy(F.desc("n_messages"), clust_col)


def label_of(value_col: str) -> str:
    """Prefix of the share column: sources, destinations, else messages."""
    if "src" in value_col:
        return "src"
    return "dst" if "dst" in value_col else "msg"


def full_rank(df: DataFrame, group_col: str, order: list[Column], name: str) -> DataFrame:
    """1, 2, 3 … in ``order`` within each group, for groups of any size.

    A plain window would sort a whole group in one task. Here the rows are range partitioned and
    written once; each slice numbers its own rows and adds the sizes of the slices before it.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(slices, F.col(group_col), *order).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    sizes = ranged.groupBy(group_col, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group_col).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(group_col).alias("_group"),
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(group_col, "_slice").orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(within))
        .join(
            offsets,
            F.col(group_col).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_s")),
        )
        .withColumn(name, (F.col("_before") + F.col("_row")).cast("int"))
        .drop("_slice", "_row", "_before", "_group", "_s")
    )


def top_patterns(
    dataset: DataFrame,
    clust_col: str,
    value_col: str,
    out_col: str,
    n_rank: int | None = None,
    detokenize: bool = False,
) -> DataFrame:
    """Most frequent values per cluster with their share and rank; all of them without ``n_rank``."""
    counts = pattern_counts(dataset, clust_col, value_col, "n")
    return ranked_counts(counts, clust_col, value_col, out_col, n_rank, detokenize)


def ranked_counts(
    counts: DataFrame,
    clust_col: str,
    value_col: str,
    out_col: str,
    n_rank: int | None = None,
    detokenize: bool = False,
) -> DataFrame:
    """``top_patterns`` from counts ``n`` per cluster and value.

    Ranking comes before the share: with a limit, each task then hands on ``n_rank`` rows per
    cluster at most, and the share needs only the cluster totals.
    """
    order = [F.desc("n"), F.col(value_col).asc()]
    if n_rank:
        in_cluster = Window.partitionBy(clust_col).orderBy(*order)
        ranked = counts.withColumn("rank_pattern", F.rank().over(in_cluster)).filter(
            F.col("rank_pattern") <= n_rank
        )
    else:
        ranked = full_rank(counts, clust_col, order, "rank_pattern")
    totals = counts.groupBy(F.col(clust_col).alias("_cluster")).agg(F.sum("n").alias("_total"))
    share = (F.col("n") / F.col("_total")).alias(f"{label_of(value_col)}_perc")
    shown = text.detokenize(F.col(value_col)).alias("pattern") if detokenize else F.col(value_col)
    return ranked.join(totals, F.col(clust_col).eqNullSafe(F.col("_cluster"))).select(
        clust_col, shown, F.col("n").alias(out_col), share, "rank_pattern"
    )


def pattern_summary(
    counts: dict[str, DataFrame],
    clust_col: str,
    tokens_col: str = "stop_token_1",
    pattern_col: str | None = "abstract_message",
    n_mess: int | None = 3,
    src_col: str | None = None,
    dst_col: str | None = None,
    n_src: int | None = 3,
    n_dst: int | None = 3,
) -> DataFrame:
    """Patterns, sources and destinations side by side, aligned on their rank in the cluster.

    ``counts`` is what ``summary_counts`` gives. Without a source or destination column that part
    is left out.
    """
    value, out = (pattern_col, "n_patterns") if pattern_col else (tokens_col, "n_strings")
    table = ranked_counts(counts[value], clust_col, value, out, n_mess, detokenize=True)
    for column, out, limit in ((src_col, "n_src", n_src), (dst_col, "n_dst", n_dst)):
        if column:
            part = ranked_counts(counts[column], clust_col, column, out, limit)
            table = _full_join(table, part, [clust_col, "rank_pattern"])
    return table


def _full_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join in which null keys are equal: messages without a cluster are a cluster as well."""
    named = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    joined = left.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "full")
    both = [F.coalesce(c, f"_{c}").alias(c) for c in keys]
    return joined.select(*both, *[c for c in [*left.columns, *right.columns] if c not in keys])


def cluster_summary_table(stats: DataFrame, patterns: DataFrame, clust_col: str) -> DataFrame:
    """Counts of each cluster next to its ranked patterns; the largest cluster comes first."""
    return _full_join(stats, patterns, [clust_col]).orderBy(
        F.desc("n_messages"), clust_col, "rank_pattern"
    )


def cluster_token_frequency(
    dataset: DataFrame,
    tokens_col: str,
    clust_col: str = "prediction",
    top_n: int | None = None,
) -> DataFrame:
    """How often each token occurs in a cluster, absolutely and against the cluster's top token."""
    counts = (
        dataset.select(clust_col, F.explode(tokens_col).alias("token"))
        .select(clust_col, F.trim("token").alias("token"))
        .filter(F.col("token") != "")
        .groupBy(clust_col, "token")
        .agg(F.count("*").alias("n"))
    )
    top = counts.groupBy(F.col(clust_col).alias("_cluster")).agg(F.max("n").alias("_top"))
    if top_n:
        order = Window.partitionBy(clust_col).orderBy(F.desc("n"), "token")
        counts = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    weighted = counts.join(top, F.col(clust_col).eqNullSafe(F.col("_cluster")))
    return weighted.withColumn("weight", F.col("n") / F.col("_top")).drop("_cluster", "_top")


# -- time -----------------------------------------------------------------------------------


def cluster_trend(
    dataset: DataFrame,
    time_col: str,
    clust_col: str = "prediction",
    bins: int = 144,
) -> DataFrame:
    """Messages of each cluster in equal-width time bins from its first to its last minute.

    ``time_col`` holds epoch milliseconds; rows without a positive time are left out. A bin
    includes its right edge, empty bins are present with 0, and a cluster with a single minute
    falls into bin 1.
    """
    minutes = dataset.filter(F.col(time_col) > 0).select(
        clust_col, F.unix_micros(values.minute_of(F.col(time_col))).alias("_t")
    )
    per_minute = minutes.groupBy(clust_col, "_t").agg(F.count("*").alias("_n"))
    spans = per_minute.groupBy(F.col(clust_col).alias("_cluster")).agg(
        F.min("_t").alias("_lo"), (F.max("_t") - F.min("_t")).alias("_width")
    )
    # Whole microseconds: a bin is the ceiling of (t - lo) * bins / width.
    ceiling = F.expr(f"((_t - _lo) * {bins} + _width - 1) div _width")
    number = F.when(F.col("_width") == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), ceiling))
    counted = (
        per_minute.join(spans, F.col(clust_col).eqNullSafe(F.col("_cluster")))
        .select("_cluster", number.cast("int").alias("bin"), "_n")
        .groupBy("_cluster", "bin")
        .agg(F.sum("_n").alias("n"))
        .withColumnRenamed("_cluster", clust_col)
    )
    grid = spans.select(
        "_cluster",
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("_bin"),
        "_lo",
        "_width",
    )
    return grid.join(
        counted,
        F.col("_cluster").eqNullSafe(F.col(clust_col)) & (F.col("_bin") == F.col("bin")),
        "left",
    ).select(
        F.col("_cluster").alias(clust_col),
        F.col("_bin").alias("bin"),
        F.timestamp_micros(F.expr(f"_lo + (_bin * _width) div {bins}")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n_messages"),
    )
