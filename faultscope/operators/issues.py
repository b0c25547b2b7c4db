"""Issues: the feature values that explain failures, and what happens to them afterwards.

An issue table has ``issue_id``, ``features`` (map of feature to value), ``window_start`` and
``window_end``; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.functions import values
from faultscope.operators.components import connected_groups
from faultscope.operators.jobs import FEATURES

# Importance (of 100) a feature value must exceed, and the share of an issue's
# failed jobs that another issue must exceed to overlap with it.
MIN_IMPORTANCE = 5
MAX_OVERLAP = 0.3


# -- which feature values explain a signature -----------------------------------------------


def feature_scores(cells: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Score of every feature value per slice, from ``slice_cells``.

    A depth-one tree separates the jobs with a value from those without; its gain is the drop of
    the Gini impurity weighted by the number of jobs. ``importance`` scales the gains of a slice
    to 100, ``lift`` compares the failure rate inside with that of the whole slice. All values of
    all signatures come out of one aggregate.
    """
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]
    counts = (
        cells.select("slice", "n_failed", "n_success", "walltime_loss", F.inline(F.array(*pairs)))
        .groupBy("slice", "feature", "value")
        .agg(
            F.sum("n_failed").alias("n_failed"),
            F.sum("n_success").alias("n_success"),
            F.sum("walltime_loss").alias("walltime_loss"),
        )
    )
    totals = cells.groupBy(F.col("slice").alias("_slice")).agg(
        F.sum("n_failed").alias("_failed"), F.sum("n_success").alias("_success")
    )
    inside_f, inside_s = F.col("n_failed"), F.col("n_success")
    all_f, all_s = F.col("_failed"), F.col("_success")

    def impurity(failed: Column, success: Column) -> Column:
        """Gini impurity of a node times its size."""
        size = (failed + success).cast("double")
        return F.when(size > 0, F.lit(2.0) * failed * success / size).otherwise(F.lit(0.0))

    gain = (
        impurity(all_f, all_s)
        - impurity(inside_f, inside_s)
        - impurity(all_f - inside_f, all_s - inside_s)
    )
    rate = inside_f / (inside_f + inside_s)
    scored = counts.join(totals, F.col("slice") == F.col("_slice")).select(
        "slice",
        "feature",
        "value",
        "n_failed",
        "n_success",
        "walltime_loss",
        F.greatest(gain, F.lit(0.0)).alias("gain"),
        F.when(all_f > 0, rate / (all_f / (all_f + all_s))).alias("lift"),
    )
    gains = scored.groupBy(F.col("slice").alias("_slice")).agg(F.sum("gain").alias("_gain"))
    return (
        scored.join(gains, F.col("slice") == F.col("_slice"))
        .withColumn(
            "importance",
            F.when(F.col("_gain") > 0, 100.0 * F.col("gain") / F.col("_gain")).otherwise(F.lit(0.0)),
        )
        .drop("_slice", "_gain")
    )


def important_values(
    scores: DataFrame, features: list[str] = FEATURES, min_importance: float = MIN_IMPORTANCE
) -> DataFrame:
    """Values above the importance limit, numbered per slice in the order of the features and
    then of the values.

    Importances of a slice sum to 100, so there are fewer than ``100 / min_importance`` of them.
    """
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    order = Window.partitionBy("slice").orderBy(place, "value")
    return scores.filter(F.col("importance") > min_importance).select(
        "slice",
        "feature",
        "value",
        "importance",
        (F.row_number().over(order) - 1).alias("number"),
    )


def _value_list(important: DataFrame) -> DataFrame:
    """One row per slice with its few important values, ordered by number."""
    entry = F.struct("number", "feature", "value", "importance")
    return important.groupBy(F.col("slice").alias("_slice")).agg(
        F.sort_array(F.collect_list(entry)).alias("_values")
    )


def _has_value(features: list[str], feature: Column, value: Column) -> Column:
    """Whether the row's column named ``feature`` equals ``value``."""
    chain = F.when(feature == features[0], F.col(features[0]) == value)
    for name in features[1:]:
        chain = chain.when(feature == name, F.col(name) == value)
    return F.coalesce(chain, F.lit(False))


def feature_pair_counts(
    cells: DataFrame, important: DataFrame, features: list[str] = FEATURES
) -> DataFrame:
    """Failed jobs per slice for each pair of important values, single values included as
    ``first = second``. A cell yields the pairs among its own few important values only."""
    hits = F.transform(
        F.filter(F.col("_values"), lambda v: _has_value(features, v["feature"], v["value"])),
        lambda v: v["number"],
    )
    pairs = F.flatten(
        F.transform(
            F.col("_hits"),
            lambda a: F.transform(
                F.filter(F.col("_hits"), lambda b: b >= a),
                lambda b: F.struct(a.alias("first"), b.alias("second")),
            ),
        )
    )
    return (
        cells.join(_value_list(important), F.col("slice") == F.col("_slice"))
        .select("slice", "n_failed", hits.alias("_hits"))
        .select("slice", "n_failed", F.inline(pairs))
        .groupBy("slice", "first", "second")
        .agg(F.sum("n_failed").alias("n_failed"))
    )


def feature_sets(important: DataFrame, pair_counts: DataFrame) -> DataFrame:
    """The value sets to report per slice.

    The values are walked in order. A value that is not yet the second of a pair is paired with
    every later such value it shares a failed job with; without any it stands alone, provided it
    has a failed job itself. Result: slice, number, ``features`` map.
    """
    shared = (
        pair_counts.filter(F.col("n_failed") > 0)
        .groupBy(F.col("slice").alias("_pair_slice"))
        .agg(F.collect_set(F.struct("first", "second")).alias("_shared"))
    )
    lists = _value_list(important).join(shared, F.col("_slice") == F.col("_pair_slice"))
    count = F.size("_values")
    walk = F.sequence(F.lit(0), count - 1)

    def step(state: Column, i: Column) -> Column:
        partners = F.filter(
            walk,
            lambda j: (j > i)
            & ~F.array_contains(state["taken"], j)
            & F.array_contains(
                F.col("_shared"), F.struct(i.alias("first"), j.alias("second"))
            ),
        )
        alone = F.array_contains(F.col("_shared"), F.struct(i.alias("first"), i.alias("second")))
        found = (
            F.when(F.size(partners) > 0, F.transform(partners, lambda j: F.array(i, j)))
            .when(alone, F.array(F.array(i)))
            .otherwise(F.array().cast("array<array<int>>"))
        )
        skip = F.array_contains(state["taken"], i)
        return F.struct(
            F.when(skip, state["taken"]).otherwise(F.concat(state["taken"], partners)).alias("taken"),
            F.when(skip, state["sets"]).otherwise(F.concat(state["sets"], found)).alias("sets"),
        )

    start = F.struct(
        F.array().cast("array<int>").alias("taken"),
        F.array().cast("array<array<int>>").alias("sets"),
    )
    sets = F.aggregate(walk, start, step)["sets"]
    entries = F.transform(
        F.col("_set"),
        lambda i: F.struct(
            F.get(F.col("_values"), i)["feature"].alias("key"),
            F.get(F.col("_values"), i)["value"].alias("value"),
        ),
    )
    return (
        lists.withColumn("_sets", sets)
        .select(F.col("_slice").alias("slice"), "_values", F.posexplode("_sets").alias("number", "_set"))
        .select("slice", "number", F.map_from_entries(entries).alias("features"))
    )


def set_metrics(cells: DataFrame, sets: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Failures, successes, loss, window and purity of each feature set over its slice."""
    lists = sets.groupBy(F.col("slice").alias("_slice")).agg(
        F.collect_list(F.struct("number", F.map_entries("features").alias("entries"))).alias("_sets")
    )
    held = F.filter(
        F.col("_sets"),
        lambda s: F.forall(s["entries"], lambda e: _has_value(features, e["key"], e["value"])),
    )
    metrics = (
        cells.join(lists, F.col("slice") == F.col("_slice"))
        .select(
            "slice", "n_failed", "n_success", "walltime_loss", "first_end", "last_end",
            F.explode(F.transform(held, lambda s: s["number"])).alias("number"),
        )
        .groupBy("slice", "number")
        .agg(
            F.sum("n_failed").alias("n_failed"),
            F.sum("n_success").alias("n_success"),
            F.sum("walltime_loss").alias("walltime_loss"),
            F.min("first_end").alias("first_end"),
            F.max("last_end").alias("last_end"),
        )
    )
    first, last = F.col("first_end"), F.col("last_end")
    return sets.join(metrics, ["slice", "number"]).select(
        "slice",
        "number",
        "features",
        "n_failed",
        "n_success",
        "walltime_loss",
        values.purity(F.col("n_failed"), F.col("n_success")).alias("purity"),
        values.widened_start(first, last).alias("window_start"),
        values.widened_end(first, last).alias("window_end"),
    )


# -- issues against jobs --------------------------------------------------------------------


def issue_jobs(
    jobs: DataFrame, issues: DataFrame, features: list[str] = FEATURES, with_window: bool = False
) -> DataFrame:
    """Jobs of each issue: inside its window (inclusive) and with all its feature values.

    Each issue looks for its jobs under one of its values only, the others are checked on the
    joined row. So the join is an equi-join that yields every (issue, job) pair once, and needs
    no shuffle of the jobs while the issues are few enough for Spark to broadcast. Jobs outside
    all windows are left out before they are copied per feature. ``with_window`` keeps the
    issue's ``window_start`` and ``window_end``.
    """
    edges = issues.agg(F.struct(F.min("window_start").alias("low"), F.max("window_end").alias("high")).alias("edges"))
    jobs = jobs.filter(F.col("ENDTIME").between(edges.select("edges.low").scalar(), edges.select("edges.high").scalar()))
    entries = F.array_sort(F.map_entries("features"))
    keys = issues.select(
        "issue_id",
        F.col("window_start").alias("_from"),
        F.col("window_end").alias("_to"),
        entries.alias("_entries"),
        F.get(entries, F.lit(0))["key"].alias("_feature"),
        F.get(entries, F.lit(0))["value"].alias("_value"),
    )
    pairs = [F.struct(F.lit(f).alias("_feature"), F.col(f).alias("_value")) for f in features]
    return (
        jobs.select("*", F.inline(F.array(*pairs)))
        .join(keys, ["_feature", "_value"])
        .filter(
            F.col("ENDTIME").between(F.col("_from"), F.col("_to"))
            & F.forall("_entries", lambda e: _has_value(features, e["key"], e["value"]))
        )
        .withColumnsRenamed({"_from": "window_start", "_to": "window_end"} if with_window else {})
        .drop("_feature", "_value", "_from", "_to", "_entries")
    )


def issue_other_jobs(jobs: DataFrame, issue: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Jobs inside the window of the issue that lack one of its feature values.

    ``issue`` holds a single issue: the complement of many at once would be the product of jobs
    and issues.
    """
    one = issue.select(
        F.struct(
            "issue_id", "window_start", "window_end", F.map_entries("features").alias("entries")
        ).alias("issue")
    ).scalar()
    own = F.forall("_issue.entries", lambda e: _has_value(features, e["key"], e["value"]))
    inside = F.col("ENDTIME").between(F.col("_issue.window_start"), F.col("_issue.window_end"))
    return (
        jobs.withColumn("_issue", one)
        .filter(inside & ~own)
        .withColumn("issue_id", F.col("_issue.issue_id"))
        .drop("_issue")
    )


def issue_metrics(jobs: DataFrame, issues: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Failures, successes, loss, purity and window of given issues over a job table."""
    first, last = F.col("first_end"), F.col("last_end")
    return (
        issue_jobs(jobs, issues, features)
        .groupBy("issue_id")
        .agg(
            F.sum("ISFAILED").alias("n_failed"),
            F.sum("ISSUCCESS").alias("n_success"),
            F.sum("LOSTWALLTIME").alias("walltime_loss"),
            F.min("ENDTIME").alias("first_end"),
            F.max("ENDTIME").alias("last_end"),
        )
        .select(
            "issue_id",
            "n_failed",
            "n_success",
            "walltime_loss",
            values.purity(F.col("n_failed"), F.col("n_success")).alias("purity"),
            values.widened_start(first, last).alias("window_start"),
            values.widened_end(first, last).alias("window_end"),
        )
    )


def payload_class(
    jobs: DataFrame, issues: DataFrame, features: list[str] = FEATURES, site_col: str = "SITE"
) -> DataFrame:
    """Whether the jobs of an issue ran on HPC sites (site set), on the grid (not set) or both."""
    on_hpc = F.col(site_col) != values.NOT_SPECIFIED
    return (
        issue_jobs(jobs, issues, features)
        .groupBy("issue_id")
        .agg(F.bool_or(on_hpc).alias("is_hpc"), F.bool_or(~on_hpc).alias("is_grid"))
        .withColumn("payload_type", values.payload_type(F.col("is_hpc"), F.col("is_grid")))
    )


def failure_ticks(
    jobs: DataFrame, issues: DataFrame, features: list[str] = FEATURES, minutes: int = 15
) -> DataFrame:
    """Loss and count of failed jobs strictly inside the window of each issue, per time bin;
    empty bins between the first and the last one are present with 0."""
    inside = issue_jobs(jobs.filter(F.col("ISFAILED") == 1), issues, features, with_window=True)
    strict = (F.col("ENDTIME") > F.col("window_start")) & (F.col("ENDTIME") < F.col("window_end"))
    return dense_ticks(inside.filter(strict), ["issue_id"], minutes)


def dense_ticks(failures: DataFrame, keys: list[str], minutes: int = 15) -> DataFrame:
    """Loss and number of rows per key and time bin, without gaps."""
    step = f"{minutes} minutes"
    ticks = (
        failures.groupBy(*keys, F.window("ENDTIME", step).alias("_bin"))
        .agg(F.sum("LOSTWALLTIME").alias("walltime_loss"), F.count("*").alias("nfailed_jobs"))
        .select(*keys, F.col("_bin.start").alias("tick_time"), "walltime_loss", "nfailed_jobs")
    )
    spans = ticks.groupBy(*keys).agg(
        F.min("tick_time").alias("_first"), F.max("tick_time").alias("_last")
    )
    grid = spans.select(
        *keys,
        F.explode(F.sequence("_first", "_last", F.expr(f"INTERVAL {minutes} MINUTES"))).alias("tick_time"),
    )
    return grid.join(ticks, [*keys, "tick_time"], "left").select(
        *keys,
        "tick_time",
        F.coalesce("walltime_loss", F.lit(0.0)).alias("walltime_loss"),
        F.coalesce("nfailed_jobs", F.lit(0)).alias("nfailed_jobs"),
    )


# -- overlap and merging --------------------------------------------------------------------


def failed_overlap(
    jobs: DataFrame,
    issues: DataFrame,
    features: list[str] = FEATURES,
    id_col: str = "PANDAID",
    min_share: float = MAX_OVERLAP,
) -> DataFrame:
    """Pairs of issues where the second holds more than ``min_share`` of the first's failed jobs.

    Jobs that belong to the same set of issues are counted as one before any pair is formed, so
    the pairs come from the distinct issue sets and not from the jobs. The issues are the few that
    ``find_issues`` reports: the top signatures times the values above the importance limit.
    """
    failed = issue_jobs(jobs.filter(F.col("ISFAILED") == 1), issues, features)
    issue_sets = (
        failed.groupBy(id_col)
        .agg(F.sort_array(F.collect_set("issue_id")).alias("ids"))
        .groupBy("ids")
        .agg(F.count("*").alias("n"))
    )
    shared = (
        issue_sets.select("ids", "n", F.explode("ids").alias("issue_id"))
        .select("issue_id", "n", F.explode("ids").alias("other_id"))
        .groupBy("issue_id", "other_id")
        .agg(F.sum("n").alias("n_shared"))
    )
    own = F.col("issue_id") == F.col("other_id")
    sizes = shared.filter(own).select(F.col("issue_id").alias("_id"), F.col("n_shared").alias("_size"))
    return (
        shared.filter(~own)
        .join(sizes.withColumnRenamed("_size", "n_own"), F.col("issue_id") == F.col("_id"))
        .drop("_id")
        .join(sizes.withColumnRenamed("_size", "n_other"), F.col("other_id") == F.col("_id"))
        .drop("_id")
        .filter(F.col("n_shared") / F.col("n_own") > min_share)
    )


def drop_overlapping(issues: DataFrame, overlap: DataFrame) -> DataFrame:
    """Issues that do not lie to a good part inside one with more failed jobs."""
    covered = overlap.filter(F.col("n_own") < F.col("n_other")).select("issue_id")
    return issues.join(covered, "issue_id", "left_anti")


def features_similar(left: Column, right: Column) -> Column:
    """Whether the smaller feature map lies in the other, or all but one feature of one does."""
    common = F.size(F.array_intersect(F.map_entries(left), F.map_entries(right)))
    n_left, n_right = F.size(left), F.size(right)
    contained = common == F.least(n_left, n_right)
    near = (common > 0) & ((common + 1 == n_left) | (common + 1 == n_right))
    return contained | near


def similarity_links(issues: DataFrame) -> DataFrame:
    """Issues tied together by similar features, as (shared, issue_id) memberships.

    Two issues are similar exactly if one of them, as a whole or less one feature, lies in the
    other. So every issue owns the sets it forms as a whole or less one feature, and belongs to
    each owned set that it contains. A set is looked for under its rarest feature value, by the
    issues that have that value: a set held by a third of all issues costs one row per issue, not
    one per pair, and an issue of n features costs n rows, not one per subset.
    """
    entries = issues.select("issue_id", F.array_sort(F.map_entries("features")).alias("_entries"))
    single = entries.select("issue_id", "_entries", F.explode("_entries").alias("_entry"))
    single = single.withColumn("_key", F.to_json("_entry"))
    less_one = F.transform("_entries", lambda left: F.filter("_entries", lambda e: e != left))
    owned = entries.select(F.explode(F.concat(F.array("_entries"), less_one)).alias("_set")).distinct()
    owned = owned.filter(F.size("_set") > 0).withColumn("shared", F.to_json("_set"))
    times = single.groupBy("_key").agg(F.count("*").alias("_times"))
    keyed = owned.select("shared", "_set", F.explode("_set").alias("_entry"))
    keyed = keyed.withColumn("_key", F.to_json("_entry")).join(times, "_key")
    rarest = keyed.groupBy("shared").agg(
        F.min(F.struct("_times", "_key"))["_key"].alias("_key"), F.min("_set").alias("_set")
    )
    held = F.size(F.array_intersect("_set", "_entries")) == F.size("_set")
    return rarest.join(single.select("issue_id", "_entries", "_key"), "_key").filter(held).select("shared", "issue_id")


def similar_groups(issues: DataFrame) -> DataFrame:
    """Group of each issue under transitive similarity: the smallest issue id it is tied to."""
    links = similarity_links(issues).select(F.col("issue_id").alias("node"), F.col("shared").alias("hub"))
    return connected_groups(links).select(
        F.col("node").alias("issue_id"), F.col("group").alias("group_id")
    )


def merge_groups(issues: DataFrame, groups: DataFrame) -> DataFrame:
    """One issue per group: added counts and error counts, widest window, and the features of the
    member with the most failed jobs (smallest id on ties).

    Expects ``n_failed``, ``n_success``, ``walltime_loss`` and ``error_strings`` beside the issue
    columns.
    """
    members = issues.join(groups, "issue_id")
    errors = (
        members.select("group_id", F.explode("error_strings").alias("field", "texts"))
        .select("group_id", "field", F.explode("texts").alias("text", "n"))
        .groupBy("group_id", "field", "text")
        .agg(F.sum("n").alias("n"))
        .groupBy("group_id", "field")
        .agg(F.map_from_entries(F.collect_list(F.struct("text", "n"))).alias("texts"))
        .groupBy("group_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "texts"))).alias("error_strings"))
    )
    merged = members.groupBy("group_id").agg(
        F.min_by("features", F.struct(-F.col("n_failed"), F.col("issue_id"))).alias("features"),
        F.sum("n_failed").alias("n_failed"),
        F.sum("n_success").alias("n_success"),
        F.sum("walltime_loss").alias("walltime_loss"),
        F.min("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
        F.count("*").alias("n_merged"),
    )
    nothing = F.create_map().cast("map<string,map<string,bigint>>")
    return merged.join(errors, "group_id", "left").select(
        F.col("group_id").alias("issue_id"),
        "features",
        "n_failed",
        "n_success",
        "walltime_loss",
        values.purity(F.col("n_failed"), F.col("n_success")).alias("purity"),
        "window_start",
        "window_end",
        "n_merged",
        F.coalesce("error_strings", nothing).alias("error_strings"),
    )


def merge_error_strings(issues: DataFrame, group_cols: list[str]) -> DataFrame:
    """Error texts of all issues of a group with their counts added up."""
    return (
        issues.select(*group_cols, F.explode("error_strings").alias("field", "texts"))
        .select(*group_cols, "field", F.explode("texts").alias("text", "n"))
        .groupBy(*group_cols, "field", "text")
        .agg(F.sum("n").alias("n"))
    )


def unique_issues(issues: DataFrame) -> DataFrame:
    """One issue per feature map, the one with the smallest id."""
    keyed = issues.withColumn("_key", values.canonical_map(F.col("features")))
    kept = keyed.groupBy("_key").agg(F.min("issue_id").alias("issue_id"))
    return issues.join(kept.select("issue_id"), "issue_id", "left_semi")


def shared_failed_jobs(
    jobs: DataFrame,
    issues: DataFrame,
    first_id: int,
    second_id: int,
    features: list[str] = FEATURES,
    id_col: str = "PANDAID",
) -> DataFrame:
    """Ids of the failed jobs that two issues have in common."""
    failed = issue_jobs(
        jobs.filter(F.col("ISFAILED") == 1),
        issues.filter(F.col("issue_id").isin(first_id, second_id)),
        features,
    )
    of_first = failed.filter(F.col("issue_id") == first_id).select(id_col)
    return of_first.intersect(failed.filter(F.col("issue_id") == second_id).select(id_col))
