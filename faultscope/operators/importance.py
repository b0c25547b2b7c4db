"""Feature importance from boosted stumps on distinct combinations of feature values."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.operators.jobs import FEATURES
from faultscope.session import stored

IMPORTANCE_SCHEMA = "slice string, feature string, value string, importance double, rounds int"
# Weight that holds the value of a leaf near 0.
LEAF_WEIGHT = 3.0
# Decimals of a gain that decide between values; equal ones go by feature and value.
DECIMALS = 9


@dataclass
class _Slice:
    """The model of one slice: a value for all, what a feature's value adds to it, and per round the split and its weight."""

    base: float = 0.0
    added: dict[tuple[int, str], float] = field(default_factory=dict)
    splits: list[tuple[int, str, float]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)


def divided_cells(cells: DataFrame, features: list[str], train_share: float) -> DataFrame:
    """Cells (slice, features, n_failed, n_success) with counts to train on and counts held back.

    Of each cell's failed and successful jobs the same share is held back, rounded up or down by a hash of the cell. Cells
    that stand there twice are one.
    """
    summed = cells.groupBy("slice", *features).agg(F.sum("n_failed").alias("n_failed"), F.sum("n_success").alias("n_success"))

    def held(name: str) -> Column:
        chance = F.pmod(F.xxhash64("slice", *features, F.lit(name)), F.lit(1000)) / 1000.0
        return F.floor(F.col(name) * (1.0 - train_share) + chance).cast("double")

    both = summed.withColumn("v_failed", held("n_failed")).withColumn("v_success", held("n_success"))
    return both.select(
        "slice", *features, (F.col("n_failed") - F.col("v_failed")).alias("t_failed"),
        (F.col("n_success") - F.col("v_success")).alias("t_success"), "v_failed", "v_success",
    )


def _best_splits(cells: DataFrame, features: list[str], models: dict[str, _Slice], l2: float) -> list:
    """Per slice the value whose jobs the errors of its model tell best from the others, and the sums on both sides.

    One aggregate per (feature, value) of all slices. The models go along as one constant: a number per slice and per value chosen so far.
    """
    given = {s: {"base": m.base, "added": {f"{k} {v}": x for (k, v), x in m.added.items()}} for s, m in models.items()}
    model = F.from_json(F.lit(json.dumps(given)), "map<string, struct<base: double, added: map<string, double>>>")
    added = " + ".join(f"coalesce(model.added[concat('{k} ', `{f}`)], 0D)" for k, f in enumerate(features))
    values = ", ".join(f"named_struct('feature', {k}, 'value', `{f}`)" for k, f in enumerate(features))
    soft = "greatest({0}, 0D) + log1p(exp(-abs({0})))".format
    scored = cells.withColumn("model", F.element_at(model, F.col("slice"))).filter("model is not null")
    scored = scored.selectExpr("*", f"model.base + {added} AS score", "t_failed + t_success AS n")
    scored = scored.selectExpr("*", "1 / (1 + exp(-score)) AS p")
    # The loss on what is held back is log(1 + exp(x)) without overflow.
    parts = scored.selectExpr(
        "slice", f"array({values}) AS values", "t_failed - n * p AS g", "n * p * (1 - p) AS h", "n",
        f"v_failed * ({soft('-score')}) + v_success * ({soft('score')}) AS loss",
    )
    # The slices' totals, a row each, as one value of the plan.
    totals = parts.groupBy("slice").agg(F.expr("struct(sum(g) AS g, sum(h) AS h, sum(n) AS n, sum(loss) AS loss) AS all"))
    totals = totals.agg(F.expr("map_from_entries(collect_list(struct(slice, all)))")).scalar()
    sums = parts.selectExpr("slice", "inline(values)", "g", "h", "n").groupBy("slice", "feature", "value")
    met = sums.agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).withColumn("all", F.element_at(totals, F.col("slice")))
    met = met.selectExpr("*", "all.g AS all_g", "all.h AS all_h", "all.n AS all_n", "all.loss AS all_loss")
    # A value that all jobs have, or none to train on, divides nothing.
    gain = F.expr(
        f"if(n > 0 AND n < all_n, g * g / (h + {l2}D) + (all_g - g) * (all_g - g) / (all_h - h + {l2}D) - all_g * all_g / (all_h + {l2}D), 0D)"
    )
    rank = F.struct(-F.round(gain, DECIMALS), F.col("feature"), F.col("value"))
    chosen = F.struct(gain.alias("gain"), "feature", "value", "g", "h", "n", "all_g", "all_h", "all_n", "all_loss")
    return met.groupBy("slice").agg(F.min_by(chosen, rank).alias("best")).select("slice", "best.*").collect()


def boost_cells(
    cells: DataFrame,
    features: list[str] = FEATURES,
    iterations: int = 200,
    step_size: float = 0.01,
    train_share: float = 0.9,
    l2: float = LEAF_WEIGHT,
) -> DataFrame:
    """``slice, feature, value, importance, rounds``: what tells failed from successful jobs in each slice, of 100.

    ``cells`` has ``slice``, the features and the numbers ``n_failed`` and ``n_success`` of jobs that have them, as
    ``slice_cells`` makes them. Each round adds to each slice's model, for the log odds of a failure, the tree of
    depth one that lowers the logistic loss most: one value of one feature against all others, with Newton steps as leaves. Of
    the rounds those up to the least loss on the jobs held back are kept. A value's importance is the sum over its
    trees of the squared difference of the leaves, weighted by the jobs on both sides.

    All slices are trained together, so a round is one aggregate over (slice, feature, value). The driver holds the models: a few numbers per slice and round,
    and no list of values. Slices without failed and successful jobs to train on have no rows.
    """
    spark = cells.sparkSession
    divided = stored(divided_cells(cells, features, train_share), "boosting-cells")
    counted = divided.groupBy("slice").agg(F.sum("t_failed").alias("f"), F.sum("t_success").alias("s"), F.sum(F.col("v_failed") + F.col("v_success")).alias("v"))
    held = {r["slice"]: r["v"] for r in counted.filter("f > 0 and s > 0").collect()}
    models = {s: _Slice() for s in held}
    open_models = dict(models)
    for number in range(iterations + 1):
        if not open_models:
            break
        for r in _best_splits(divided, features, open_models, l2):
            model = models[r["slice"]]
            model.losses.append(r["all_loss"])
            # The last pass only measures; and where nothing divides a slice, nothing will.
            if number == iterations or r["gain"] <= 0:
                del open_models[r["slice"]]
                continue
            inside = step_size * r["g"] / (r["h"] + l2)
            outside = step_size * (r["all_g"] - r["g"]) / (r["all_h"] - r["h"] + l2)
            place = r["feature"], r["value"]
            model.base += outside
            model.added[place] = model.added.get(place, 0.0) + inside - outside
            model.splits.append((*place, (inside - outside) ** 2 * r["n"] * (r["all_n"] - r["n"]) / r["all_n"]))
    rows = []
    for name, model in models.items():
        kept = min(range(len(model.losses)), key=model.losses.__getitem__) if held[name] and model.losses else len(model.splits)
        weights: dict[tuple[int, str], float] = {}
        for k, value, weight in model.splits[:kept]:
            weights[k, value] = weights.get((k, value), 0.0) + weight
        total = math.fsum(weights.values())
        rows += [(name, features[k], v, 100.0 * w / total, kept) for (k, v), w in weights.items() if total]
    return spark.createDataFrame(rows, IMPORTANCE_SCHEMA)


def boosted_importance(
    jobs: DataFrame,
    features: list[str] = FEATURES,
    iterations: int = 200,
    step_size: float = 0.01,
    train_share: float = 0.9,
    label_col: str = "ISFAILED",
) -> DataFrame:
    """Importance (of 100) of every feature value for failing, of one set of failed and successful jobs (see ``boost_cells``)."""
    failed = F.col(label_col).cast("int")
    cells = jobs.groupBy(F.lit("all").alias("slice"), *features).agg(
        F.sum(failed).alias("n_failed"), F.sum(1 - failed).alias("n_success")
    )
    return boost_cells(cells, features, iterations, step_size, train_share).drop("slice", "rounds")
