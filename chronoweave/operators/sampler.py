"""Learning sampler: a tree-structured Parzen estimator in generations, for all studies at once.

A study is one search (motion type, mode, fold, repeat).  Its trials are rows, a trial's parameters are rows
``(study, trial, parameter, option)``.  After each generation the best trials of a study are its good ones;
how often good and other trials used an option are group counts.  A new trial draws some candidates per
parameter from the good counts and takes the one that good trials favour most.  Draws come from hashes of
(seed, study, trial, parameter, candidate), so a seed gives the same trials on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators.experiment import FILTER_EXTRAS, SEARCH_SPACE, names_for_filter, stable_hash

GOOD_SHARE = 0.2  # of the trials of a study, MOST_GOOD at most
MOST_GOOD = 25
CANDIDATES = 2  # a whole generation draws from the same densities: more of them make its trials alike


def space_frame(spark: SparkSession, filters=tuple(FILTER_EXTRAS), space: dict[str, list] = SEARCH_SPACE) -> DataFrame:
    """``adaptive_filter, parameter, n_options`` of every parameter that a filter searches."""
    rows = [(kind, name, len(space[name])) for kind in filters for name in names_for_filter(kind)]
    return spark.createDataFrame(rows, "adaptive_filter string, parameter string, n_options int")


def good_trials(history: DataFrame) -> DataFrame:
    """``study, trial, good``: the first of each study by value (on 9 decimals), then by number.

    A study holds some hundred trials by definition; studies are many.
    """
    place = F.row_number().over(Window.partitionBy("study").orderBy(F.round("value", 9).asc_nulls_last(), "trial"))
    n = F.count(F.lit(1)).over(Window.partitionBy("study"))
    most = F.greatest(F.lit(1), F.least(F.lit(MOST_GOOD), F.ceil(F.lit(GOOD_SHARE) * n)))
    return history.select("study", "trial", (place <= most).alias("good"))


def densities(history: DataFrame, draws: DataFrame, space: DataFrame) -> DataFrame:
    """``study, parameter, option, n_good, n_bad, favour``: counts of each option, and how much good trials favour it.

    Every option has one more trial on both sides, so none is ever ruled out.
    """
    counts = draws.join(good_trials(history), ["study", "trial"]).groupBy("study", "parameter", "option").agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad")
    )
    searched = draws.select("study", "parameter").distinct().join(space.select("parameter", "n_options").distinct(), "parameter")
    options = searched.select("study", "parameter", "n_options", F.explode(F.sequence(F.lit(0), F.col("n_options") - 1)).alias("option"))
    rows = options.join(counts, ["study", "parameter", "option"], "left").fillna(0, ["n_good", "n_bad"])
    whole = Window.partitionBy("study", "parameter")
    share = lambda c: (F.col(c) + 1) / (F.sum(c).over(whole) + F.col("n_options"))
    return rows.select("study", "parameter", "option", "n_good", "n_bad", (share("n_good") / share("n_bad")).alias("favour"))


def _hash(seed: int, *parts: Column | str) -> Column:
    return stable_hash(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def _grid(studies: DataFrame, space: DataFrame, first: int, count: int) -> DataFrame:
    """All parameters of the trials ``first .. first + count - 1`` of every study."""
    trials = F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))).alias("trial")
    return studies.select("study", "adaptive_filter").distinct().join(space, "adaptive_filter").select("study", "parameter", "n_options", trials)


def uniform(studies: DataFrame, space: DataFrame, first: int, count: int, seed: int) -> DataFrame:
    """Options drawn evenly: ``study, trial, parameter, option``."""
    rows = _grid(studies, space, first, count)
    option = F.floor(_hash(seed, "study", "trial", "parameter") * F.col("n_options") / F.lit(2**32))
    return rows.select("study", "trial", "parameter", option.cast("int").alias("option"))


def propose(studies: DataFrame, space: DataFrame, known: DataFrame, first: int, count: int, seed: int) -> DataFrame:
    """Options of the next generation from the densities of the last one."""
    lists = known.groupBy("study", "parameter").agg(F.array_sort(F.collect_list(F.struct("option", "n_good", "favour"))).alias("options"))
    rows = _grid(studies, space, first, count).join(lists, ["study", "parameter"])
    ends = F.transform("options", lambda o: F.aggregate(F.filter("options", lambda p: p["option"] <= o["option"]), F.lit(0).cast("long"), lambda s, p: s + p["n_good"] + 1))
    rows = rows.withColumn("ends", ends)  # running sums of the good counts, one more for each option
    total = F.element_at("ends", -1)

    def candidate(c: Column) -> Column:
        spot = F.floor(_hash(seed, "study", "trial", "parameter", c) * total / F.lit(2**32))
        option = F.size(F.filter("ends", lambda e: e <= spot))
        return F.struct(F.get(F.col("options.favour"), option).alias("favour"), (-c).alias("first"), option.alias("option"))

    rows = rows.withColumn("tried", F.transform(F.sequence(F.lit(0), F.lit(CANDIDATES - 1)), candidate))
    return rows.select("study", "trial", "parameter", F.array_max("tried")["option"].cast("int").alias("option"))


def decode(draws: DataFrame, types: dict[str, str], space: dict[str, list] = SEARCH_SPACE) -> DataFrame:
    """One row per trial with the value of every parameter in its own type; ``RFF_LMS_Mu_Base`` is a ``LMS_Mu_Base``."""
    columns = {}
    for name, options in space.items():
        target = "LMS_Mu_Base" if name == "RFF_LMS_Mu_Base" else name
        value = F.get(F.array(*[F.lit(float(o)) for o in options]), F.col("option"))
        columns[target] = F.coalesce(*([columns[target]] if target in columns else []), F.max(F.when(F.col("parameter") == name, value)))
    wide = [value.cast(types[name]).alias(name) for name, value in columns.items()]
    return draws.groupBy("study", "trial").agg(*wide)


def _shares(values: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """Share of the variance of ``centred`` that the means of each parameter's options explain."""
    options = values.join(draws, ["study", "trial"]).groupBy(*by, "parameter", "option").agg(F.sum("centred").alias("s"), F.count(F.lit(1)).alias("n"))
    between = options.groupBy(*by, "parameter").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    total = values.groupBy(*by).agg(F.sum(F.col("centred") * F.col("centred")).alias("total"))
    share = F.when(F.col("total") > 1e-12, F.col("between") / F.col("total")).otherwise(F.lit(0.0))
    return between.join(total, by).select(*by, "parameter", share.alias("share"))


def effects(history: DataFrame, draws: DataFrame, seed: int, shuffles: int = 5) -> DataFrame:
    """``study, parameter, share, null_share``: how much of the objective each parameter explains, and how much it
    would by chance.

    The share is that of the variance between a parameter's options.  For chance the objectives of a study are
    dealt anew among its trials, ``shuffles`` times by hashes, and the shares averaged.
    """
    whole = Window.partitionBy("study")
    values = history.where("value IS NOT NULL").select("study", "trial", (F.col("value") - F.avg("value").over(whole)).alias("centred"))
    each = values.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    order = Window.partitionBy("study", "shuffle")
    from_place = F.row_number().over(order.orderBy("trial"))
    to_place = F.row_number().over(order.orderBy(_hash(seed, "study", "trial", "shuffle"), "trial"))
    dealt = each.select("study", "shuffle", "centred", from_place.alias("place")).join(each.select("study", "shuffle", "trial", to_place.alias("place")), ["study", "shuffle", "place"])
    chance = _shares(dealt, draws, ["study", "shuffle"]).groupBy("study", "parameter").agg(F.avg("share").alias("null_share"))
    return _shares(values, draws, ["study"]).join(chance, ["study", "parameter"])
