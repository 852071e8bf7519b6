"""Learning sampler: density tables, reproducible draws, and a planted optimum."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import sampler
from chronoweave.operators.experiment import SEARCH_SPACE, names_for_filter
from chronoweave.operators.trials import TYPES
from chronoweave.storage import materialise

STUDIES = [(f"s{n}", "lms") for n in range(12)]
BEST = {"K_max": 4, "slew_limit_bpm": 1, "hr_range_hz": 5, "max_order": 0, "smooth_win_len": 2}


@pytest.fixture(scope="module")
def studies(spark):
    return spark.createDataFrame(STUDIES, "study string, adaptive_filter string")


@pytest.fixture(scope="module")
def space(spark):
    return sampler.space_frame(spark, ("lms",))


def planted(draws):
    """Distance to a planted optimum in five of the parameters."""
    off = F.coalesce(*[F.when(F.col("parameter") == p, F.abs(F.col("option") - o)) for p, o in BEST.items()], F.lit(0))
    return draws.groupBy("study", "trial").agg(F.sum(off).cast("double").alias("value"))


def search(studies, space, seed, learn=True, generations=6, size=12):
    draws = materialise(sampler.uniform(studies, space, 0, size, seed), "draws")
    for generation in range(1, generations):
        if learn:
            known = sampler.densities(planted(draws), draws, space)
            new = sampler.propose(studies, space, known, generation * size, size, seed)
        else:
            new = sampler.uniform(studies, space, generation * size, size, seed)
        draws = materialise(draws.unionByName(new), "draws")
    return draws


def test_learning_beats_even_draws_and_is_reproducible(studies, space):
    learned = search(studies, space, 7)
    best = lambda d: d.groupBy("study").agg(F.min("value").alias("v")).agg(F.avg("v")).first()[0]
    assert best(planted(learned)) + 1.0 < best(planted(search(studies, space, 7, learn=False)))
    late = planted(learned.where("trial >= 48")).agg(F.avg("value")).first()[0]
    assert late < 0.7 * planted(learned.where("trial < 12")).agg(F.avg("value")).first()[0]
    rows = sorted(map(tuple, learned.collect()))
    assert rows == sorted(map(tuple, search(studies, space, 7).collect())) and rows != sorted(map(tuple, search(studies, space, 8).collect()))
    assert len(rows) == 12 * 72 * len(names_for_filter("lms"))
    assert all(0 <= option < len(SEARCH_SPACE[name]) for _, _, name, option in rows)


def test_densities_equal_plain_counts(spark, studies, space):
    draws = materialise(sampler.uniform(studies, space, 0, 30, 3), "draws")
    history = planted(draws).withColumn("value", F.when(F.col("trial") % 7 != 3, F.col("value")))  # some failed
    got = {(r.study, r.parameter, r.option): r for r in sampler.densities(history, draws, space).collect()}
    values, used = {}, {}
    for r in history.collect():
        values.setdefault(r.study, []).append((r.value is not None, r.value or 0.0, r.trial) if r.value is not None else (2, 0.0, r.trial))
    for r in draws.collect():
        used[r.study, r.trial, r.parameter] = r.option
    for study, rows in values.items():
        good = {t for _, _, t in sorted(rows)[: max(1, min(25, math.ceil(0.2 * len(rows))))]}
        assert len(good) == 6
        for name in names_for_filter("lms"):
            split = [Counter(used[study, t, name] for _, _, t in rows if (t in good) == side) for side in (True, False)]
            k = len(SEARCH_SPACE[name])
            for option in range(k):
                row = got[study, name, option]
                assert (row.n_good, row.n_bad) == (split[0][option], split[1][option])
                assert row.favour == pytest.approx(((row.n_good + 1) / (6 + k)) / ((row.n_bad + 1) / (24 + k)))
    assert len(got) == 12 * sum(len(SEARCH_SPACE[n]) for n in names_for_filter("lms"))


def test_decoded_trials_have_their_own_types(spark):
    space = sampler.space_frame(spark)
    studies = spark.createDataFrame([("a", "volterra"), ("b", "rff_lms")], "study string, adaptive_filter string")
    draws = sampler.uniform(studies, space, 0, 5, 1)
    rows = {(r.study, r.trial): r for r in sampler.decode(draws, TYPES).collect()}
    schema = dict(sampler.decode(draws, TYPES).dtypes)
    assert schema["max_order"] == "int" and schema["Kstop"] == "double" and len(rows) == 10
    for d in draws.collect():
        name = "LMS_Mu_Base" if d.parameter == "RFF_LMS_Mu_Base" else d.parameter
        assert rows[d.study, d.trial][name] == pytest.approx(SEARCH_SPACE[d.parameter][d.option])
    assert all(rows["a", t].rff_D is None and rows["b", t].alpha_u is None for t in range(5))


def test_planted_parameters_come_first_and_the_others_look_like_chance(studies, space):
    draws = materialise(sampler.uniform(studies, space, 0, 150, 5), "draws")
    rows = sampler.effects(planted(draws), draws, 11).toPandas()
    assert len(rows) == 12 * len(names_for_filter("lms"))
    mean = rows.groupby("parameter")[["share", "null_share"]].mean()
    order = mean["share"].sort_values(ascending=False).index.tolist()
    assert set(order[:5]) == set(BEST)
    rest = mean.loc[[p for p in mean.index if p not in BEST]]
    assert (rest["share"] < 2.5 * rest["null_share"]).all() and (mean.loc[["K_max", "slew_limit_bpm", "hr_range_hz"], "share"] > 3 * mean.loc[["K_max", "slew_limit_bpm", "hr_range_hz"], "null_share"]).all()
