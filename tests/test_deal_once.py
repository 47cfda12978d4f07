"""Poses and places are moved once, as they are, and consensus rows are made once."""

import numpy as np
import pytest

from orientlake.functions import rotations as R
from orientlake.operators import consensus as C, match as M
from orientlake.operators.sets import in_order_of
from orientlake.plans import scores


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _poses(spark, n=300):
    rng = np.random.default_rng(8)
    rows = [(int(i % 100) if i % 11 else None, float(w), *map(float, a)) for i, (w, a) in enumerate(zip(rng.uniform(.1, 1, n), rng.uniform(0, 180, (n, 3))))]
    rows += [(5, 0.2, 1.0, 2.0, 3.0)] * 50
    return spark.createDataFrame(rows, "g bigint, w double, rot double, tilt double, psi double")


def test_gathered_groups_have_the_same_mean(spark):
    df = R.with_matrix(_poses(spark), "rot", "tilt", "psi", "r")
    plain, gathered = (C.mean_rotation(df, ["g"], "r", "w", gathered=way) for way in (False, True))
    want, got = ({r["g"]: r for r in d.collect()} for d in (plain, gathered))
    assert plain.dtypes == gathered.dtypes
    assert want.keys() == got.keys() and None not in got
    for g, r in want.items():
        assert r["n"] == got[g]["n"] and np.allclose(list(r), list(got[g]), rtol=1e-9, atol=1e-9)


def test_poses_of_a_particle_are_moved_once(spark, plain_plans):
    m = scores.mean_rotation(spark, "/root/testdata/sf0.001")
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange"):]


def test_places_are_dealt_before_they_are_merged(spark, plain_plans):
    t = spark.createDataFrame([(i, "m", 10.0 * i, 0.0) for i in range(20)], "id bigint, micrograph string, x double, y double")
    found = M.shared_places([t, t.where("id % 2 = 0")], "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning(mic"):]
    assert sorted((r["id_0"], r["id_1"]) for r in found.collect()) == [(i, i) for i in range(0, 20, 2)]


def test_rows_to_be_ordered_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch
    df = spark.createDataFrame([(3,), (1,), (2,), (9,), (None,)], "pid bigint").mapInArrow(seen, "pid bigint")
    first = spark.createDataFrame([(i, -i) for i in range(5)], "pid bigint, file_order bigint")
    got = {r["pid"]: r["place"] for r in in_order_of(df, first, "pid").collect()}
    assert made.value == 5 and got == {3: 1, 2: 2, 1: 3, 9: 4 if got[9] == 4 else 5}
