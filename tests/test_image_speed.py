"""Image jobs do each step once and in parts that fit a cache."""

import numpy as np

from orientlake.fourier import postprocess as P
from orientlake.functions import rotations as R
from orientlake.images import jobs as J, kernels as K
from orientlake.operators.poses import expand_by_symmetry
from orientlake.plans import pictures
from test_kernels import dense, image_frame

SF = "/root/testdata/sf0.001"


def test_kernels_take_parts_that_fit_a_cache():
    assert J.WORK_BYTES <= 1 << 24 and J.SLAB_BYTES == 1 << 28


def test_particles_are_dealt_before_they_get_their_pictures(spark):
    plan = pictures.posed(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("RepartitionByExpression")]
    assert "Join" in above


def test_symmetry_copies_are_inserted_in_the_kernel(spark):
    _, df = image_frame(spark, 10)
    turned = R.with_matrix(df, "rot", "tilt", "psi", "m")
    want = dense(J.backproject(expand_by_symmetry(turned, "m", "r", "D2"), 8, True, "conf"))
    assert np.allclose(dense(J.backproject(df, 8, True, "conf", symmetry="D2")), want, atol=1e-9)
    assert np.allclose(dense(J.backproject(R.with_matrix(df, "rot", "tilt", "psi", "r"), 8, True, "conf", symmetry="D2")), want, atol=1e-9)


def test_reconstruct_reads_its_accumulators_once(spark):
    _, df = image_frame(spark, 10)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    acc = J.backproject(df, 8, True, "conf").mapInArrow(seen, "half bigint, z int, y int, x int, re double, im double, w double, ctfsq double")
    P.reconstruct(acc, 8).collect()
    assert read.value == J.backproject(df, 8, True, "conf").count()


def test_noise_is_that_of_a_generator_per_seed(spark):
    seeds = np.array([0, 1, 7, 2 ** 32 - 1, 2 ** 32, 2 ** 40 + 9, 2 ** 63 - 1], dtype=np.int64)
    drawn = np.empty((len(seeds), 4, 4))
    K.seeded_normals(seeds, drawn)
    assert all(np.array_equal(d, np.random.default_rng(int(s)).standard_normal((4, 4))) for d, s in zip(drawn, seeds))
    x = np.random.default_rng(3).standard_normal((len(seeds), 16))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 10.0, int(s)) for i, s in enumerate(seeds)], "id bigint, pixels array<double>, psi double, seed bigint")
    for r in J.augment(df, ["id", "seed"], 0.5).collect():
        k = r["seed"] % 4
        want = np.rot90(x[r["id"]].reshape(4, 4), k) + np.random.default_rng(r["seed"]).standard_normal((4, 4)) * 0.5
        assert np.array_equal(np.array(r["pixels_out"]).reshape(4, 4), want) and r["turns"] == k and r["psi_out"] == (10.0 + 90.0 * k) % 360
