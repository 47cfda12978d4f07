"""Matching by direct sums equals transforms, and fine grids are searched around every coarse pose."""

import numpy as np

from orientlake.functions import grids as G
from orientlake.images import jobs as J, kernels as K
from orientlake.plans import pictures


def _matcher(monkeypatch, volume, *args, **kwargs):
    """The function that ``match_to_reference`` runs on a batch of columns."""
    class Shared:
        value = volume
    got = []
    monkeypatch.setattr(J, "map_images", lambda df, keep, fields, fn, *rest: got.append(fn))
    J.match_to_reference(None, ["pid"], Shared(), *args, **kwargs)
    return got[0]


def _images(n, side, seed=6):
    rng = np.random.default_rng(seed)
    volume = K.volume_transform(rng.standard_normal((side,) * 3))
    angles = [rng.uniform(-200, 400, n), rng.uniform(0, 180, n), rng.uniform(-200, 400, n)]
    c = {"pixels": rng.standard_normal((n, side * side)), "rot": angles[0], "tilt": angles[1], "psi": angles[2], "px": np.full(n, 1.5),
         "defocus_u": rng.uniform(1e4, 2e4, n), "defocus_v": rng.uniform(1e4, 2e4, n), "defocus_ang": rng.uniform(0, 180, n),
         "kv": np.full(n, 300.0), "cs": np.full(n, 2.7), "w": np.full(n, 0.1)}
    parts = J.matched_parts(J.stacked(c["pixels"]), None)
    fy, fx = K.half_frequencies(side)
    weight = (np.hypot(fy, fx) <= 0.5).astype(float)[None, None] * J.ctf_of(c, side)[:, None]
    return volume, c, parts, weight


def test_direct_sums_equal_transforms():
    for side, shift in ((4, 0.5), (8, 0.5), (8, 0.3), (8, 1.0), (12, 0.4), (16, 0.5)):
        volume, c, parts, weight = _images(7, side)
        angles = np.stack([c["rot"], c["tilt"], c["psi"]], axis=1)[:, None, :] + J._offsets(4.0, 2.0)[None, :30]
        turns = G.zyz_matrices(angles[..., 0], angles[..., 1], angles[..., 2])
        want, at = J._search(parts, volume, turns, weight, shift)
        filters = K.correlation_filters(parts, weight[:, 0], shift)
        assert np.allclose(J._correlations(parts, volume, J._entries(turns), weight, shift, filters), want, rtol=1e-9, atol=1e-9)
        got = J._peaks(parts, volume, turns, weight, shift, filters)
        assert np.allclose(got[0], want, rtol=1e-9, atol=1e-9) and np.allclose(got[1], at, atol=1e-6)


def test_small_images_need_no_transform_for_each_candidate(monkeypatch):
    volume, c, parts, weight = _images(5, 8)
    run = _matcher(monkeypatch, volume, 4.0, 4.0, top_k=2, max_shift=0.5)

    def never(*args, **kwargs):
        raise AssertionError("one transform for each candidate")
    monkeypatch.setattr(K, "correlation_peaks", never)
    assert len(run(c)["corr_2"]) == 5


def test_fine_grids_around_every_coarse_pose(monkeypatch):
    volume, c, parts, weight = _images(40, 8)
    coarse, fine = J._offsets(4.0, 4.0), G.zyz_matrices(*J._offsets(2.0, 2.0).T)
    got = _matcher(monkeypatch, volume, 4.0, 4.0, max_shift=0.5, two_stage=True, fine=(2.0, 2.0))(c)
    few = _matcher(monkeypatch, volume, 4.0, 4.0, max_shift=0.5, two_stage=True, fine=(2.0, 2.0), coarse_k=2)(c)
    angles = np.stack([c["rot"], c["tilt"], c["psi"]], axis=1)[:, None, :] + coarse[None]
    mats = G.zyz_matrices(angles[..., 0], angles[..., 1], angles[..., 2])
    every = (fine[None, None] @ mats[:, :, None]).reshape(40, -1, 3, 3)
    want, _ = J._search(parts, volume, every, weight, 0.5)
    assert np.allclose(got["corr_1"], want.max(axis=1))
    assert (got["corr_1"] > few["corr_1"] + 1e-6).any()
    found = G.zyz_matrices(got["rot_1"], got["tilt_1"], got["psi_1"])
    best = want.argmax(axis=1)
    same = np.isclose(found, every[np.arange(40), best], atol=1e-6).all(axis=(1, 2))
    again, _ = J._search(parts, volume, found[:, None], weight, 0.5)
    assert same.mean() > 0.9 and np.allclose(again[:, 0], want.max(axis=1))
    coarse_corr, _ = J._search(parts, volume, mats, weight, 0.5)
    z = (want.max(axis=1) - coarse_corr.mean(axis=1)) / (coarse_corr.std(axis=1, ddof=1) + 1e-6)
    assert np.allclose(got["confidence_1"], J._normal_cdf(z))


def test_refined_winner_takes_the_grid_it_lies_in(monkeypatch):
    volume, c, parts, weight = _images(20, 8)
    run = {k: _matcher(monkeypatch, volume, 4.0, 4.0, max_shift=0.5, two_stage=True, fine=(2.0, 2.0), coarse_k=k, refine=True) for k in (None, 27)}
    a, b = run[None](c), run[27](c)
    assert np.allclose(a["corr_1"], b["corr_1"])


def test_two_stage_search_refines_all_candidates(monkeypatch):
    asked = {}

    def seen(df, keep, reference, *args, **kwargs):
        asked.update(kwargs)
        raise StopIteration
    monkeypatch.setattr(pictures, "posed", lambda spark, sf: None)
    monkeypatch.setattr(pictures, "mean_volume", lambda spark, sf: None)
    monkeypatch.setattr(J, "match_to_reference", seen)
    try:
        pictures.two_stage_search(None, "")
    except StopIteration:
        pass
    assert asked["two_stage"] and asked.get("coarse_k") is None
