"""Presets and their schedules."""

import pytest

from stackwright.plans import monitor, presets


def test_presets_are_laid_over_each_other(spark, tmp_path):
    out = presets.settings("quick", "sampled", overrides={"iterations": 7})
    assert (out["pixels"], out["iterations"], out["ess_scale"], out["seed"]) == (32, 7, 5.0, 0)
    (tmp_path / "own.json").write_text('{"learn_rate": 1, "symmetry": "d2"}')
    assert presets.settings("momentum", files=[str(tmp_path / "own.json")])["symmetry"] == "d2"
    for bad in ({"pixls": 3}, {"pixels": "3"}, {"sampling": "yes"}):
        with pytest.raises((KeyError, TypeError)):
            presets.settings(overrides=bad)
    with pytest.raises(KeyError, match="unknown preset"):
        presets.settings("quickest")
    for name in presets.PRESETS:
        assert presets.settings(name) != presets.DEFAULTS


def test_schedules_are_the_same_for_one_turn_and_for_a_table(spark):
    text = presets.settings("coarse_to_fine")["radius"]
    rows = presets.scheduled(spark.range(0, 20).selectExpr("id as iteration", "id / 2.0D as epoch"), {"radius": text}).orderBy("iteration").collect()
    one = [float(monitor.schedule(spark, {"radius": text}, {"epoch": r["epoch"], "iteration": r["iteration"]})["radius"]) for r in rows]
    assert [r["radius"] for r in rows] == one and one == sorted(one) and (one[0], one[-1]) == (0.25, 0.95)
