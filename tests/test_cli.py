import pytest

from bytelake.__main__ import parser
from bytelake.plans.patching import generate_patches
from bytelake.sources.synth import SCENARIOS, scenario_table


def run(*args):
    a = parser().parse_args([str(x) for x in args])
    return a.run(a)


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios_round_trip(tmp_path, name):
    assert run("synth", "--out", tmp_path, "--scenario", name, "--funcs", 12) == 0
    old, new, out = tmp_path / "old.bin", tmp_path / "new.bin", tmp_path / "p.bin"
    for mode in ("global", "advanced"):
        assert run("gen", "--old", old, "--new", new, "--out", out, "--mode", mode, "--old-sym", tmp_path / "old.json", "--new-sym", tmp_path / "new.json", "--frames", tmp_path / mode) == 0
        assert run("apply", "--old", old, "--patch", out, "--expect", new, "--out", tmp_path / "again.bin") == 0
        assert run("sim", "--old", old, "--patch", out, "--new", new) == 0
        assert out.stat().st_size < new.stat().st_size
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "advanced").glob("*.bin"))) == out.read_bytes()
    assert run("analyze", "--patch", out) == 0 and run("repeats", "--old", old, "--new", new) == 0


def test_scenario_table(spark):
    made = generate_patches(scenario_table(spark, 2), ["pair_id", "scenario"], "advanced")
    assert made.count() == 10 and made.where("NOT ok").count() == 0
