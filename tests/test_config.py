"""Runs from configuration files."""

import pytest

from quillgraph.sources import config

G8 = ["8 13", "2 3 4 5", "1 3 4", "1 2 4", "1 2 3", "1 6 7 8", "5 7 8", "5 6 8", "5 6 7"]


def test_keys():
    with pytest.warns(UserWarning, match="colour"):
        run = config.parsed("% note\nK 7\nscaleCoeff 0.25\nmaxEpoch 3\nrunAllEpochs true\ncpu 4\ncolour red\nproposalStrategy odd\nuseTemperatureSchedule true\nmaxTemperature 50\ninitFromRandomNeighborhood false\ninitFromBestNeighborhood true\nupdateImmediately false\nmetisFile a b.txt\n")
    s = run.settings
    assert (s.clusters, s.scale, s.max_epochs, s.all_epochs, s.strategy, s.temperature, s.start, s.batches, s.colours) == (7, 0.25, 3, True, "single", 50.0, "seeds", 1, False)
    assert run.files == {"metisFile": "a b.txt"} and run.unknown == ("colour",)
    assert config.parsed("initFromRandomNeighborhood false").settings.start == "random" and config.parsed("").settings.start == "random_neighborhood"
    assert config.parsed("proposalStrategy MultipleMembershipLikelihood").settings.strategy == "multiple"


def test_a_run(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\n".join(G8) + "\n")
    (tmp_path / "start.txt").write_text("1 2 3 4\n5 6 7 8\n")
    names = {k: str(tmp_path / k) for k in ("outputByRowsFile", "outputByColsFile", "outputRowsWithScoresFile", "clusterPrecisionFile")}
    (tmp_path / "run.config").write_text("\n".join([f"metisFile {tmp_path}/g.txt", f"initFromColsFile {tmp_path}/start.txt", "K 2", "maxEpoch 1", "scaleCoeff 1", *(f"{k} {v}" for k, v in names.items())]))
    config.fit_from_config(spark, config.read_config(str(tmp_path / "run.config")))
    text = {k: [r.value for p in [v] for r in spark.read.text(p).collect()] for k, v in names.items()}
    assert text["outputByRowsFile"] == ["1"] * 4 + ["2"] * 4 and text["outputByColsFile"] == ["1 2 3 4", "5 6 7 8"]
    assert text["outputRowsWithScoresFile"] == ["1:0.75", "1:1.0", "1:1.0", "1:1.0", "2:0.75", "2:1.0", "2:1.0", "2:1.0"] and text["clusterPrecisionFile"] == ["1.00", "1.00"]
