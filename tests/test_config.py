import json

from lectern import config


def test_merge_is_deep_and_copies():
    base = {"a": {"x": [1], "y": 2}, "b": 1}
    out = config.merged(base, {"a": {"y": {"z": 3}}, "c": 4})
    assert out == {"a": {"x": [1], "y": {"z": 3}}, "b": 1, "c": 4}
    out["a"]["x"].append(2)
    assert base == {"a": {"x": [1], "y": 2}, "b": 1}


def test_file_and_environment(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"significance": {"n_boot": 5}, "paths": {"data": "here"}}))
    (tmp_path / ".env").write_text("# comment\nLECTERN_SIGNIFICANCE__LEVEL=0.1\nLECTERN_SIGNIFICANCE__N_BOOT='6'\nOTHER=1\n")
    out = config.load(str(tmp_path / "c.json"), str(tmp_path / ".env"), {"LECTERN_SIGNIFICANCE__N_BOOT": "7"})
    assert out["significance"] == {"n_boot": 7, "level": 0.1} and out["language_model"] == config.DEFAULTS["language_model"]
    assert out["paths"]["data"] == str(tmp_path / "here")
    assert config.load(environment={})["significance"]["n_boot"] == 10_000
