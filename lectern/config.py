"""Settings: defaults, files over them, the environment over both."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping

DEFAULTS = {
    "scoring": {"tolerance_s": 0.15, "context_words": 3, "min_words": 2},
    "language_model": {"ngram_order": 4, "add_k": 0.1, "weight": 0.7},
    "rescoring": {"grid": [0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0], "dev_share": 0.34},
    "significance": {"n_boot": 10_000, "level": 0.05},
    "paths": {"data": "data", "results": "results"},
}


def merged(base: Mapping, over: Mapping) -> dict:
    """A deep copy of ``base`` with the values of ``over``; mappings are merged key by key."""
    out = copy.deepcopy(dict(base))
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else copy.deepcopy(value)
    return out


def dotenv(text: str) -> dict[str, str]:
    """NAME=value lines; blank lines, comments and quotes around values are passed over."""
    pairs = (line.split("=", 1) for line in map(str.strip, text.splitlines()) if "=" in line and not line.startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def load(path: str | None = None, env_file: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "LECTERN_") -> dict:
    """The settings of a JSON or YAML file (YAML where a parser is installed) over the defaults. A variable
    LECTERN_SECTION__KEY, from the environment or else from ``env_file``, wins over both; its value is read as
    JSON if it is such. Relative paths are taken from the file's folder."""
    out = merged(DEFAULTS, {})
    if path:
        with open(path, encoding="utf-8") as file:
            if path.endswith((".yaml", ".yml")):
                import yaml

                out = merged(out, yaml.safe_load(file) or {})
            else:
                out = merged(out, json.load(file))
    variables: dict[str, str] = {}
    if env_file and os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as file:
            variables |= dotenv(file.read())
    variables |= os.environ if environment is None else environment
    for name, value in variables.items():
        if name.startswith(prefix) and "__" in name:
            section, _, key = name.removeprefix(prefix).lower().partition("__")
            try:
                value = json.loads(value)
            except ValueError:
                pass
            out = merged(out, {section: {key: value}})
    root = os.path.dirname(os.path.abspath(path)) if path else os.getcwd()
    out["paths"] = {k: os.path.normpath(os.path.join(root, v)) for k, v in out["paths"].items()}
    return out
