"""Settings from a file, read once on the driver and kept: YAML where a YAML library is present, else JSON."""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path


@lru_cache(maxsize=8)
def _load(path: str) -> dict:
    content = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(content)
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("a YAML file needs the yaml library; use JSON") from e
    return yaml.safe_load(content)


def load(path: str | Path, force: bool = False) -> dict:
    """The settings of a file; FileNotFoundError if there is none. force reads it again."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    if force:
        _load.cache_clear()
    return _load(str(path))
