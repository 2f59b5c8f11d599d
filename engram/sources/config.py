"""Local folders and configuration; plain Python, before any Spark work."""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Mapping

from engram.errors import ConfigError, EngramError, InvalidArgumentError
from engram.validate import check_dim

CONFIG_FILE = "models.json"
DEFAULT_CONFIG = {"embedder": {"engine": "hashing", "dim": 768}}
ENGINES = ("http", "hashing", "local")
STORE_VARIABLE = "ENGRAM_STORE"


def private_dir(path: str) -> str:
    """Creates a folder for its owner alone; one that others may enter is refused."""
    os.makedirs(path, mode=0o700, exist_ok=True)
    mode = stat.S_IMODE(os.stat(path).st_mode)
    if os.name != "nt" and mode & 0o077:
        raise EngramError(f"Permissions 0{mode:o} for '{path}' are too open. Run: chmod 700 {path}")
    return path


def init(base_dir: str) -> str:
    """Folders, a default configuration and an empty chunk store; a configuration that is there already is checked and left
    as it is. The store gets the dimension of the configured embedder."""
    for part in ("", "keys", "data"):
        os.makedirs(os.path.join(base_dir, part), mode=0o700, exist_ok=True)
    path = os.path.join(base_dir, CONFIG_FILE)
    if not os.path.exists(path):
        with open(path, "w") as f:
            json.dump(DEFAULT_CONFIG, f, indent=2)
        os.chmod(path, 0o600)
    load_config(base_dir)
    for part in ("chunks", os.path.join("chunks", "_log")):
        os.makedirs(os.path.join(base_dir, "data", part), mode=0o700, exist_ok=True)
    return base_dir


def load_config(base_dir: str) -> dict:
    """The checked configuration; unknown keys are dropped."""
    path = os.path.join(base_dir, CONFIG_FILE)
    try:
        with open(path) as f:
            raw = json.load(f)
    except FileNotFoundError:
        raise ConfigError(f"no configuration at {path}; init() makes a default one") from None
    except ValueError as e:
        raise ConfigError(f"Invalid JSON in {path}: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError(f"{CONFIG_FILE} must be a JSON object")
    if "embedder" not in raw:  # the default embedder
        return {"embedder": dict(DEFAULT_CONFIG["embedder"])}
    embedder = raw["embedder"]
    if not isinstance(embedder, dict):
        raise ConfigError(f'"embedder" in {CONFIG_FILE} must be an object')
    if embedder.get("engine") not in ENGINES:
        raise ConfigError(f"Unknown embedder engine {embedder.get('engine')!r}. Valid engines: {', '.join(ENGINES)}")
    out = {"engine": embedder["engine"]}
    for key in ("model", "host"):
        if key in embedder:
            if not isinstance(embedder[key], str) or not embedder[key]:
                raise ConfigError(f'"embedder.{key}" must be a non-empty string if provided')
            out[key] = embedder[key]
    if "dim" in embedder:
        try:
            out["dim"] = check_dim(embedder["dim"])
        except InvalidArgumentError as e:
            raise ConfigError(f'"embedder.dim" rejected: {e}') from e
    return {"embedder": out}


def store_path(explicit: str | None = None, *, env: Mapping[str, str] | None = None, home: str | None = None) -> str:
    """The given path, else that of the environment, else one under the home folder; blank ones do not count."""
    for candidate in (explicit, (os.environ if env is None else env).get(STORE_VARIABLE)):
        if candidate and candidate.strip():
            return candidate.strip()
    return os.path.join(home or os.path.expanduser("~"), ".engram", "store")
