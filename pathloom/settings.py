"""Settings of a deployment, from PATHLOOM_ variables of the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Deployment:
    """Each field is read from PATHLOOM_<FIELD>; what isn't set keeps its default."""

    servers: str = "localhost:9092"
    topic: str = "user_events"
    root: str = "tables"
    format: str = "parquet"
    checkpoints: str = "checkpoints"
    data: str = "data"
    trigger: str = "10 seconds"
    chunk_rows: int = 1000
    pause_seconds: float = 0.01
    retries: int = 3
    host: str = "127.0.0.1"
    port: int = 8080

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None, prefix: str = "PATHLOOM_") -> Deployment:
        env = os.environ if env is None else env
        kinds = {"int": int, "float": float, "str": str}
        found = {}
        for f in fields(cls):
            value = env.get(prefix + f.name.upper())
            if value is not None:
                try:
                    found[f.name] = kinds[f.type](value)
                except ValueError:
                    raise ValueError(f"{prefix}{f.name.upper()} is no {f.type}: {value}") from None
        return cls(**found)
