"""Settings: explicit arguments before the file before the environment before the defaults."""

from __future__ import annotations

import dataclasses
import os


@dataclasses.dataclass(frozen=True)
class Config:
    library: str = "library"
    output: str = "folio-out"
    max_chars: int = 1500
    dedup_threshold: float = 0.85
    num_perm: int = 128
    shingle_k: int = 5
    embedding_dim: int = 384
    max_triples: int = 10


def load(path: str | None = None, env: dict[str, str] | None = None, **explicit) -> Config:
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Config)}
    values: dict = {}
    for source in ({k: v for k in kinds if (v := (os.environ if env is None else env).get(f"FOLIO_{k.upper()}")) is not None}, _file(path), explicit):
        values |= {k: kinds[k](v) for k, v in source.items() if k in kinds}
    return Config(**values)


def _file(path: str | None) -> dict:
    """``key: value`` lines; unknown keys and comments are skipped."""
    if not path:
        return {}
    with open(path) as f:
        pairs = (line.split("#")[0].partition(":") for line in f if ":" in line.split("#")[0])
        return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs if v.strip()}
