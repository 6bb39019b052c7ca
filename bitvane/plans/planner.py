"""Decisions that are made before a DataFrame is built: parameters, limits and the access path."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from enum import Enum

#: The limits of the published file formats and defaults.
SCAN_ALWAYS = 2**64 - 1
MAX_LEVEL = 31
U32_MAX = 2**32 - 1


class StorageStatus(Enum):
    OK = "ok"
    IO_ERROR = "io_error"
    BAD_MAGIC = "bad_magic"
    BAD_VERSION = "bad_version"
    CORRUPT_SIZE = "corrupt_size"


class GraphStatus(Enum):
    OK = "ok"
    IO_ERROR = "io_error"
    BAD_MAGIC = "bad_magic"
    BAD_VERSION = "bad_version"
    MISMATCH = "mismatch"
    CORRUPT = "corrupt"


class RotationStatus(Enum):
    OK = "ok"
    BAD_INPUT = "bad_input"
    NOT_CONVERGED = "not_converged"
    IO_ERROR = "io_error"
    BAD_MAGIC = "bad_magic"
    BAD_VERSION = "bad_version"
    INCOMPATIBLE = "incompatible"
    CORRUPT = "corrupt"


class EngineError(Exception):
    """A failure with its status."""

    def __init__(self, status: Enum, message: str = ""):
        super().__init__(f"{status.value}: {message}" if message else status.value)
        self.status = status


@dataclass(frozen=True)
class IndexConfig:
    """Parameters of an index; kept as JSON beside its tables."""

    dim: int
    m: int = 16
    ef_construction: int = 200
    max_ef_search: int = 256
    seed: int = 42
    shards: int = 1
    filter_scan_limit: int | None = None

    def __post_init__(self):
        if self.dim < 1:
            raise ValueError("an index needs at least one dimension")
        object.__setattr__(self, "m", max(2, self.m))
        object.__setattr__(self, "ef_construction", max(1, self.ef_construction))

    @property
    def ef_limit(self) -> int:
        return max(self.max_ef_search, self.ef_construction)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> IndexConfig:
        return cls(**json.loads(text))


def clamp_kef(k: int, ef: int, ef_limit: int | None) -> tuple[int, int]:
    """(k, ef) as a search uses them: k at most the limit, ef between k and the limit; None lifts it."""
    if ef_limit is not None:
        k = min(k, ef_limit)
    ef = max(ef, k)
    return k, ef if ef_limit is None else min(ef, ef_limit)


def scan_limit(ef: int, capacity: int, override: int | None = None) -> int:
    """The size of an allow-set up to which scanning it beats walking the graph."""
    return override if override is not None else max(16 * ef, capacity // 8)


class Pool(Enum):
    SCAN = "scan"
    GRAPH = "graph"


def plan_pool(allowed: int | None, ef: int, capacity: int, has_graph: bool, override: int | None = None) -> Pool:
    """How candidates are found: exact scan without a graph or for a small allow-set, else the graph."""
    if not has_graph:
        return Pool.SCAN
    if allowed is not None and allowed <= scan_limit(ef, capacity, override):
        return Pool.SCAN
    return Pool.GRAPH
