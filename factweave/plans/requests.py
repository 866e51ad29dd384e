"""Driver-side plans: requests validated, canonical, and compiled to the projections they need."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Which projection answers each selector of a request.
SELECTORS = {
    "paths": "mapped_paths", "symbols": "symbol_entities", "components": "components", "packages": "package_entrypoints",
    "artifacts": "artifact_routes", "search": "search_domain", "focus": "search_domain",
}
DIRECTIONS = ("downstream", "upstream", "both")
PROFILES = {"exact": ("exact",), "change": ("exact", "candidate"), "architecture": ("exact", "candidate"), "audit": ("exact", "candidate", "conservative")}


@dataclass(frozen=True)
class QueryRequest:
    """A query: defaults as documented; bad values are refused when it is made."""

    paths: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    components: tuple[str, ...] = ()
    packages: tuple[str, ...] = ()
    artifacts: tuple[str, ...] = ()
    focus: tuple[str, ...] = ()
    search: str = ""
    depth: int = 1
    direction: str = "both"
    search_limit: int = 8
    test_depth: int = 8

    def __post_init__(self):
        if self.direction not in DIRECTIONS:
            raise ValueError(f"direction {self.direction!r}")
        if not 0 <= self.depth <= 64 or not 0 <= self.test_depth <= 64 or self.search_limit < 1:
            raise ValueError("depth, test_depth or search_limit out of range")

    def projections(self) -> list[str]:
        """The distinct projections the selectors need, in byte order."""
        return sorted({p for s, p in SELECTORS.items() if getattr(self, s)})


@dataclass(frozen=True)
class PathRequest:
    source: str
    target: str
    level: str = "file"
    direction: str = "downstream"
    relations: tuple[str, ...] = ()
    max_depth: int = 8
    max_paths: int = 8

    def __post_init__(self):
        if self.level not in ("component", "file", "symbol") or self.direction not in DIRECTIONS:
            raise ValueError("level or direction")
        if not 1 <= self.max_depth <= 64 or not 1 <= self.max_paths <= 100:
            raise ValueError("max_depth or max_paths out of range")


def digest(request) -> str:
    """Identity of a plan: canonical JSON with sorted keys and sorted selector lists."""
    body = {k: sorted(v) if isinstance(v, tuple) else v for k, v in asdict(request).items()}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass
class Memo:
    """Sub-plans shared by digest: each is built once however many requests need it."""

    made: dict[str, DataFrame] = field(default_factory=dict)

    def get(self, key: str, make) -> DataFrame:
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]


def page(rows: DataFrame, kind: str, order: list, quota: int, offset: int = 0) -> DataFrame:
    """Per kind the rows after ``offset``, ``quota`` at most; ranks need only the first of each kind."""
    at = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return rows.withColumn("at", at).where((F.col("at") > offset) & (F.col("at") <= offset + quota)).drop("at")


def context(rows: DataFrame, profile: str, max_distance: int | None = None) -> DataFrame:
    """Rows whose confidence a profile shows, up to a distance from the seed."""
    keep = F.col("confidence").isin(*PROFILES[profile])
    return rows.where(keep & (F.col("distance") <= max_distance) if max_distance is not None else keep)


def diagnostics(expected: DataFrame, present: DataFrame, code: str, severity: str = "error") -> DataFrame:
    """A diagnostic for each expected key that nothing backs (empty layer, component, route)."""
    return expected.join(present.select("key").distinct(), "key", "left_anti").select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "key")
