"""Settings of a model build, filter selections and session options."""

from __future__ import annotations

import json
from dataclasses import dataclass

from shelfspan import fixed_values as fv


@dataclass(frozen=True)
class ModelConfig:
    """Business rules that vary between networks."""

    storage_area: str = fv.STORAGE_AREA
    unassigned_area: str = fv.UNASSIGNED_AREA
    canonical_areas: tuple[str, ...] = fv.CANONICAL_AREAS
    branch_overrides: tuple[tuple[str, int, str, str], ...] = fv.BRANCH_OVERRIDES
    # What a group without a single number sums to: "zero" or "null".
    all_null_sum: str = "zero"
    overload_ratio: float = 1.0
    risk_ratio: float = 0.9
    plan_tolerance: float = 0.01

    def __post_init__(self) -> None:
        if self.all_null_sum not in ("zero", "null"):
            raise ValueError("all_null_sum is either 'zero' or 'null'")


@dataclass(frozen=True)
class SourceNames:
    """By which names and words inputs are found; words are looked for in lower case."""

    realloc_word: str = fv.REALLOC_WORD
    physical_word: str = "capacity"
    branches_prefix: str = fv.BRANCHES_PREFIX
    branch_stock_word: str = fv.BRANCH_STOCK_WORD
    stock_words: tuple[str, ...] = fv.STOCK_WORDS
    warehouse_word: str = fv.WAREHOUSE_WORD
    stock_export: str = fv.STOCK_EXPORT_FILE
    stock_fallbacks: tuple[str, ...] = fv.STOCK_FALLBACK_FILES
    realloc: str = fv.REALLOC_FILE
    capacity_parts: tuple[str, ...] = ("capacity_parts", "kapacita")
    capacity: str = fv.CAPACITY_FILE
    area_map: str = fv.AREA_MAP_FILE
    code_map: str = fv.CODE_MAP_FILE

    @classmethod
    def from_json(cls, text: str) -> SourceNames:
        """Settings as a JSON object; what it leaves out keeps its default, unknown keys are an error."""
        given = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


@dataclass(frozen=True)
class FilterSpec:
    """A reader's selection; an empty tuple does not restrict anything."""

    areas: tuple[str, ...] = ()
    branches: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    # None: both kinds, True: flagged locations only, False: the others only.
    is_realloc: bool | None = None
    # Attributes of the physical source, restricting unflagged locations only.
    markings: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    # Attributes of the reallocation source, restricting flagged locations only.
    descriptors: tuple[str, ...] = ()
    realloc_categories: tuple[str, ...] = ()


# Options worth setting on any session running these plans.  Splitting of skewed join
# partitions and run-time coalescing are what the row-level joins lean on.
SESSION_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
