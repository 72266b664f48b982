"""Knobs of the preprocessing pipeline, with their defaults and accepted ranges."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields

from quoin.schema import STATUSES

# Closed ranges accepted for the numeric knobs (None = open end).
KNOB_RANGES = {
    "min_building_area": (1, 1000),
    "min_edge_length": (1, 2000),
    "max_edge_length": (1, 2000),
    "neighbor_threshold": (0, None),
    "f2f_height": (2, 5),
    "min_building_height": (1, 500),
    "max_building_height": (1, 500),
    "min_num_floors": (1, 150),
    "max_num_floors": (1, 150),
    "default_wwr": (0, 1),
    "default_num_floors": (1, None),
    "default_exposed_basement_frac": (0, 1),
}


@dataclass(frozen=True)
class PreprocessConfig:
    """Settings of the footprint pipeline.

    ``metric_srid`` 3857 inflates lengths by 1/cos(latitude); a UTM srid (326xx / 327xx) is the
    better choice for real cities.  ``station_filter`` is a Spark SQL predicate over station columns.
    """

    metric_srid: int = 3857
    min_building_area: float = 10.0
    min_edge_length: float = 3.0
    max_edge_length: float = 1000.0
    neighbor_threshold: float = 100.0
    f2f_height: float = 3.0
    min_building_height: float = 3.0
    max_building_height: float = 300.0
    min_num_floors: int = 1
    max_num_floors: int = 125
    default_wwr: float = 0.2
    default_num_floors: int = 2
    default_basement: str = "none"
    default_attic: str = "none"
    default_exposed_basement_frac: float = 0.25
    station_filter: str | None = "source in ('tmyx')"

    def __post_init__(self) -> None:
        for name, (low, high) in KNOB_RANGES.items():
            value = getattr(self, name)
            if (low is not None and value < low) or (high is not None and value > high):
                raise ValueError(f"{name}={value} is outside [{low}, {high}]")
        for name in ("default_basement", "default_attic"):
            if getattr(self, name) not in STATUSES:
                raise ValueError(f"{name} must be one of {STATUSES}")

    @classmethod
    def from_dict(cls, values: dict) -> "PreprocessConfig":
        """Build from a plain mapping; keys that are no knobs are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    @property
    def default_height(self) -> float:
        return self.default_num_floors * self.f2f_height

    def fingerprint(self) -> str:
        """Short stable hash, used to key reusable outputs."""
        text = json.dumps(asdict(self), sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class HourlyConfig:
    """Which hourly variables to report and where they go."""

    variables: tuple[str, ...] = ()
    output_mode: str = "dataframes-and-filerefs"

    def __post_init__(self) -> None:
        if self.output_mode not in ("dataframes-and-filerefs", "fileref-only", "dataframes-only"):
            raise ValueError(f"unknown output mode {self.output_mode!r}")

    @property
    def writes_files(self) -> bool:
        return self.output_mode != "dataframes-only"

    @property
    def returns_frame(self) -> bool:
        return self.output_mode != "fileref-only"
