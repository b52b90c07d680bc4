"""Settings with three levels: defaults, an override function, and keywords of a call, which win."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    cell: int = 8
    feature_dims: int = 32
    interval_eval: int = 10
    interval_positives: int = 5
    interval_negatives: int = 4
    c: float = 0.001
    bias_feature: float = 10.0
    cache_bytes: int = 3 << 30
    cache_examples: int = 24_000
    foreground_overlap: float = 0.7
    most_iterations: int = 1000
    tolerance: float = 1e-6
    corrections: int = 100
    most_eval_threshold: float = -1.1
    nms_threshold: float = 0.5
    mining_threshold: float = -1.002
    belief_slack: float = 0.01
    least_own_overlap: float = 0.1
    most_other_overlap: float = 0.5
    deformation_range: int = 4
    parts: int = 8
    part_size: int = 6
    softmax_beta: float = 1000.0
    context_slope: float = 1.5
    context_top: int = 50_000
    context_floor: float = -1.1
    bootstrap: int = 1000
    sign_flips: int = 100_000
    cascade_dims: int = 5
    extra_octave: bool = False
    seed: int = 3

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def make(override: Callable[[], dict] | None = None, **settings) -> Config:
    known = {f.name for f in fields(Config)}
    merged = (override() if override else {}) | settings
    if bad := set(merged) - known:
        raise ValueError(f"unknown settings: {sorted(bad)}")
    return replace(Config(), **merged)
