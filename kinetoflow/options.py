"""Options of all operators with their defaults."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields, replace

MODES = ("extension", "overlap", "coverage", "coverage_unedited", "editing")


@dataclass(frozen=True)
class EngineOptions:
    """Typed options; values given as text are cast, unknown names and values that do not fit raise an error."""

    seed: int = 10
    mismatch_max: int = 1
    min_segment: int = 10
    min_percent: float = 75.0
    overlap_min: int = 10
    extension_min: int = 10
    filter_esd: int = 0
    mode: str = "extension"
    search_depth: int = 1
    max_path: int = 75
    start_share: float = 0.4
    min_orf_length: int = 70
    genetic_code: str = "default"
    each_orf_alignment: bool = False
    in_ref: str = ""
    in_lib: str = ""
    out_prefix: str = "out"
    # guide search
    gu_max: int = 14
    mm_max: int = 4
    min_score: int = 32
    min_length: int = 26
    anchor: int = 5
    wobble_anchor: bool = False
    flank: int = 50

    def __post_init__(self) -> None:
        if self.extension_min < 0 or self.overlap_min < 0:
            raise ValueError("overlap_min and extension_min must not be negative")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.seed < 1:
            raise ValueError("seed must be positive")

    def set(self, **values: object) -> EngineOptions:
        kinds = {f.name: type(f.default) for f in fields(self)}
        if unknown := set(values) - set(kinds):
            raise KeyError(f"unknown options: {', '.join(sorted(unknown))}")
        cast = lambda kind, v: v.lower() in ("1", "true", "yes") if kind is bool and isinstance(v, str) else kind(v)
        return replace(self, **{k: cast(kinds[k], v) for k, v in values.items()})


def from_arguments(arguments: list[str]) -> EngineOptions:
    """Options from ``--name value`` pairs."""
    parser = argparse.ArgumentParser(prog="kinetoflow")
    for f in fields(EngineOptions):
        parser.add_argument(f"--{f.name}")
    given = {k: v for k, v in vars(parser.parse_args(arguments)).items() if v is not None}
    return EngineOptions().set(**given)
