"""Settings of an analysis, checked when they are made, and used by every stage."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path


def prepare_environment(data_dir: str = ".", output_dir: str = "output", verbose: bool = False) -> tuple[str, str]:
    """Absolute places of input and output (URIs stay as they are); the output folder is made, the log is set up."""
    logging.basicConfig(level=logging.INFO if verbose else logging.WARNING)
    place = lambda p: p if "://" in p else str(Path(p).expanduser().resolve())
    if "://" not in output_dir:
        Path(place(output_dir)).mkdir(parents=True, exist_ok=True)
    return place(data_dir), place(output_dir)


@dataclass(frozen=True)
class Settings:
    data_dir: str = "."
    output_dir: str = "output"
    n_iterations: int = 5000
    confidence: float = 0.95
    alpha: float = 0.05
    fdr_method: str = "fdr_bh"
    mdr_threshold: int = 3
    min_support: float = 0.1
    min_lift: float = 1.0
    seed: int = 42
    null_is_one: bool = False
    classes: dict[str, list[str]] | None = field(default=None, hash=False)

    def __post_init__(self) -> None:
        for ok, what in (
            (0 < self.confidence < 1, "confidence has to be between 0 and 1"),
            (0 < self.alpha < 1, "alpha has to be between 0 and 1"),
            (self.n_iterations >= 100, "at least 100 iterations are needed"),
            (self.mdr_threshold >= 1, "the threshold has to be 1 or more"),
            (0 < self.min_support <= 1, "support has to be above 0, and 1 at most"),
            (self.fdr_method in ("fdr_bh", "bonferroni", "holm"), f"unknown method: {self.fdr_method}"),
        ):
            if not ok:
                raise ValueError(what)
