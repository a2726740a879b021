"""Parameters of the engine."""

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    k: int = 5
    neighbours: int = 5
    seed: int = 42
    iterations: int = 1000
    threshold: float = 0.5
    divergence_bounds: tuple[float, ...] = (1.0, 0.7, 0.5, 0.3, 0.2, 0.1)
    identity_bounds: tuple[float, ...] = (1.0, 0.9, 0.7, 0.5, 0.3, 0.2)
    divergent_below: float = 0.3
    block_rows: int = 4096


CONFIG = EngineConfig()
