"""Validated job settings. Defaults are the shipped configuration of the workflow."""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values
TAG_GROUP_COLUMNS = {"mood": "mood_all", "genre": "genre_main", "theme": "theme", "style": "style"}
SYMMETRIZE_MODES = ("max", "min", "mean")
TIME_RANGES = ("short_term", "medium_term", "long_term")


@dataclass(frozen=True)
class FilterConfig:
    required_groups: tuple[str, ...] = ("mood", "genre", "theme", "style")
    sample_size: int | None = None
    seed: int = 7

    def __post_init__(self):
        unknown = sorted(set(self.required_groups) - set(TAG_GROUP_COLUMNS))
        if unknown:
            raise ValueError(f"unknown tag groups {unknown}; known: {sorted(TAG_GROUP_COLUMNS)}")
        if self.sample_size is not None and self.sample_size <= 0:
            raise ValueError(f"sample_size must be positive, got {self.sample_size}")


@dataclass(frozen=True)
class KnnConfig:
    k: int = 10
    symmetrize: bool = True
    mode: str = "max"

    def __post_init__(self):
        if self.k <= 0:
            raise ValueError(f"k must be positive, got {self.k}")
        if self.mode not in SYMMETRIZE_MODES:
            raise ValueError(f"mode must be one of {SYMMETRIZE_MODES}, got {self.mode!r}")


@dataclass(frozen=True)
class CommunityConfig:
    resolution: float = 1.0
    seed: int = 42
    use_weights: bool = True
    max_rounds: int = 600  # safety limits: reaching one is an error
    max_levels: int = 64

    def __post_init__(self):
        if self.resolution <= 0:
            raise ValueError(f"resolution must be positive, got {self.resolution}")


@dataclass(frozen=True)
class LayoutConfig:
    n_neighbors: int = 15
    min_dist: float = 0.1
    seed: int = 42
    repulsion: float = 20.0  # the mean push of all points, against the mean pull of the neighbours
    tolerance: float = 0.01  # the layout has settled when points move by this part of its extent
    max_rounds: int = 300  # safety limit: reaching it is an error

    def __post_init__(self):
        if self.n_neighbors <= 1:
            raise ValueError(f"n_neighbors must exceed 1, got {self.n_neighbors}")
        if not 0.0 <= self.min_dist <= 1.0:
            raise ValueError(f"min_dist must be within 0..1, got {self.min_dist}")


@dataclass(frozen=True)
class LabelConfig:
    columns: tuple[str, ...] = ("mood_all",)
    top_n: int = 3

    def __post_init__(self):
        if self.top_n <= 0:
            raise ValueError(f"top_n must be positive, got {self.top_n}")


@dataclass(frozen=True)
class ClusterConfig:
    knn: KnnConfig = field(default_factory=KnnConfig)
    communities: CommunityConfig = field(default_factory=CommunityConfig)
    layout: LayoutConfig = field(default_factory=LayoutConfig)
    labels: LabelConfig = field(default_factory=LabelConfig)


@dataclass(frozen=True)
class EmbeddingConfig:
    name: str
    model_id: str = ""
    center: bool = True
    normalize: bool = True
    batch_size: int = 8

    def __post_init__(self):
        if self.batch_size <= 0:
            raise ValueError(f"batch_size must be positive, got {self.batch_size}")


@dataclass(frozen=True)
class PlaylistConfig:
    per_seed: int = 3
    max_seeds: int = 20
    fit_floor: float = 0.45
