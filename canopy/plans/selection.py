"""A declarative selection of features: what a training run uses, from configuration to one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from canopy.operators import filters, samplers

SAMPLERS = ("all", "random", "equidistant", "movement")


@dataclass(frozen=True)
class Selection:
    """Filters apply in a fixed order; the least count comes last, since it counts rows that survive the others."""

    feature_types: tuple[str, ...] = ("body",)
    min_confidence: float = 0.5
    min_width: int | None = None
    max_width: int | None = None
    min_height: int | None = None
    max_height: int | None = None
    min_count: int = 1
    sampler: str = "equidistant"
    n: int = 15
    movement_side: float = 0.1
    seed: int = 0

    def __post_init__(self) -> None:
        if self.sampler not in SAMPLERS:
            raise ValueError(f"sampler must be one of {', '.join(SAMPLERS)}")

    def filtered(self, tff: DataFrame, videos: filters.Ids) -> DataFrame:
        return (
            tff.transform(filters.videos(videos))
            .transform(filters.cached)
            .transform(filters.associated)
            .transform(filters.feature_types(self.feature_types, tff))
            .transform(filters.confidence(self.min_confidence))
            .transform(filters.bbox(self.min_width, self.max_width, self.min_height, self.max_height))
            .transform(filters.min_count(self.min_count))
        )

    def sampled(self, rows: DataFrame) -> DataFrame:
        if self.sampler == "random":
            return samplers.random(rows, self.n, self.seed)
        if self.sampler == "equidistant":
            return samplers.equidistant(rows, self.n)
        if self.sampler == "movement":
            return samplers.movement(rows, self.n, self.movement_side, self.seed)
        return rows

    def run(self, tff: DataFrame, videos: filters.Ids) -> DataFrame:
        """The five columns that later steps use."""
        return self.sampled(self.filtered(tff, videos)).select("tracking_frame_feature_id", "video_id", "tracking_id", "frame_nr", "feature_type")
