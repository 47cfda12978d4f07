"""Places where a user plugs in code of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orientlake.fourier import postprocess as P
from orientlake.frames import ParticleFrame
from orientlake.operators.filters import score_filter

ScoreFunction = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class ParticleSource(Protocol):
    """Anything that can give a particle table with its optics."""

    def load(self, spark: SparkSession) -> ParticleFrame: ...


class PostProcessor(Protocol):
    """From half maps (group, map, z, y, x, v, mask) to sharpened voxels, curves and a summary."""

    def process(self, maps: DataFrame, group: str, side: int, px: float) -> tuple[DataFrame, DataFrame, DataFrame]: ...


class StandardPostProcessor:
    """B factor from the Guinier line and figure-of-merit weights."""

    def __init__(self, guinier_lo: float = 10.0, adhoc_bfactor: float | None = None, lowpass: float | None = None):
        self.options = (guinier_lo, adhoc_bfactor, lowpass)

    def process(self, maps, group, side, px):
        return P.postprocess(maps, group, side, px, *self.options)


def score_images(images: DataFrame, score: ScoreFunction, schema: str, column: str | None = None, threshold: float | None = None) -> DataFrame:
    """A user's model over Arrow batches of images, and optionally only rows above a score.

    Filters on plain columns belong before this call: the optimizer cannot move
    them past the model.
    """
    scored = images.mapInArrow(score, schema)
    return scored if threshold is None else score_filter(scored, column, threshold)
