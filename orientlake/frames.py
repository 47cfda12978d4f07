"""A particle table with its optics table and the roles its columns play."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

# Column names under which each role may appear, best first.
IMAGE_NAMES = ("image_name", "rlnImageName")
MICROGRAPH_NAMES = ("micrograph", "rlnMicrographName", "image_name", "rlnImageName")
COORDINATE_NAMES = (("x", "y"), ("rlnCoordinateX", "rlnCoordinateY"),
                    ("rlnMicrographCoordinatesX", "rlnMicrographCoordinatesY"))
ANGLE_NAMES = (("rot", "tilt", "psi"), ("rlnAngleRot", "rlnAngleTilt", "rlnAnglePsi"))
SHIFT_NAMES = (("dx", "dy"), ("rlnOriginXAngst", "rlnOriginYAngst"))
OPTICS_NAMES = ("optics_group", "rlnOpticsGroup")
HALF_NAMES = ("half", "rlnRandomSubset")


class MissingColumns(KeyError):
    """Raised before any work starts when a table lacks needed columns."""


def require_columns(df: DataFrame, names: Iterable[str], where: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns in {where}: {missing}; it has {df.columns[:80]}")


def _first(columns: set[str], candidates):
    for candidate in candidates:
        wanted = (candidate,) if isinstance(candidate, str) else candidate
        if columns.issuperset(wanted):
            return candidate
    return None


@dataclass(frozen=True)
class ColumnRoles:
    image: str | None
    micrograph: str | None
    coordinates: tuple[str, str] | None
    angles: tuple[str, str, str] | None
    shifts: tuple[str, str] | None
    optics: str | None
    half: str | None

    @classmethod
    def of(cls, df: DataFrame) -> "ColumnRoles":
        columns = set(df.columns)
        return cls(*(_first(columns, c) for c in (
            IMAGE_NAMES, MICROGRAPH_NAMES, COORDINATE_NAMES, ANGLE_NAMES,
            SHIFT_NAMES, OPTICS_NAMES, HALF_NAMES)))

    def place(self) -> tuple[str, str, str]:
        """Micrograph and coordinate columns, or an error naming what is missing."""
        if self.micrograph is None:
            raise MissingColumns(f"no micrograph column; tried {MICROGRAPH_NAMES}")
        if self.coordinates is None:
            raise MissingColumns(f"no coordinate columns; tried {COORDINATE_NAMES}")
        return (self.micrograph, *self.coordinates)


@dataclass(frozen=True)
class ParticleFrame:
    particles: DataFrame
    optics: DataFrame | None = None

    @property
    def roles(self) -> ColumnRoles:
        return ColumnRoles.of(self.particles)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark orders NaN above every number; a missing score must be NULL instead."""
    return df.withColumns({
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    })


def finite(col) -> F.Column:
    """True for numbers that are neither NULL, NaN nor infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))
