"""Typed errors."""

from __future__ import annotations


class RillError(Exception):
    """Any error of this library."""


class ShapeError(RillError, ValueError):
    """A raster or a vector of parameters has the wrong size."""


class EmptyError(ShapeError):
    """Something that needs elements has none."""


class CRSError(RillError, ValueError):
    """A coordinate reference system is unknown, unsupported or doesn't match."""


class MissingCRSError(CRSError):
    """A raster needs a coordinate reference system and has none."""


class TransformError(RillError, ValueError):
    """A transform is invalid or doesn't match."""


class MissingTransformError(TransformError):
    """A raster needs a transform and has none."""


class MissingNoDataError(RillError, ValueError):
    """A raster needs a NoData value and has none."""


class CastingError(RillError, TypeError):
    """A value can't be cast by the rule asked for."""


class OverlapError(RillError, ValueError):
    """Two things that must overlap don't."""


class FeatureError(RillError, ValueError):
    """Vector features can't be read."""


class GeometryError(FeatureError):
    """A feature's geometry is missing or of the wrong kind."""


class CoordinateError(FeatureError):
    """A coordinate isn't two or three finite numbers."""


class PolygonError(CoordinateError):
    """A polygon's ring is open or too short."""


class DurationError(RillError, ValueError):
    """A rainfall duration is not one the model has parameters for."""


class SelectionError(RillError, ValueError):
    """Segment ids that are not in the network."""


class CycleError(RillError, ValueError):
    """A flow graph returns to itself."""


class ServiceError(RillError):
    """A web service failed."""


class InvalidJSONError(ServiceError):
    """A service's answer isn't JSON."""


class MissingFieldError(ServiceError, KeyError):
    """A service's answer lacks a field."""


class TooManyProductsError(ServiceError):
    """A search matches more products than allowed."""


class NoProductsError(ServiceError):
    """A search matches nothing."""


class JobError(ServiceError):
    """A remote job failed."""


class JobTimeoutError(JobError):
    """A remote job took too long."""
