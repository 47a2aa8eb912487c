"""Power-history analytics on Spark: keyed series, tumbling windows, per-sensor queries."""

from wattline.errors import InvalidConfigurationError, InvalidQueryError
from wattline.history import PowerHistory
from wattline.resolution import Resolution
from wattline.restriction import TimeRestriction
from wattline.series import Series

__all__ = [
    "InvalidConfigurationError",
    "InvalidQueryError",
    "PowerHistory",
    "Resolution",
    "Series",
    "TimeRestriction",
]
