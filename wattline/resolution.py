"""Window resolutions and their property-file form."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

from wattline.errors import InvalidConfigurationError
from wattline.restriction import DAY_MS

KEY_PREFIX = "timeWindows"

# The settings that apply when nothing else is configured.
DEFAULT_PROPERTIES = {
    "timeWindows.oneMin.kafka": "one-min-aggregation",
    "timeWindows.oneMin.cassandra": "oneMinAggregation",
    "timeWindows.oneMin.api": "minutely",
    "timeWindows.oneMin.duration": "PT1M",
    "timeWindows.oneMin.ttl": "P30D",
    "timeWindows.oneHour.kafka": "one-hour-aggregation",
    "timeWindows.oneHour.cassandra": "oneHourAggregation",
    "timeWindows.oneHour.api": "hourly",
    "timeWindows.oneHour.duration": "PT1H",
}

_UNIT_SECONDS = {"days": 86_400, "hours": 3_600, "minutes": 60, "seconds": 1}
_DURATION = re.compile(
    r"(?P<sign>[+-])?P(?:(?P<days>[+-]?\d+)D)?"
    r"(?P<time>T(?:(?P<hours>[+-]?\d+)H)?(?:(?P<minutes>[+-]?\d+)M)?"
    r"(?:(?P<seconds>[+-]?\d+(?:[.,]\d{0,9})?)S)?)?",
    re.IGNORECASE | re.ASCII,
)


def duration_ms(text: str) -> int:
    """Milliseconds of an ISO-8601 day-time duration (``PnDTnHnMn.nS``), rounded down."""
    match = _DURATION.fullmatch(text.strip())
    amounts = {u: match[u] for u in _UNIT_SECONDS if match[u] is not None} if match else {}
    # At least one amount is needed, and a "T" must be followed by one.
    if not amounts or (match["time"] and not amounts.keys() - {"days"}):
        raise InvalidConfigurationError(f"Not an ISO-8601 duration: {text!r}")
    seconds = sum(
        Fraction(amount.replace(",", ".").removesuffix(".")) * _UNIT_SECONDS[unit]
        for unit, amount in amounts.items()
    )
    if match["sign"] == "-":
        seconds = -seconds
    return int(seconds * 1000 // 1)


@dataclass(frozen=True)
class Resolution:
    """One tumbling-window series: its feed, table, public name, size and expiry."""

    feed: str
    table: str
    api: str | None
    size_ms: int
    ttl_ms: int | None = None

    def __post_init__(self) -> None:
        if self.size_ms <= 0:
            raise InvalidConfigurationError("A window must be longer than zero milliseconds.")
        if self.ttl_ms is not None and self.ttl_ms <= 0:
            raise InvalidConfigurationError("A time-to-live must be longer than zero milliseconds.")

    @property
    def watermark_delay_ms(self) -> int:
        """Records are accepted until event time passes max(24 h, size) after the window start.

        Spark closes a window once the watermark reaches its *end*, hence minus the size.
        """
        return max(DAY_MS, self.size_ms) - self.size_ms


def resolutions_from_properties(properties: Mapping[str, str]) -> list[Resolution]:
    """Resolutions named by ``timeWindows.<name>.{kafka,cassandra,api,duration,ttl}`` keys."""
    names: dict[str, None] = {}
    for key in properties:
        match = re.match(rf"{KEY_PREFIX}\.(\w+)\.", key)
        if match:
            names[match[1]] = None

    resolutions = []
    for name in names:
        setting = {
            field: properties.get(f"{KEY_PREFIX}.{name}.{field}")
            for field in ("kafka", "cassandra", "api", "duration", "ttl")
        }
        for field in ("kafka", "cassandra", "duration"):
            if setting[field] is None:
                raise InvalidConfigurationError(f"Missing {KEY_PREFIX}.{name}.{field}")
        resolutions.append(
            Resolution(
                feed=setting["kafka"],
                table=setting["cassandra"],
                api=setting["api"],
                size_ms=duration_ms(setting["duration"]),
                ttl_ms=None if setting["ttl"] is None else duration_ms(setting["ttl"]),
            )
        )
    return resolutions


def default_resolutions() -> list[Resolution]:
    return resolutions_from_properties(DEFAULT_PROPERTIES)
