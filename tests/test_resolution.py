import pytest

from wattline.errors import InvalidConfigurationError
from wattline.history import PowerHistory
from wattline.resolution import Resolution, default_resolutions, duration_ms, resolutions_from_properties
from wattline.restriction import DAY_MS


@pytest.mark.parametrize(
    ("text", "ms"),
    [
        ("PT1M", 60_000),
        ("PT1H", 3_600_000),
        ("P30D", 30 * DAY_MS),
        ("P2DT3H4M5.006S", 2 * DAY_MS + 11_045_006),
        ("pt0.5s", 500),
        ("PT1,25S", 1250),
        ("-PT1S", -1000),
        ("PT-1M", -60_000),
        ("PT0.0009S", 0),
        ("-PT0.0001S", -1),
    ],
)
def test_durations(text, ms):
    assert duration_ms(text) == ms


@pytest.mark.parametrize("text", ["", "P", "PT", "P1DT", "1H", "P1H", "PT1D", "PT1.5M", "P1Y", "PT1S1M", "P1W"])
def test_malformed_durations(text):
    with pytest.raises(InvalidConfigurationError):
        duration_ms(text)


def test_defaults():
    assert default_resolutions() == [
        Resolution("one-min-aggregation", "oneMinAggregation", "minutely", 60_000, 30 * DAY_MS),
        Resolution("one-hour-aggregation", "oneHourAggregation", "hourly", 3_600_000, None),
    ]


def test_names_are_collected_once_and_other_keys_ignored():
    found = resolutions_from_properties(
        {
            "num.threads": "1",
            "timeWindows.quarter_1.duration": "PT15M",
            "timeWindows.bad-name.duration": "PT15M",
            "timeWindows.quarter_1.kafka": "feed",
            "timeWindows.quarter_1.cassandra": "quarters",
        }
    )
    assert found == [Resolution("feed", "quarters", None, 900_000, None)]


def test_missing_and_empty_windows_are_rejected():
    with pytest.raises(InvalidConfigurationError):
        resolutions_from_properties({"timeWindows.a.kafka": "f", "timeWindows.a.cassandra": "t"})
    with pytest.raises(InvalidConfigurationError):
        Resolution("f", "t", None, 0)


@pytest.mark.parametrize(("size", "delay"), [(60_000, DAY_MS - 60_000), (DAY_MS, 0), (7 * DAY_MS, 0)])
def test_watermark_delay(size, delay):
    assert Resolution("f", "t", None, size).watermark_delay_ms == delay


def test_resolution_names_skip_only_the_unnamed_one(spark):
    resolutions = [Resolution("a", "a", "x", 1), Resolution("b", "b", None, 1), Resolution("c", "c", "y", 1)]
    rows = PowerHistory("/nowhere", resolutions).resolution_names(spark).collect()
    assert [r.resolution for r in rows] == ["x", "y"]
