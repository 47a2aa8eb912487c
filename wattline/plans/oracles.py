"""The same queries in SQL, on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from wattline.plans import catalog
from wattline.plans.catalog import (
    A_LITTLE_LATE_MS,
    AS_OF,
    BATCHES,
    DAY_MS,
    FIRST_HOUR,
    HOUR_MS,
    LAST,
    LATER,
    MINUTE_MS,
    TTL_MS,
)
from wattline.plans.incremental import DELAY_EVERY, DELAY_SHARE, LOOKED_UP, MESSAGE_DELAY_MS


def _single(value: str) -> str:
    return f"CAST(CAST({value} AS REAL) AS DOUBLE)"


def _raw(identifier: str) -> str:
    return (
        f'SELECT CAST({identifier} AS VARCHAR) AS identifier, epoch_us(ts) // 1000 AS "timestamp", '
        f'"value" AS "valueInW" FROM events'
    )


RAW = _raw("user_id")
DENSE = _raw("event_type")
GROUPED = f"""
    SELECT identifier, "timestamp" // {HOUR_MS} * {HOUR_MS} AS "timestamp", count(*) AS "count",
           round(sum("valueInW"), 6) AS "sumInW", {_single('avg("valueInW")')} AS "averageInW"
    FROM ({DENSE}) GROUP BY ALL"""
LINEITEM = """
    SELECT CAST(l_suppkey AS VARCHAR) AS identifier, epoch_us(l_shipdate) // 1000 AS "timestamp",
           l_extendedprice AS "valueInW" FROM lineitem"""
STORED_LINEITEM = """
    SELECT identifier, "timestamp", "valueInW" FROM (
        SELECT CAST(l_suppkey AS VARCHAR) AS identifier, epoch_us(l_shipdate) // 1000 AS "timestamp",
               l_extendedprice AS "valueInW",
               row_number() OVER (PARTITION BY l_suppkey, l_shipdate
                                  ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS recency
        FROM lineitem) WHERE recency = 1"""
COMBINED = f'{DENSE} UNION ALL SELECT identifier, "timestamp", "sumInW" AS "valueInW" FROM ({GROUPED})'


def _windows(source: str, size: int, cut: Callable[[str], str] = _single) -> str:
    return f"""
    SELECT identifier, "timestamp" // {size} * {size} AS "startTimestamp",
           "timestamp" // {size} * {size} + {size} AS "endTimestamp", count(*) AS "count",
           {cut('avg("valueInW")')} AS mean, {cut('var_pop("valueInW")')} AS "populationVariance",
           min("valueInW") AS "min", max("valueInW") AS "max"
    FROM ({source}) GROUP BY ALL"""


HOURLY = _windows(RAW, HOUR_MS)
EXACT_HOURLY = _windows(RAW, HOUR_MS, cut=lambda value: value)


def _where(source: str, condition: str) -> str:
    return f"SELECT * FROM ({source}) WHERE {condition}"


def _identifiers(source: str) -> str:
    return f"SELECT DISTINCT identifier FROM ({source})"


def _count(source: str) -> str:
    return f'SELECT identifier, count(*) AS "count" FROM ({source}) GROUP BY identifier'


def _total(source: str) -> str:
    return f'SELECT count(*) AS "count" FROM ({source})'


def _ends(source: str, time: str, n: int, direction: str) -> str:
    return f"""
    SELECT * EXCLUDE (position) FROM (
        SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY "{time}" {direction}) AS position
        FROM ({source})) WHERE position <= {n}"""


def _trend(source: str, time: str, value: str, n: int) -> str:
    return f"""
    WITH ranked AS (
        SELECT identifier, "{value}" AS v,
               row_number() OVER (PARTITION BY identifier ORDER BY "{time}") AS oldest,
               row_number() OVER (PARTITION BY identifier ORDER BY "{time}" DESC) AS newest
        FROM ({source})),
    means AS (
        SELECT identifier, avg(v) FILTER (WHERE oldest <= {n}) AS first_mean,
               avg(v) FILTER (WHERE newest <= {n}) AS last_mean
        FROM ranked GROUP BY identifier)
    SELECT identifier, {_single("CASE WHEN first_mean > 0 THEN last_mean / first_mean ELSE 1 END")} AS trend
    FROM means"""


def _distribution(source: str, value: str, n: int) -> str:
    bound = "list_reduce(list_prepend(low, list_transform(range({}), lambda i: width)), lambda a, b: a + b)"
    return f"""
    WITH ranges AS (
        SELECT identifier, min("{value}") AS low, (max("{value}") - min("{value}")) / {n} AS width
        FROM ({source}) GROUP BY identifier),
    counts AS (
        SELECT s.identifier,
               CASE WHEN width > 0 THEN CAST(least(trunc(("{value}" - low) / width), {n - 1}) AS INTEGER)
                    ELSE 0 END AS bucket,
               count(*) AS elements
        FROM ({source}) s JOIN ranges r ON s.identifier = r.identifier GROUP BY ALL),
    skeleton AS (
        SELECT identifier, CAST(b AS INTEGER) AS bucket, {bound.format("b")} AS lower,
               {bound.format("b + 1")} AS upper
        FROM ranges, unnest(range({n})) AS t(b))
    SELECT k.identifier, k.bucket, k.lower, k.upper, CAST(coalesce(c.elements, 0) AS BIGINT) AS elements
    FROM skeleton k LEFT JOIN counts c ON k.identifier = c.identifier AND k.bucket = c.bucket"""


_IN_RANGE = f'"timestamp" >= {FIRST_HOUR} AND "timestamp" <= {LAST}'
_AFTER_IN_RANGE = f'"timestamp" > {FIRST_HOUR} AND "timestamp" <= {LAST}'
_DAMAGED = f"""
    SELECT CASE WHEN "valueInW" < 480.0 THEN identifier END AS identifier,
           "timestamp" - {FIRST_HOUR} AS "timestamp",
           CASE WHEN "valueInW" >= 1.0 THEN "valueInW" END AS "valueInW"
    FROM ({RAW})"""
_REJECTED = f"""
    SELECT *, CASE WHEN identifier IS NULL THEN 'missing identifier'
                   WHEN "timestamp" IS NULL THEN 'missing timestamp'
                   WHEN "timestamp" < 0 THEN 'negative timestamp'
                   WHEN "valueInW" IS NULL THEN 'missing valueInW' END AS reason
    FROM ({_DAMAGED})"""
_BLOCK = 10 * DAY_MS
_BATCHED = f"""
    SELECT CAST(user_id AS VARCHAR) AS identifier, epoch_us(ts) // 1000 AS "timestamp", "value" AS "valueInW", event_type,
           event_id // ((SELECT max(event_id) FROM events) // {BATCHES} + 1) AS batch
    FROM events"""
# Clicks of the last group are weeks late and dropped, views are some hours late and counted.
_AFTER_DELAYS = f"""
    SELECT identifier, "valueInW", CASE WHEN batch = {BATCHES - 1} AND event_type = 'view'
                                        THEN "timestamp" - {A_LITTLE_LATE_MS} ELSE "timestamp" END AS "timestamp"
    FROM ({_BATCHED}) WHERE NOT (batch = {BATCHES - 1} AND event_type = 'click')"""
_RAW_AND_GROUPED = f'{RAW} UNION ALL SELECT identifier, "timestamp", "sumInW" AS "valueInW" FROM ({GROUPED})'
_LAST_EVENT = "(SELECT max(event_id) FROM events)"
_DISORDERED = f"""
    SELECT event_type AS identifier, epoch_us(ts) // 1000 AS "timestamp", "value" AS "valueInW",
           event_id * 2 + event_id % 2
           + CASE WHEN event_id % {DELAY_EVERY} = 0 THEN {_LAST_EVENT} // {DELAY_SHARE} ELSE 0 END * 2 AS arrival
    FROM events"""
_JUDGED_VALUES = f"""
    SELECT *, "timestamp" // {HOUR_MS} * {HOUR_MS} + {DAY_MS} <= "streamTime" AS late
    FROM (SELECT *, max("timestamp") OVER (ORDER BY arrival, "timestamp" ROWS UNBOUNDED PRECEDING) AS "streamTime"
          FROM ({_DISORDERED}))"""
_JUDGED = f'SELECT identifier, "timestamp", arrival, "streamTime", late FROM ({_JUDGED_VALUES})'

ORACLES: dict[str, str] = {
    "windowed_minutely": _windows(RAW, MINUTE_MS),
    "windowed_hourly": HOURLY,
    "windowed_hourly_dense": _windows(DENSE, HOUR_MS),
    "windowed_daily_lineitem": _windows(LINEITEM, DAY_MS),
    "aggregated_as_power": f'SELECT identifier, "timestamp", "sumInW" AS "valueInW" FROM ({GROUPED})',
    "combined": COMBINED,
    "windowed_combined_hourly": _windows(COMBINED, HOUR_MS),
    "windowed_combined_minutely": _windows(COMBINED, MINUTE_MS),
    "identifiers": _identifiers(RAW),
    "identifiers_aggregated": _identifiers(GROUPED),
    "identifiers_windowed": _identifiers(HOURLY),
    "range_all": RAW,
    "range_from": _where(RAW, f'"timestamp" >= {LATER}'),
    "range_to": _where(RAW, f'"timestamp" <= {LATER}'),
    "range_after": _where(RAW, f'"timestamp" > {LATER}'),
    "range_from_to": _where(RAW, _IN_RANGE),
    "range_from_after": _where(RAW, f'"timestamp" >= {FIRST_HOUR} AND "timestamp" > {LATER}'),
    "range_aggregated": _where(GROUPED, _AFTER_IN_RANGE),
    "range_windowed": _where(HOURLY, f'"startTimestamp" >= {FIRST_HOUR} AND "startTimestamp" <= {LAST}'),
    "range_of_identifier": _where(DENSE, "identifier = 'click'"),
    "latest_one": _ends(RAW, "timestamp", 1, "DESC"),
    "latest_n": _ends(RAW, "timestamp", 5, "DESC"),
    "latest_in_range": _ends(_where(RAW, _IN_RANGE), "timestamp", 3, "DESC"),
    "latest_many": _ends(DENSE, "timestamp", 1500, "DESC"),
    "latest_aggregated": _ends(GROUPED, "timestamp", 5, "DESC"),
    "latest_windowed": _ends(HOURLY, "startTimestamp", 5, "DESC"),
    "latest_stored_lineitem": _ends(STORED_LINEITEM, "timestamp", 10, "DESC"),
    "earliest_one": _ends(RAW, "timestamp", 1, "ASC"),
    "earliest_n": _ends(RAW, "timestamp", 5, "ASC"),
    "earliest_many": _ends(DENSE, "timestamp", 250, "ASC"),
    "trend_raw": _trend(RAW, "timestamp", "valueInW", 10),
    "trend_one_point": _trend(RAW, "timestamp", "valueInW", 1),
    "trend_in_range": _trend(_where(RAW, _AFTER_IN_RANGE), "timestamp", "valueInW", 3),
    "trend_many_points": _trend(DENSE, "timestamp", "valueInW", 150),
    "trend_aggregated": _trend(GROUPED, "timestamp", "sumInW", 10),
    "trend_windowed": _trend(EXACT_HOURLY, "startTimestamp", "mean", 10),
    "trend_stored_lineitem": _trend(STORED_LINEITEM, "timestamp", "valueInW", 10),
    "value_range": f'SELECT identifier, min("valueInW") AS "min", max("valueInW") AS "max" FROM ({RAW}) GROUP BY ALL',
    "distribution_raw": _distribution(RAW, "valueInW", 4),
    "distribution_in_range": _distribution(_where(RAW, _IN_RANGE), "valueInW", 7),
    "distribution_dense": _distribution(DENSE, "valueInW", 50),
    "distribution_shuffled": _distribution(RAW, "valueInW", 10),
    "distribution_aggregated": _distribution(GROUPED, "sumInW", 4),
    "distribution_windowed": _distribution(HOURLY, "mean", 4),
    "distribution_stored_lineitem": _distribution(STORED_LINEITEM, "valueInW", 10),
    "count_in_range": _count(_where(RAW, _IN_RANGE)),
    "count_in_range_aggregated": _count(_where(GROUPED, _AFTER_IN_RANGE)),
    "count_in_range_windowed": _count(_where(HOURLY, f'"startTimestamp" >= {FIRST_HOUR}')),
    "total_count": _total(RAW),
    "total_count_aggregated": _total(GROUPED),
    "total_count_windowed": _total(HOURLY),
    "total_count_stored_lineitem": _total(STORED_LINEITEM),
    "upsert_latest": STORED_LINEITEM,
    "upsert_stored": STORED_LINEITEM,
    "upsert_late_rows": f"""
        WITH corrections AS (
            SELECT CAST(l_suppkey AS VARCHAR) AS identifier, epoch_us(l_shipdate) // 1000 AS "timestamp",
                   -max(l_extendedprice) AS value
            FROM lineitem WHERE l_quantity <= 1 AND l_discount = 0 GROUP BY ALL)
        SELECT identifier, "timestamp", coalesce(value, "valueInW") AS "valueInW"
        FROM ({STORED_LINEITEM}) LEFT JOIN corrections USING (identifier, "timestamp")""",
    "upsert_stored_aggregated": GROUPED,
    "ttl_view": _where(HOURLY, f'"startTimestamp" // {_BLOCK} * {_BLOCK} + {_BLOCK + TTL_MS} > {AS_OF}'),
    "quarantine_accepted": f"SELECT * EXCLUDE (reason) FROM ({_REJECTED}) WHERE reason IS NULL",
    "quarantine_rejected": _where(_REJECTED, "reason IS NOT NULL"),
    "quarantine_text": f"""
        SELECT concat_ws(',', identifier, CASE WHEN "valueInW" > 450.0 THEN 'soon' ELSE CAST("timestamp" AS VARCHAR) END,
                         "valueInW") || CASE WHEN "valueInW" < 50.0 THEN ',more' ELSE '' END AS line,
               'undecodable' AS reason
        FROM ({RAW}) WHERE "valueInW" < 50.0 OR "valueInW" > 450.0""",
    "reconciliation": f"""
        SELECT identifier, received, stored, received - stored AS difference
        FROM (SELECT identifier, count(*) AS received FROM ({LINEITEM}) GROUP BY identifier)
        JOIN (SELECT identifier, count(*) AS stored FROM ({STORED_LINEITEM}) GROUP BY identifier)
        USING (identifier)""",
    "reconciliation_total": f"""
        SELECT received, stored, received - stored AS difference
        FROM (SELECT count(*) AS received FROM ({LINEITEM})), (SELECT count(*) AS stored FROM ({STORED_LINEITEM}))""",
    "stream_windowed_hourly": HOURLY,
    "stream_windowed_minutely": _windows(RAW, MINUTE_MS),
    "stream_windowed_combined": _windows(COMBINED, HOUR_MS),
    "stream_change_feed": HOURLY,
    "stream_raw_store": RAW,
    "stream_aggregated_store": GROUPED,
    "stream_windowed_late": _windows(_AFTER_DELAYS, HOUR_MS),
    "stream_change_feed_updates": f"""
        SELECT identifier, "timestamp" // {HOUR_MS} * {HOUR_MS} AS "startTimestamp",
               count(DISTINCT batch) AS published, count(*) AS "count"
        FROM ({_BATCHED}) GROUP BY ALL""",
    "stream_reconciliation": f"""
        SELECT identifier, count(*) + count(*) FILTER (WHERE batch = 2) AS received,
               count(DISTINCT "timestamp") AS stored,
               count(*) + count(*) FILTER (WHERE batch = 2) - count(DISTINCT "timestamp") AS difference
        FROM ({_BATCHED}) GROUP BY identifier""",
    "stream_topology": " UNION ALL ".join(
        f"SELECT '{name}' AS series, identifier, count(*) AS records FROM ({source}) GROUP BY identifier"
        for name, source in (
            ("raw", RAW),
            ("aggregated", GROUPED),
            ("minutely", _windows(_RAW_AND_GROUPED, MINUTE_MS)),
            ("hourly", _windows(_RAW_AND_GROUPED, HOUR_MS)),
        )
    ),
    "stream_raw_store_overwrites": f"""
        SELECT identifier, "timestamp", min("valueInW") AS "valueInW" FROM ({LINEITEM}) GROUP BY ALL""",
    "stream_aggregated_store_overwrites": """
        SELECT identifier, "timestamp", min(n) AS "count", CAST(arg_min(l_linenumber, n * 8 + l_linenumber) AS DOUBLE) AS "sumInW",
               CAST(0 AS DOUBLE) AS "averageInW"
        FROM (SELECT l_returnflag AS identifier, epoch_us(l_shipdate) // 1000 AS "timestamp", l_linenumber, count(*) AS n
              FROM lineitem GROUP BY ALL) GROUP BY ALL""",
}
ORACLES |= {
    "windows_merged": HOURLY,
    "windows_merged_daily_lineitem": _windows(LINEITEM, DAY_MS),
    "late_by_record_clock": _JUDGED,
    "windowed_by_record_clock": _windows(f"SELECT * FROM ({_JUDGED_VALUES}) WHERE NOT late", HOUR_MS),
    "total_count_from_summaries": _total(RAW),
    "value_range_from_summaries": f"""
        SELECT identifier, min(v) AS "min", max(v) AS "max"
        FROM (SELECT identifier, CASE WHEN batch = 0 THEN -"valueInW" ELSE "valueInW" END AS v FROM ({_BATCHED}))
        GROUP BY identifier""",
    "count_in_range_from_summaries": _count(_where(RAW, f'"timestamp" >= {FIRST_HOUR + 1} AND "timestamp" <= {LAST}')),
    "stream_all_resolutions": f"""
        SELECT *, 'minutely' AS resolution FROM ({_windows(COMBINED, MINUTE_MS)}) UNION ALL
        SELECT *, 'hourly' AS resolution FROM ({_windows(COMBINED, HOUR_MS)})""",
    "open_windows": f"""
        SELECT *, "startTimestamp" + {DAY_MS} AS "closesAt" FROM ({HOURLY})
        WHERE "startTimestamp" + {DAY_MS} > (SELECT max("timestamp") FROM ({RAW}))""",
    "progress_rows": f"""
        WITH arrived AS (
            SELECT batch, identifier, "timestamp" FROM ({_BATCHED}) UNION ALL
            SELECT {BATCHES} AS batch, identifier, "timestamp" FROM ({_BATCHED}) WHERE batch = 2),
        received AS (SELECT batch, count(*) AS received FROM arrived GROUP BY batch),
        new AS (
            SELECT batch, count(*) AS new
            FROM (SELECT min(batch) AS batch FROM arrived GROUP BY identifier, "timestamp") GROUP BY batch),
        totals AS (
            SELECT batch, received, CAST(sum(received) OVER (ORDER BY batch) AS BIGINT) AS "totalReceived",
                   CAST(sum(coalesce(new, 0)) OVER (ORDER BY batch) AS BIGINT) AS "totalStored"
            FROM received LEFT JOIN new USING (batch))
        SELECT *, "totalReceived" - "totalStored" AS difference FROM totals""",
    "range_of_identifier_stored": _where(RAW, f"{_IN_RANGE} AND identifier IN {LOOKED_UP}"),
    "distribution_refined": _distribution(RAW, "valueInW", 4),
    "distribution_refined_dense": _distribution(DENSE, "valueInW", 50),
    "distribution_refined_in_range": _distribution(_where(RAW, _IN_RANGE), "valueInW", 7),
    "feed_latest": HOURLY,
    "quarantine_replayed": RAW,
    "latest_by_text_parameters": _ends(_where(RAW, _IN_RANGE), "timestamp", 2, "DESC"),
    "trend_of_expression": _trend(
        """
        SELECT identifier, "timestamp", price * (l_linenumber + 1) AS v FROM (
            SELECT CAST(l_suppkey AS VARCHAR) AS identifier, epoch_us(l_shipdate) // 1000 AS "timestamp", l_linenumber,
                   l_extendedprice AS price,
                   row_number() OVER (PARTITION BY l_suppkey, l_shipdate
                                      ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS recency
            FROM lineitem) WHERE recency = 1""",
        "timestamp", "v", 1,
    ),
    "stream_by_message_time": _windows(
        f'SELECT identifier, "timestamp" + {MESSAGE_DELAY_MS} AS "timestamp", "valueInW" FROM ({DENSE})', HOUR_MS
    ),
}

assert ORACLES.keys() == catalog.QUERIES.keys()
