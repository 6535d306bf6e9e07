"""The registered queries as SQL for another engine, to check results against.

Written from the definitions, not from the DataFrame code: duplicates are a UNION ALL, dates are
parsed from text, survivors are picked by row_number, running counts are plain windows.
"""

_SOURCE = """
src AS (
  SELECT *, CAST(o_orderdate AS DATE) AS booked_on, CAST(l_shipdate AS DATE) AS arrives_on
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
doubled AS (SELECT * FROM src UNION ALL SELECT * FROM src WHERE month(booked_on) = 2),
bronze AS (
  SELECT
    CASE WHEN l_linestatus = 'O' THEN 'City Hotel' ELSE 'Resort Hotel' END AS hotel,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_canceled,
    CAST(abs(datediff('day', booked_on, arrives_on)) % 400 AS INT) AS lead_time,
    CAST(year(arrives_on) AS INT) AS arrival_date_year,
    monthname(arrives_on) AS arrival_date_month,
    CAST(week(arrives_on) AS INT) AS arrival_date_week_number,
    CAST(day(arrives_on) AS INT) AS arrival_date_day_of_month,
    CAST(l_linenumber % 3 AS INT) AS stays_in_weekend_nights,
    CAST(CAST(l_quantity AS INT) % 8 AS INT) AS stays_in_week_nights,
    CASE WHEN l_linenumber % 4 = 3 THEN 'NA' ELSE CAST(l_linenumber % 4 AS VARCHAR) END AS adults,
    CASE WHEN l_partkey % 3 = 2 THEN 'NA' ELSE CAST(l_partkey % 3 AS VARCHAR) END AS children,
    CAST(l_partkey % 2 AS VARCHAR) AS babies,
    CASE l_partkey % 4 WHEN 0 THEN 'BB' WHEN 1 THEN 'HB' WHEN 2 THEN 'FB' ELSE 'SC' END AS meal,
    n_name AS country,
    c_mktsegment AS market_segment,
    o_orderpriority AS distribution_channel,
    CASE WHEN l_suppkey % 20 = 0 THEN 1 ELSE 0 END AS is_repeated_guest,
    CAST(l_suppkey % 3 AS INT) AS previous_cancellations,
    CAST(l_partkey % 4 AS INT) AS previous_bookings_not_canceled,
    chr(CAST(65 + l_partkey % 8 AS INT)) AS reserved_room_type,
    chr(CAST(65 + (l_partkey + l_linenumber) % 8 AS INT)) AS assigned_room_type,
    CAST(l_linenumber % 5 AS INT) AS booking_changes,
    CASE WHEN l_tax < 0.03 THEN 'No Deposit' WHEN l_tax < 0.06 THEN 'Refundable'
         ELSE 'Non Refund' END AS deposit_type,
    CAST(l_suppkey AS VARCHAR) AS agent,
    CASE WHEN l_tax > 0.05 THEN CAST(l_partkey AS VARCHAR) END AS company,
    CAST(l_suppkey % 7 AS INT) AS days_in_waiting_list,
    o_orderstatus AS customer_type,
    CAST(CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT)
         // CAST(l_quantity AS BIGINT) - 10000 AS DECIMAL(18,0)) / 100 AS DECIMAL(10,2)) AS adr,
    CAST(l_partkey % 2 AS INT) AS required_car_parking_spaces,
    CAST(l_suppkey % 5 AS INT) AS total_of_special_requests,
    CASE WHEN l_returnflag = 'R' THEN 'Canceled' ELSE 'Check-Out' END AS reservation_status,
    CASE WHEN l_returnflag = 'R' THEN booked_on ELSE arrives_on END AS reservation_status_date,
    CASE WHEN l_discount > 0.095 THEN CAST(l_discount AS VARCHAR) END AS rescued_data,
    o_custkey AS customer_number
  FROM doubled
)"""

_KEY_COLUMNS = """hotel, CAST(is_canceled AS VARCHAR), CAST(lead_time AS VARCHAR),
    CAST(arrival_date_year AS VARCHAR), arrival_date_month,
    CAST(arrival_date_week_number AS VARCHAR), CAST(arrival_date_day_of_month AS VARCHAR),
    CAST(stays_in_weekend_nights AS VARCHAR), CAST(stays_in_week_nights AS VARCHAR),
    adults, children, babies, meal, country, market_segment, distribution_channel,
    CAST(is_repeated_guest AS VARCHAR), CAST(previous_cancellations AS VARCHAR),
    CAST(previous_bookings_not_canceled AS VARCHAR), reserved_room_type, assigned_room_type,
    CAST(booking_changes AS VARCHAR), deposit_type, agent, {company},
    CAST(days_in_waiting_list AS VARCHAR), customer_type, CAST(adr AS VARCHAR),
    CAST(required_car_parking_spaces AS VARCHAR), CAST(total_of_special_requests AS VARCHAR),
    reservation_status, CAST(reservation_status_date AS VARCHAR)"""

_KEY = f"sha256(concat_ws('||', {_KEY_COLUMNS.format(company='company')}))"
_KEY_WITH_TOKEN = "sha256(concat_ws('||', {}))".format(
    _KEY_COLUMNS.format(company="coalesce(company, '<null>')")
)

_TYPED = f""",
typed AS (
  SELECT * REPLACE (
      CAST(is_canceled AS BOOLEAN) AS is_canceled,
      coalesce(TRY_CAST(adults AS INT), 0) AS adults,
      coalesce(TRY_CAST(children AS INT), 0) AS children,
      coalesce(TRY_CAST(babies AS INT), 0) AS babies),
    {_KEY} AS reservation_id,
    arrival_date_year AS arrival_year,
    arrival_date_day_of_month AS arrival_day,
    CAST(try_strptime(concat(arrival_date_year, ' ', arrival_date_month, ' ',
         arrival_date_day_of_month), '%Y %B %d') AS DATE) AS arrival_date,
    stays_in_weekend_nights + stays_in_week_nights AS stay_nights,
    CAST(CASE WHEN is_canceled = 1
         THEN adr * (stays_in_weekend_nights + stays_in_week_nights) ELSE 0 END
         AS DECIMAL(12,2)) AS est_lost_revenue
  FROM bronze
)"""

_SILVER = """,
silver AS (SELECT * FROM typed WHERE hotel IS NOT NULL AND adr >= 0)"""

_GOLD = """,
gold AS (
  SELECT hotel, arrival_year, CAST(month(arrival_date) AS INT) AS arrival_month,
    CAST(date_trunc('month', arrival_date) AS DATE) AS arrival_month_start,
    count(*) AS bookings,
    CAST(sum(CAST(is_canceled AS INT)) AS BIGINT) AS cancellations,
    round(avg(CAST(is_canceled AS INT)), 4) AS cancel_rate,
    CAST(round(CAST(avg(adr) AS DECIMAL(14,6)), 2) AS DECIMAL(11,2)) AS avg_adr,
    CAST(sum(stay_nights) AS BIGINT) AS room_nights,
    CAST(sum(CASE WHEN is_canceled THEN stay_nights ELSE 0 END) AS BIGINT) AS canceled_room_nights,
    CAST(sum(est_lost_revenue) AS DECIMAL(22,2)) AS est_lost_revenue
  FROM silver GROUP BY ALL
)"""

_RISK = """,
scored AS (
  SELECT *, round(CAST(stay_nights * 7 + month(arrival_date) * 3 + CAST(floor(adr) AS INT) % 50
                       AS DOUBLE) / 150.0, 4) AS cancel_probability
  FROM silver
),
risk AS (
  SELECT reservation_id, hotel, cancel_probability,
    CASE WHEN cancel_probability >= 0.7 THEN 'high' WHEN cancel_probability >= 0.4 THEN 'medium'
         ELSE 'low' END AS risk_band,
    CAST(1 + lead_time % 3 AS INT) AS model_version,
    CAST('2026-01-01 00:00:00' AS TIMESTAMP) AS scored_at
  FROM scored
)"""

_SERVING = """,
one_score AS (
  SELECT * FROM risk QUALIFY row_number() OVER (PARTITION BY reservation_id
    ORDER BY scored_at DESC, model_version DESC, cancel_probability DESC, hotel DESC, risk_band DESC) = 1
),
one_detail AS (
  SELECT reservation_id, arrival_date, lead_time, adr, market_segment, adults, children, babies,
    deposit_type, customer_type
  FROM silver QUALIFY row_number() OVER (PARTITION BY reservation_id
    ORDER BY arrival_date DESC NULLS LAST, lead_time DESC NULLS LAST, adr DESC NULLS LAST,
      market_segment DESC NULLS LAST, adults DESC, children DESC, babies DESC,
      deposit_type DESC NULLS LAST, customer_type DESC NULLS LAST) = 1
),
serving AS (
  SELECT reservation_id, hotel, arrival_date, lead_time, adr, market_segment, adults, children,
    babies, deposit_type, customer_type, cancel_probability, risk_band, model_version, scored_at
  FROM one_score LEFT JOIN one_detail USING (reservation_id)
)"""

_HOLDOUT = """,
cut AS (SELECT quantile_cont(arrival_date - DATE '1970-01-01', 0.8) AS cutoff FROM silver),
marked AS (
  SELECT scored.*, CASE WHEN arrival_date - DATE '1970-01-01' < cutoff THEN 'train' ELSE 'test' END
    AS split
  FROM scored, cut
),
holdout AS (
  SELECT CAST(is_canceled AS INT) AS y, cancel_probability AS p FROM marked WHERE split = 'test'
),
steps AS (
  SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM holdout GROUP BY p
),
running AS (
  SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
  FROM steps WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)
),
cells AS (
  SELECT count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
    count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp
  FROM holdout
)"""

_ACTIONS = """
mapped AS (
  SELECT event_id AS id, user_id,
    CASE WHEN event_type = 'click' THEN 'reconfirmed' WHEN event_type = 'purchase' THEN 'deposit_requested'
         WHEN event_type = 'signup' THEN 'overbooked_backup' WHEN event_type = 'error' THEN 'released'
         WHEN event_type = 'view' AND value < 50 THEN 'note' ELSE event_type END AS action_type,
    props AS note, concat('user_', user_id) AS acted_by, CAST(ts AS TIMESTAMP) AS acted_at
  FROM events
),
valid AS (
  SELECT id, CAST(user_id AS VARCHAR) AS reservation_id, action_type, note, acted_by, acted_at
  FROM mapped WHERE user_id IS NOT NULL AND action_type IN
    ('reconfirmed', 'deposit_requested', 'overbooked_backup', 'released', 'note')
)"""

_BOOKING_ACTIONS = """,
first_keys AS (
  SELECT customer_number, min(reservation_id) AS reservation_id FROM silver GROUP BY customer_number
),
booking_actions AS (
  SELECT id, reservation_id, action_type, note, acted_by, acted_at
  FROM mapped LEFT JOIN first_keys ON user_id = customer_number
)"""

_TO_SILVER = f"WITH {_SOURCE.strip()}{_TYPED}{_SILVER}"
_TO_GOLD = _TO_SILVER + _GOLD
_TO_RISK = _TO_SILVER + _RISK
_TO_SERVING = _TO_RISK + _SERVING
_TO_HOLDOUT = _TO_RISK + _HOLDOUT
_TO_ACTIONS = f"WITH {_ACTIONS.strip()}"
_TO_DETAIL = f"{_TO_SERVING}, {_ACTIONS.strip()}{_BOOKING_ACTIONS}"

_SOURCE_NAMES = """hotel, is_canceled, lead_time, arrival_date_year, arrival_date_month,
  arrival_date_week_number, arrival_date_day_of_month, stays_in_weekend_nights,
  stays_in_week_nights, adults, children, babies, meal, country, market_segment,
  distribution_channel, is_repeated_guest, previous_cancellations, previous_bookings_not_canceled,
  reserved_room_type, assigned_room_type, booking_changes, deposit_type, agent, company,
  days_in_waiting_list, customer_type, adr, required_car_parking_spaces,
  total_of_special_requests, reservation_status, reservation_status_date"""

_SILVER_NAMES = f"""{_SOURCE_NAMES}, reservation_id, arrival_year, arrival_day, arrival_date,
  stay_nights, est_lost_revenue"""

_WEIGHTED = "round(sum(cancellations) / sum(bookings), 4)"


def _class_line(name: str, hit: str, false_alarm: str, miss: str) -> str:
    return f"""SELECT '{name}' AS class,
  round(coalesce({hit} / nullif({hit} + {false_alarm}, 0), 0), 6) AS precision,
  round(coalesce({hit} / nullif({hit} + {miss}, 0), 0), 6) AS recall,
  round(coalesce(2 * {hit} / nullif(2 * {hit} + {false_alarm} + {miss}, 0), 0), 6) AS f1,
  {hit} + {miss} AS support FROM cells"""


def _persona(sees: str, value: str) -> str:
    columns = ", ".join(f"{value.format(c)} AS {c}" for c in ("country", "agent", "company"))
    return f"{_TO_SILVER} SELECT reservation_id, hotel, arrival_date, adr, {columns} FROM silver WHERE {sees}"


_PERSONAS = [
    ("nobody", "false", "'***'"),
    ("engineer", "true", "country"),
    ("analyst", "true", "'***'"),
    ("city_manager", "hotel = 'City Hotel'", "'***'"),
    ("resort_manager", "hotel = 'Resort Hotel'", "'***'"),
    ("both_managers", "hotel IN ('City Hotel', 'Resort Hotel')", "'***'"),
]

ORACLES: dict[str, str] = {
    # landing and cleaning
    "bronze_landing": f"WITH {_SOURCE.strip()} SELECT {_SOURCE_NAMES} FROM bronze",
    "bronze_folder_stream": f"WITH {_SOURCE.strip()} SELECT {_SOURCE_NAMES} FROM bronze",
    "streamed_gold": f"{_TO_GOLD} SELECT * FROM gold",
    "kept_gold": f"{_TO_GOLD} SELECT * FROM gold",
    "kept_details": f"""{_TO_SILVER}
SELECT reservation_id, arrival_date, lead_time, adr FROM silver
QUALIFY row_number() OVER (PARTITION BY reservation_id
  ORDER BY arrival_date DESC NULLS LAST, lead_time DESC NULLS LAST, adr DESC NULLS LAST) = 1""",
    "csv_rescue": f"""WITH {_SOURCE.strip()}
SELECT hotel, CASE WHEN adults = 'NA' THEN 'NA' END AS rescued_adults,
  CASE WHEN children = 'NA' THEN 'NA' END AS rescued_children,
  CASE WHEN babies = 'NA' THEN 'NA' END AS rescued_babies,
  adults = 'NA' OR children = 'NA' OR babies = 'NA' AS is_rescued, count(*) AS row_count
FROM bronze GROUP BY ALL""",
    "silver_table": f"{_TO_SILVER} SELECT {_SILVER_NAMES} FROM silver",
    "clustered_silver": f"{_TO_SILVER} SELECT {_SILVER_NAMES} FROM silver",
    "skipped_bookings": f"""{_TO_SILVER} SELECT {_SILVER_NAMES} FROM silver
WHERE hotel = 'City Hotel' AND arrival_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'""",
    "repeated_bookings_found": f"""{_TO_SILVER} SELECT {_SILVER_NAMES} FROM silver WHERE reservation_id = (
  SELECT reservation_id FROM silver GROUP BY reservation_id ORDER BY count(*) DESC, reservation_id LIMIT 1)""",
    "keys_with_null_token": f"""WITH {_SOURCE.strip()},
keyed AS (SELECT hotel, {_KEY_WITH_TOKEN} AS k FROM bronze)
SELECT hotel, count(*) AS row_count, count(DISTINCT k) AS distinct_keys, min(k) AS lowest_key
FROM keyed GROUP BY hotel""",
    "dq_metrics": f"""WITH {_SOURCE.strip()}{_TYPED},
n AS (SELECT count(*) AS n, count(*) FILTER (hotel IS NOT NULL) AS a, count(*) FILTER (adr >= 0) AS b,
  count(*) FILTER (adults + children + babies > 0) AS c, count(*) FILTER (rescued_data IS NULL) AS d
  FROM typed)
SELECT 'valid_hotel' AS rule, 'drop' AS action, a AS passed, n - a AS failed FROM n
UNION ALL SELECT 'non_negative_adr', 'drop', b, n - b FROM n
UNION ALL SELECT 'has_guests', 'warn', c, n - c FROM n
UNION ALL SELECT 'clean_parse', 'warn', d, n - d FROM n""",
    "rescued_rows": f"""WITH {_SOURCE.strip()}
SELECT count(*) AS rescued_rows FROM bronze WHERE rescued_data IS NOT NULL""",
    # gold
    "gold_hotel_month": f"{_TO_GOLD} SELECT * FROM gold",
    "hotel_headline": f"""{_TO_GOLD}
SELECT hotel, CAST(sum(bookings) AS BIGINT) AS bookings, {_WEIGHTED} AS cancel_rate,
  CAST(sum(est_lost_revenue) AS DECIMAL(32,2)) AS total_est_lost_revenue FROM gold GROUP BY hotel""",
    "hotel_compare": f"""{_TO_GOLD}
SELECT hotel, CAST(sum(bookings) AS BIGINT) AS total_bookings,
  CAST(sum(cancellations) AS BIGINT) AS total_cancellations,
  100 * (CAST(sum(cancellations) AS DOUBLE) / CAST(sum(bookings) AS DOUBLE)) AS cancellation_rate_pct
FROM gold WHERE hotel IN ('City Hotel', 'Resort Hotel') GROUP BY hotel""",
    "portfolio_rollup": f"""{_TO_GOLD}
SELECT hotel, CAST(grouping(hotel) AS INT) AS is_total, CAST(sum(bookings) AS BIGINT) AS bookings,
  CAST(sum(cancellations) AS BIGINT) AS cancellations, {_WEIGHTED} AS cancel_rate,
  CAST(sum(est_lost_revenue) AS DECIMAL(38,2)) AS est_lost_revenue,
  round(CAST(sum(est_lost_revenue) AS DOUBLE)
        / (SELECT CAST(sum(est_lost_revenue) AS DOUBLE) FROM gold), 4) AS loss_share
FROM gold GROUP BY ROLLUP (hotel)""",
    "monthly_trend": f"""{_TO_GOLD}
SELECT arrival_month, cancel_rate, round(avg(cancel_rate) OVER (), 4) AS plain_mean_rate,
  round(sum(cancellations) OVER () / sum(bookings) OVER (), 4) AS weighted_rate
FROM gold WHERE hotel = 'City Hotel' AND arrival_year = 1996""",
    "monthly_cancel_rates": f"""{_TO_GOLD}
SELECT arrival_year, arrival_month, cancel_rate, est_lost_revenue FROM gold WHERE hotel = 'City Hotel'""",
    "recovery_sensitivity": f"""{_TO_GOLD},
total AS (SELECT CAST(sum(est_lost_revenue) AS DECIMAL(32,2)) AS total_loss FROM gold)
SELECT CAST(rate AS DECIMAL(4,2)) AS rate, total_loss,
  CAST(round(CAST(total_loss AS DECIMAL(24,2)) * CAST(rate AS DECIMAL(4,2)), 2) AS DECIMAL(26,2)) AS recovered
FROM total, (VALUES (0.01), (0.05), (0.10)) AS rates(rate)""",
    "peak_month": f"""{_TO_GOLD}
SELECT hotel, arrival_year, arrival_month, arrival_month_start, est_lost_revenue FROM gold
WHERE arrival_month_start IS NOT NULL AND est_lost_revenue = (SELECT max(est_lost_revenue) FROM gold)""",
    "top_loss_months": f"""{_TO_GOLD}
SELECT hotel, arrival_year, arrival_month, est_lost_revenue FROM gold
ORDER BY est_lost_revenue DESC, hotel, arrival_year, arrival_month LIMIT 10""",
    "gold_preview": f"""{_TO_GOLD}
SELECT hotel, arrival_month_start, bookings, cancellations, cancel_rate, avg_adr, room_nights,
  canceled_room_nights, est_lost_revenue FROM gold ORDER BY hotel, arrival_month_start LIMIT 24""",
    "silver_preview": f"""{_TO_SILVER}
SELECT reservation_id, hotel, is_canceled, arrival_date, lead_time, adr, stay_nights, est_lost_revenue
FROM silver ORDER BY arrival_date, reservation_id LIMIT 20""",
    # counts, keys, duplicates
    "layer_counts": f"""{_TO_SERVING}{_GOLD}
SELECT 'bronze' AS layer, count(*) AS row_count FROM bronze
UNION ALL SELECT 'silver', count(*) FROM silver UNION ALL SELECT 'gold', count(*) FROM gold
UNION ALL SELECT 'risk', count(*) FROM risk UNION ALL SELECT 'serving', count(*) FROM serving""",
    "bronze_vs_silver": f"""{_TO_SILVER}
SELECT (SELECT count(*) FROM bronze) AS bronze_rows, count(*) AS silver_rows,
  (SELECT count(*) FROM bronze) - count(*) AS dropped_rows FROM silver""",
    "sketched_keys": f"""{_TO_SERVING}
SELECT 'silver' AS layer, count(*) AS row_count, 0::BIGINT AS null_count, count(DISTINCT reservation_id) AS distinct_keys, true AS is_close FROM silver
UNION ALL SELECT 'serving', count(*), 0, count(DISTINCT reservation_id), true FROM serving""",
    "sketched_overlap": f"""{_TO_SERVING},
a AS (SELECT DISTINCT reservation_id FROM silver), b AS (SELECT DISTINCT reservation_id FROM serving)
SELECT (SELECT count(*) FROM a SEMI JOIN b USING (reservation_id)) AS both_keys,
  (SELECT count(*) FROM a ANTI JOIN b USING (reservation_id)) AS silver_only,
  (SELECT count(*) FROM b ANTI JOIN a USING (reservation_id)) AS serving_only,
  true AS both_keys_close, true AS silver_only_close, true AS serving_only_close""",
    "sketched_quantiles": f"""{_TO_SILVER}
SELECT measure, share, CASE measure WHEN 'adr' THEN prices ELSE arrivals END AS row_count, true AS is_close
FROM (SELECT count(adr) AS prices, count(arrival_date) AS arrivals FROM silver),
  (SELECT unnest(['adr', 'arrival_date']) AS measure), (SELECT unnest([0.1, 0.5, 0.8, 0.99])::DOUBLE AS share)""",
    "key_uniqueness": f"""{_TO_SILVER}
SELECT count(*) AS row_count, count(DISTINCT reservation_id) AS distinct_keys,
  count(*) = count(DISTINCT reservation_id) AS is_unique FROM silver""",
    "serving_key_uniqueness": f"""{_TO_SERVING}
SELECT count(*) AS row_count, count(DISTINCT reservation_id) AS distinct_keys,
  count(*) = count(DISTINCT reservation_id) AS is_unique FROM serving""",
    "duplicate_profile": f"""{_TO_SILVER},
k AS (SELECT reservation_id, count(*) AS copies FROM silver GROUP BY reservation_id HAVING count(*) > 1)
SELECT copies, count(*) AS key_count, (copies - 1) * count(*) AS surplus_rows FROM k GROUP BY copies""",
    "duplicate_keys": f"""{_TO_SILVER}
SELECT reservation_id, count(*) AS copies FROM silver GROUP BY reservation_id HAVING count(*) > 1""",
    # risk
    "reservation_risk": f"{_TO_RISK} SELECT * FROM risk",
    "score_check": f"""{_TO_RISK}
SELECT count(*) AS row_count, count(*) FILTER (cancel_probability IS NULL) AS unscored,
  count(*) FILTER (cancel_probability < 0 OR cancel_probability > 1) AS out_of_range FROM risk""",
    "risk_band_summary": f"""{_TO_RISK}
SELECT DISTINCT risk_band, count(*) OVER band AS reservations,
  round(sum(cancel_probability) OVER band / count(cancel_probability) OVER band, 4) AS avg_prob,
  round(min(cancel_probability) OVER band, 4) AS min_prob, round(max(cancel_probability) OVER band, 4) AS max_prob
FROM risk WINDOW band AS (PARTITION BY risk_band)""",
    "risk_band_distribution": f"""{_TO_RISK}
SELECT risk_band, count(*) AS reservations, round(avg(cancel_probability), 4) AS avg_cancel_probability
FROM risk GROUP BY risk_band""",
    "high_risk_by_hotel": f"""{_TO_RISK}
SELECT hotel, sum(CAST(cancel_probability >= 0.7 AS BIGINT))::BIGINT AS high_risk_reservations FROM risk
GROUP BY hotel HAVING hotel IS NOT NULL AND max(cancel_probability) >= 0.7""",
    "score_model_version": f"""{_TO_RISK}, versions AS (SELECT model_version, count(*) AS reservations FROM risk GROUP BY ALL HAVING model_version IS NOT NULL)
SELECT unnest(max_by(versions, {{'n': reservations, 'v': model_version}})) FROM versions""",
    "risk_triage_share": f"""{_TO_RISK}
SELECT risk_band, count(*) AS reservations, round(avg(cancel_probability), 4) AS avg_cancel_probability,
  round(count(*) / (SELECT count(*) FROM risk), 4) AS share FROM risk GROUP BY risk_band""",
    "hotel_scorecard": f"""{_TO_RISK}{_GOLD},
g AS (SELECT hotel, CAST(sum(bookings) AS BIGINT) AS bookings, {_WEIGHTED} AS cancel_rate,
  CAST(sum(est_lost_revenue) AS DECIMAL(32,2)) AS est_lost_revenue FROM gold GROUP BY hotel),
r AS (SELECT hotel, count(*) FILTER (risk_band = 'high') AS high_risk,
  round(avg(cancel_probability), 4) AS avg_cancel_probability FROM risk GROUP BY hotel)
SELECT * FROM g JOIN r USING (hotel)""",
    "newest_version_by_hotel": f"""{_TO_RISK},
v AS (SELECT hotel AS model, model_version AS version, count(*) AS scored FROM risk GROUP BY ALL)
SELECT * FROM v WHERE version = (SELECT max(version) FROM v AS o WHERE o.model = v.model)""",
    # serving
    "reservation_serving": f"{_TO_SERVING} SELECT * FROM serving",
    "published_snapshot": f"{_TO_SERVING} SELECT * FROM serving",
    "kpi_row": f"""{_TO_SERVING}
SELECT count(*) AS total, count(*) FILTER (risk_band = 'high') AS high_risk,
  count(*) FILTER (risk_band = 'medium') AS medium_risk, count(*) FILTER (risk_band = 'low') AS low_risk,
  round(avg(cancel_probability), 4) AS avg_cancel_probability FROM serving""",
    "risk_band_mix": f"""{_TO_SERVING}
SELECT risk_band, count(*) AS count FROM serving GROUP BY risk_band""",
    "at_risk_page": f"""{_TO_SERVING}
SELECT * FROM serving ORDER BY cancel_probability DESC, reservation_id LIMIT 50 OFFSET 40""",
    "at_risk_next_page": f"""{_TO_SERVING}
SELECT * FROM serving WHERE cancel_probability < 0.8 OR (cancel_probability = 0.8 AND reservation_id > '')
ORDER BY cancel_probability DESC, reservation_id LIMIT 200""",
    "filtered_page": f"""{_TO_SERVING}
SELECT * FROM serving WHERE hotel = 'City Hotel' AND risk_band = 'high' AND market_segment = 'MACHINERY'
  AND lead_time >= 30 ORDER BY cancel_probability DESC, reservation_id LIMIT 20""",
    "filtered_count": f"""{_TO_SERVING}
SELECT count(*) AS total FROM serving
WHERE hotel = 'City Hotel' AND risk_band = 'high' AND lead_time >= 0""",
    "reservation_lookup": f"""{_TO_SERVING}
SELECT * FROM serving WHERE reservation_id = (SELECT max(reservation_id) FROM silver)""",
    "serving_json": f"""{_TO_SERVING}
SELECT CAST(json_object('reservation_id', reservation_id, 'hotel', hotel,
  'arrival_date', strftime(arrival_date, '%Y-%m-%d'), 'lead_time', lead_time,
  'adr', CAST(adr AS DOUBLE), 'market_segment', market_segment, 'adults', adults,
  'children', children, 'babies', babies, 'deposit_type', deposit_type,
  'customer_type', customer_type, 'cancel_probability', cancel_probability,
  'risk_band', risk_band, 'model_version', model_version,
  'scored_at', concat(strftime(scored_at, '%Y-%m-%dT%H:%M:%S'), '+00:00')) AS VARCHAR) AS json FROM serving""",
    "serving_display": f"""{_TO_SERVING}
SELECT left(reservation_id, 12) AS reservation, hotel, strftime(arrival_date, '%Y-%m-%d') AS arrival,
  concat(CAST(CAST(round(CAST(cancel_probability AS DECIMAL(18,8)) * 100, 1) AS DECIMAL(18,1)) AS VARCHAR), '%')
    AS cancel_probability,
  risk_band, lead_time, concat('$', format('{{:,}}', CAST(round(adr, 0) AS BIGINT))) AS adr,
  market_segment, concat(adults, '/', children, '/', babies) AS party FROM serving""",
    # actions
    "action_stream": f"{_TO_ACTIONS} SELECT * FROM valid",
    "action_rejects": f"""{_TO_SILVER}, {_ACTIONS.strip()}{_BOOKING_ACTIONS},
judged AS (SELECT action_type, CASE WHEN reservation_id IS NULL THEN 'reservation_id is null'
  WHEN action_type IS NULL THEN 'action_type is null'
  WHEN action_type NOT IN ('reconfirmed', 'deposit_requested', 'overbooked_backup', 'released', 'note')
  THEN 'unknown action_type' END AS reason FROM booking_actions)
SELECT reason, action_type, count(*) AS rejected FROM judged WHERE reason IS NOT NULL GROUP BY ALL""",
    "latest_action": f"""{_TO_ACTIONS}
SELECT * FROM valid
QUALIFY row_number() OVER (PARTITION BY reservation_id ORDER BY acted_at DESC, id DESC) = 1""",
    "kept_latest_action": f"""{_TO_ACTIONS}
SELECT * FROM valid
QUALIFY row_number() OVER (PARTITION BY reservation_id ORDER BY acted_at DESC, id DESC) = 1""",
    "prior_actions": f"{_TO_ACTIONS} SELECT * FROM valid WHERE reservation_id = '8'",
    "actions_display": f"""{_TO_ACTIONS}
SELECT left(reservation_id, 12) AS reservation, replace(action_type, '_', ' ') AS action, note, acted_by,
  concat(strftime(acted_at, '%Y-%m-%dT%H:%M:%S'),
    CASE WHEN microsecond(acted_at) % 1000000 = 0 THEN '' ELSE strftime(acted_at, '.%f') END) AS acted_at
FROM valid""",
    "reservation_detail": f"""{_TO_DETAIL},
ok AS (SELECT id AS action_id, reservation_id, action_type, note, acted_by, acted_at FROM booking_actions
  WHERE reservation_id IS NOT NULL AND action_type IN
    ('reconfirmed', 'deposit_requested', 'overbooked_backup', 'released', 'note'))
SELECT * FROM serving LEFT JOIN ok USING (reservation_id)""",
    "actions_from_page": f"""{_TO_SERVING}
SELECT reservation_id, 'reconfirmed' AS action_type, 'called the guest' AS note, 'desk' AS acted_by,
  CAST('2026-01-01 00:00:00' AS TIMESTAMP) AS acted_at
FROM serving WHERE risk_band = 'high' ORDER BY cancel_probability DESC, reservation_id LIMIT 25""",
    # features, split, metrics
    "model_features": f"""{_TO_SILVER}
SELECT reservation_id, coalesce(hotel, 'missing') AS hotel, coalesce(meal, 'missing') AS meal,
  coalesce(market_segment, 'missing') AS market_segment,
  coalesce(distribution_channel, 'missing') AS distribution_channel,
  coalesce(reserved_room_type, 'missing') AS reserved_room_type,
  coalesce(deposit_type, 'missing') AS deposit_type, coalesce(customer_type, 'missing') AS customer_type,
  {", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in (
      "lead_time", "arrival_year", "arrival_date_week_number", "stays_in_weekend_nights",
      "stays_in_week_nights", "adults", "children", "babies", "is_repeated_guest",
      "previous_cancellations", "previous_bookings_not_canceled", "booking_changes",
      "days_in_waiting_list", "adr", "required_car_parking_spaces", "total_of_special_requests",
      "stay_nights"))} FROM silver""",
    "split_cutoff": f"""{_TO_SILVER}
SELECT quantile_cont(arrival_date - DATE '1970-01-01', 0.8) AS cutoff FROM silver""",
    "split_balance": f"""{_TO_HOLDOUT}
SELECT split, count(*) AS row_count, round(avg(CAST(is_canceled AS INT)), 4) AS cancel_rate
FROM marked GROUP BY split""",
    "ranking_metrics": f"""{_TO_HOLDOUT}
SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
  round(sum(CAST(pos AS DOUBLE) * (all_neg - fp + neg / 2)) / (any_value(all_pos) * any_value(all_neg)), 6)
    AS roc_auc,
  round(sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / any_value(all_pos), 6) AS average_precision
FROM running""",
    "roc_pr_points": f"""{_TO_HOLDOUT}
SELECT p AS threshold, round(fp / all_neg, 6) AS fpr, round(tp / all_pos, 6) AS tpr,
  round(tp / (tp + fp), 6) AS precision, round(tp / all_pos, 6) AS recall FROM running
UNION ALL SELECT NULL, 0.0, 0.0, 1.0, 0.0""",
    "threshold_metrics": f"""{_TO_HOLDOUT}
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cells""",
    "confusion_matrix": f"""{_TO_HOLDOUT}
SELECT 'kept' AS actual, 'kept' AS predicted, tn AS count FROM cells
UNION ALL SELECT 'kept', 'canceled', fp FROM cells UNION ALL SELECT 'canceled', 'kept', fn FROM cells
UNION ALL SELECT 'canceled', 'canceled', tp FROM cells""",
    "class_report": f"""{_TO_HOLDOUT}
{_class_line('kept', 'tn', 'fn', 'fp')} UNION ALL {_class_line('canceled', 'tp', 'fp', 'fn')}""",
    # landing
    "landed_by_name": f"""WITH {_SOURCE.strip()}
SELECT * EXCLUDE (rescued_data, customer_number) REPLACE (CASE WHEN lead_time % 3 = 1 THEN NULL ELSE meal END AS meal),
  CASE WHEN lead_time % 3 = 2 THEN concat('tier ', lead_time % 4) END AS loyalty FROM bronze""",
    "landed_lineage": f"""WITH {_SOURCE.strip()}
SELECT hotel, CASE WHEN is_canceled = 0 THEN 'first' ELSE 'second' END AS folder, count(*) AS row_count,
  count(*) AS with_file, count(*) AS with_time FROM bronze GROUP BY ALL""",
    "streamed_rule_counts": f"""WITH {_SOURCE.strip()}{_TYPED}
SELECT count(*) FILTER (hotel IS NULL) AS valid_hotel, count(*) FILTER ((adr >= 0) IS NOT TRUE) AS non_negative_adr,
  count(*) FILTER (adults + children + babies <= 0) AS has_guests, CAST(0 AS BIGINT) AS clean_parse, count(*) AS rows FROM typed""",
    "snapshot_refresh": f"{_TO_SERVING} SELECT * FROM serving",
    "streamed_action_ids": f"""{_TO_ACTIONS}, twice AS (SELECT * FROM valid UNION ALL SELECT * FROM valid WHERE action_type = 'note')
SELECT action_type, count(*) AS row_count, count(*) AS with_id, count(*) AS distinct_ids FROM twice GROUP BY ALL""",
    # the model
    "onehot_features": f"""{_TO_HOLDOUT}
SELECT reservation_id, {", ".join(
      f"(SELECT CAST(CASE WHEN bool_or(v = coalesce(s.{c}, 'missing')) THEN count(*) FILTER (v < coalesce(s.{c}, 'missing')) ELSE -1 END AS INT)"
      f" FROM (SELECT DISTINCT coalesce({c}, 'missing') AS v FROM marked WHERE split = 'train' AND is_canceled IS NOT NULL)) AS {c}"
      for c in ("hotel", "meal", "market_segment", "distribution_channel", "reserved_room_type", "deposit_type", "customer_type"))}
FROM silver AS s""",
    "gbt_scores": f"""{_TO_SILVER}
SELECT reservation_id, hotel, CAST(1 AS INT) AS model_version, CAST('2026-01-01 00:00:00' AS TIMESTAMP) AS scored_at,
  true AS in_range, true AS band_agrees FROM silver""",
    "gbt_labels": f"{_TO_SILVER} SELECT reservation_id, true AS agrees FROM silver",
    "gbt_holdout_metrics": f"""{_TO_HOLDOUT}
SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, true AS auc_in_range, true AS learned FROM holdout""",
    "feature_importance": f"""{_TO_HOLDOUT},
base AS (
  SELECT *, row_number() OVER (ORDER BY is_canceled, reservation_id, stay_nights NULLS FIRST, arrival_date NULLS FIRST, adr NULLS FIRST) AS i
  FROM marked WHERE split = 'test' AND is_canceled IS NOT NULL
),
turned AS (
  SELECT r, stay_nights AS o1, arrival_date AS o2, adr AS o3, row_number() OVER (PARTITION BY r
    ORDER BY md5(concat(r, ':', reservation_id)), stay_nights NULLS FIRST, arrival_date NULLS FIRST, adr NULLS FIRST) AS i
  FROM base, (VALUES (1), (2)) AS t(r)
),
copies AS (
  SELECT NULL AS feature, 0 AS r, is_canceled, stay_nights, arrival_date, adr FROM base
  UNION ALL SELECT 'stay_nights', r, is_canceled, o1, arrival_date, adr FROM base JOIN turned USING (i)
  UNION ALL SELECT 'arrival_date', r, is_canceled, stay_nights, o2, adr FROM base JOIN turned USING (i)
  UNION ALL SELECT 'adr', r, is_canceled, stay_nights, arrival_date, o3 FROM base JOIN turned USING (i)
),
points AS (
  SELECT feature, r, CAST(is_canceled AS INT) AS y, round(CAST(stay_nights * 7 + month(arrival_date) * 3
    + CAST(floor(adr) AS INT) % 50 AS DOUBLE) / 150.0, 4) AS p FROM copies
),
counted AS (SELECT feature, r, p, sum(y) AS pos, sum(1 - y) AS neg FROM points WHERE p IS NOT NULL GROUP BY ALL),
ranks AS (
  SELECT feature, r, pos, neg, sum(neg) OVER (PARTITION BY feature, r ORDER BY p ROWS UNBOUNDED PRECEDING) - neg AS below
  FROM counted
),
aucs AS (
  SELECT feature, r, CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / (sum(pos) * sum(neg)) AS auc FROM ranks GROUP BY ALL
)
SELECT feature, round(avg((SELECT auc FROM aucs WHERE feature IS NULL) - auc), 6) AS importance
FROM aucs WHERE feature IS NOT NULL GROUP BY feature""",
    "training_record": f"""{_TO_HOLDOUT}
SELECT 'cancel' AS model, CAST(1 AS INT) AS version, CAST(2 AS INT) AS newest, count(*) FILTER (split = 'train') AS n_train,
  count(*) FILTER (split = 'test') AS n_test, count(*) AS row_count FROM marked""",
    # governance
    "persona_city_view": _persona("hotel = 'City Hotel'", "'***'"),
    "persona_analyst_view": _persona("true", "'***'"),
    "persona_engineer_view": _persona("true", "{}"),
    "sql_persona_rows": _persona("hotel = 'City Hotel'", "'***'"),
    "sql_persona_countries": _TO_SILVER + " " + " UNION ALL ".join(
        f"SELECT '{name}' AS persona, {value} AS country, count(*) AS bookings, count(DISTINCT hotel) AS hotels"
        f" FROM silver WHERE ({sees}) AND {value} IS NOT NULL GROUP BY 1, 2"
        for name, sees, value in _PERSONAS
    ),
    "persona_visibility": _TO_SILVER + " " + " UNION ALL ".join(
        f"SELECT '{name}' AS persona, count(*) FILTER ({sees}) AS visible_rows,"
        f" count(DISTINCT hotel) FILTER ({sees}) AS hotels,"
        f" max({value}) FILTER ({sees}) AS country_sample FROM silver"
        for name, sees, value in _PERSONAS
    ),
}
