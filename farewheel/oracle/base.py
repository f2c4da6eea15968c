"""Canonical tables as common table expressions, and small text helpers."""

AS_OF = "DATE '2023-12-31'"

TABLES = """WITH RECURSIVE base AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
         o_custkey AS user_id, l_quantity AS duration_min, l_returnflag AS rf,
         (o_custkey * 37) % 640 AS start_offset,
         CASE WHEN l_partkey % 5 = 0 OR o_custkey % 11 = 0 THEN 'EFIT' ELSE 'ICONIC' END AS bike_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
rides AS MATERIALIZED (
  SELECT concat(ok, '-', ln, '-', pk, '-', sk) AS ride_id, user_id,
         CAST(DATE '2022-01-01' AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(
             (start_offset + (ok * 31 + ln * 17 + pk * 7) % (730 - start_offset)) * 1440
             + ((ok * 7 + ln * 5) % 18 + 5) * 60 + pk % 60 AS INT) AS started_at,
         duration_min,
         CASE WHEN rf = 'A' THEN 'Annual Member' ELSE 'Casual Member' END AS user_type,
         bike_type, sk AS station_id,
         CAST(CASE WHEN rf = 'A' AND bike_type = 'EFIT' THEN 0.10 * CAST(duration_min AS DECIMAL(10,1))
                   WHEN rf = 'A' THEN 0
                   WHEN bike_type = 'EFIT' THEN 1.00 + 0.20 * CAST(duration_min AS DECIMAL(10,1))
                   ELSE 1.00 + 0.12 * CAST(duration_min AS DECIMAL(10,1)) END AS DECIMAL(10,2)) AS ride_cost_cad,
         ok, ln, pk, sk, (ok * 3 + ln * 7 + pk) % 60 AS h
  FROM base
),
membership_events AS MATERIALIZED (
  SELECT ride_id AS event_id, user_id,
         CASE WHEN h < 14 THEN 'cta_shown' WHEN h < 22 THEN 'cta_clicked'
              WHEN h < 27 THEN 'signup_started' WHEN h < 32 THEN 'signup_step_completed'
              WHEN h < 36 THEN 'signup_abandoned' ELSE 'signup_completed' END AS event_type,
         started_at + INTERVAL '1' MINUTE * CAST(duration_min AS INT) AS event_at,
         CASE WHEN h = 36 THEN CASE WHEN sk % 3 = 0 THEN 'weekend' ELSE 'annual' END END AS membership_tier,
         CASE ok % 4 WHEN 0 THEN 'post_ride_nudge' WHEN 1 THEN 'email'
                     WHEN 2 THEN 'geo_offer' ELSE 'organic' END AS source_channel,
         CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS nudge_variant,
         concat('{"step": "', pk % 3 + 2, '"}') AS event_metadata
  FROM rides WHERE h < 37
),
first_rides AS (SELECT user_id, MIN(started_at) AS first_ride_at FROM rides GROUP BY user_id),
users AS MATERIALIZED (
  SELECT c_custkey AS user_id, f.first_ride_at,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Weekend Explorer' WHEN 'BUILDING' THEN 'Reluctant Commuter'
              WHEN 'FURNITURE' THEN 'Seasonal Visitor' WHEN 'HOUSEHOLD' THEN 'E-bike Adopter' END AS persona_segment
  FROM customer LEFT JOIN first_rides f ON f.user_id = c_custkey
),
app_events AS (
  SELECT user_id, started_at AS event_at,
         CASE WHEN pk % 25 = 0 THEN 'app_uninstall' ELSE 'app_open' END AS event_type
  FROM rides WHERE (pk + ln) % 4 = 0
)"""


def r(expr: str, digits: int = 0) -> str:
    """Half away from zero on doubles, step by step as the operators do it."""
    scale = f"CAST({10**digits} AS DOUBLE)"
    x = f"CAST({expr} AS DOUBLE)"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale} + 0.0)"


def q(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


def n(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def days_ago(days: int) -> str:
    return f"({AS_OF} - INTERVAL {days} DAY)"
