"""The logical tables as DuckDB common table expressions over the raw tables."""

from __future__ import annotations

import re

AS_OF = "DATE '2024-01-31'"
DAY_BEFORE = "DATE '2024-01-30'"
BACKFILL = "DATE '2024-01-11'"


def r(expr: str, name: str) -> str:
    """A DOUBLE output column, rounded as the Spark side rounds it: to 10 places, then to 6."""
    return f"CAST(round(CAST(CAST({expr} AS DOUBLE) AS DECIMAL(38, 10)), 6) AS DOUBLE) AS {name}"


def activity_view(as_of: str) -> str:
    return f"""
SELECT u.user_id, u.segment, u.status,
       CAST(date_diff('day', u.account_created_date, {as_of}) AS INTEGER) AS account_age_days,
       u.portfolio_value, u.n_assets,
       coalesce(t.trades_30d, 0) AS trades_30d, t.avg_trade_size,
       CAST(CASE WHEN l.login <= {as_of} THEN date_diff('day', l.login, {as_of}) END AS INTEGER) AS days_since_login,
       (t.recent - t.prior) / nullif(CAST(t.prior AS DOUBLE), 0) AS trade_freq_trend,
       CASE WHEN u.user_id IN (SELECT user_id FROM yield_products) THEN 1 ELSE 0 END AS yield_adoption,
       CASE WHEN u.user_id IN (SELECT user_id FROM advanced_users) THEN 1 ELSE 0 END AS advanced_trading
FROM users u
LEFT JOIN (
  SELECT user_id, count(*) AS trades_30d, avg(trade_amount) AS avg_trade_size,
         count(*) FILTER (trade_date >= {as_of} - 14) AS recent,
         count(*) FILTER (trade_date BETWEEN {as_of} - 28 AND {as_of} - 14) AS prior
  FROM trades WHERE trade_date >= {as_of} - 30 AND trade_date <= {as_of} GROUP BY user_id
) t ON t.user_id = u.user_id
LEFT JOIN (
  SELECT c_custkey AS user_id, coalesce(
    (SELECT max(CAST(ts AS DATE)) FROM events e WHERE e.user_id = c_custkey AND event_type = 'view'
       AND value > 50 AND CAST(ts AS DATE) <= {as_of}),
    {AS_OF} - CAST(c_custkey % 60 AS INTEGER)) AS login
  FROM customer
) l ON l.user_id = u.user_id
WHERE u.account_created_date <= {as_of}"""


def engagement(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return (
        f"(2 * coalesce(CAST({p}days_since_login < 7 AS INTEGER), 0)"
        f" + coalesce(CAST({p}trades_30d > 5 AS INTEGER), 0)"
        f" + {p}yield_adoption + {p}advanced_trading)"
    )


RISKY = "coalesce(CAST(days_since_login > 14 OR trade_freq_trend < -0.3 OR n_assets = 1 AS INTEGER), 0)"


def tier(high: str, medium: str, low: str) -> str:
    return (
        f"CASE WHEN days_since_login > 14 OR trade_freq_trend < -0.3 THEN '{high}'"
        f" WHEN days_since_login > 7 OR engagement_score < 2 THEN '{medium}' ELSE '{low}' END"
    )


def probability(trend: str) -> str:
    return (
        f"1 / (1 + exp(-(-2.5 + 0.15 * days_since_login - 0.8 * {trend} - 0.5 * engagement_score"
        f" + 1.2 * {RISKY} + 0.3 / n_assets - 0.4 * yield_adoption)))"
    )


def scores_view(activity: str, as_of: str) -> str:
    return f"""
SELECT *, {probability('trade_freq_trend')} AS churn_probability,
       {tier('high', 'medium', 'low')} AS risk_tier,
       CAST({as_of} AS TIMESTAMP) AS scored_at
FROM (SELECT *, {engagement()} AS engagement_score FROM {activity} WHERE status = 'active')"""


PRIOR = """least(0.95, CASE segment WHEN 'casual' THEN 0.35 WHEN 'active' THEN 0.15
  WHEN 'power_user' THEN 0.05 WHEN 'whale' THEN 0.03 END
  + CASE WHEN days_since_login > 14 THEN 0.4 WHEN days_since_login > 7 THEN 0.2 ELSE 0 END
  + CASE WHEN trade_freq_trend < -0.3 THEN 0.15 ELSE 0 END
  + CASE WHEN yield_adoption = 0 THEN 0.1 ELSE 0 END + CASE WHEN n_assets = 1 THEN 0.1 ELSE 0 END
  + CASE WHEN portfolio_return_30d < -10 THEN 0.1 ELSE 0 END)"""

SCALED = (
    "trades_30d", "avg_trade_size", "trading_intensity", "trade_freq_trend", "account_age_days",
    "portfolio_value", "n_assets", "portfolio_concentration", "days_since_login",
    "engagement_score", "yield_adoption", "advanced_trading", "volatility_sensitivity",
    "portfolio_return_30d", "high_risk_profile", "segment_encoded", "account_stage_encoded",
)

VIEWS = {
    "users": f"""
SELECT c_custkey AS user_id, c_name AS email, c_mktsegment AS segment,
       {AS_OF} - CAST(1 + c_custkey * 37 % 730 AS INTEGER) AS account_created_date,
       c_acctbal * 10 AS portfolio_value, CAST(1 + c_nationkey % 10 AS INTEGER) AS n_assets,
       coalesce(l.seen, {AS_OF} - CAST(c_custkey % 60 AS INTEGER)) AS last_login_date,
       CASE WHEN c_custkey % 7 = 0 THEN 'churned' ELSE 'active' END AS status,
       CASE WHEN c_custkey % 7 = 0 THEN greatest(
         {AS_OF} - CAST(1 + c_custkey * 37 % 730 AS INTEGER),
         {AS_OF} - CAST(c_custkey % 45 AS INTEGER)) END AS churned_date
FROM customer LEFT JOIN (
  SELECT user_id, max(CAST(ts AS DATE)) AS seen FROM events
  WHERE event_type = 'view' AND value > 50 GROUP BY user_id
) l ON l.user_id = c_custkey""",
    "trades": """
SELECT event_id AS trade_id, user_id, value AS trade_amount, CAST(ts AS DATE) AS trade_date
FROM events WHERE event_type = 'purchase'""",
    "yield_products": "SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100",
    "advanced_users": "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 150",
    "interventions": """
SELECT user_id, CAST(ts AS DATE) AS intervention_date
FROM events WHERE event_type = 'click' AND value > 100""",
    "enrollments": f"""
SELECT c_custkey AS user_id,
       CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE 'yield_education_intervention' END AS test_name,
       CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant,
       {AS_OF} - CAST(c_custkey % 80 AS INTEGER) AS enrolled_date
FROM customer WHERE c_custkey % 3 <> 0""",
    "snapshots": f"""
SELECT d.user_id, d.snapshot_date,
       greatest(u.portfolio_value, 0) + sum(coalesce(g.gain, 0)) OVER (
         PARTITION BY d.user_id ORDER BY d.snapshot_date) AS portfolio_value
FROM (SELECT e.user_id, CAST(s.day AS DATE) AS snapshot_date
      FROM (SELECT DISTINCT user_id FROM events) e,
           (SELECT unnest(generate_series(DATE '2023-12-01', {AS_OF}, INTERVAL 1 DAY)) AS day) s) d
JOIN users u ON u.user_id = d.user_id
LEFT JOIN (SELECT user_id, greatest(CAST(ts AS DATE), DATE '2023-12-01') AS day, sum(value) AS gain FROM events
           WHERE CAST(ts AS DATE) <= {AS_OF} GROUP BY ALL) g
  ON g.user_id = d.user_id AND g.day = d.snapshot_date""",
    "logged_scores": """
SELECT user_id, least(value / 200, 1) AS churn_probability,
       CASE WHEN value > 70 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS risk_tier,
       ts - INTERVAL 40 DAY AS scored_at
FROM events WHERE event_type = 'error'""",
    "activity": activity_view(AS_OF),
    "activity_before": activity_view(DAY_BEFORE),
    "activity_past": activity_view(BACKFILL),
    "scores": scores_view("activity", AS_OF),
    "scores_before": scores_view("activity_before", DAY_BEFORE),
    "scores_past": scores_view("activity_past", BACKFILL),
    "recent_scores": "SELECT * FROM scores UNION ALL SELECT * FROM scores_before",
    "base_features": """
SELECT user_id,
       CASE segment WHEN 'AUTOMOBILE' THEN 'whale' WHEN 'MACHINERY' THEN 'power_user'
                    WHEN 'BUILDING' THEN 'active' ELSE 'casual' END AS segment,
       CAST(account_age_days AS INTEGER) AS account_age_days, portfolio_value, n_assets, trades_30d,
       coalesce(avg_trade_size, 0) AS avg_trade_size,
       CAST(days_since_login AS DOUBLE) AS days_since_login,
       coalesce(trade_freq_trend, 0) AS trade_freq_trend, yield_adoption, advanced_trading,
       round(user_id * 17 % 600 / 100.0 - 3, 3) AS volatility_sensitivity,
       round(user_id * 13 % 600 / 10.0 - 30, 2) AS portfolio_return_30d,
       CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS churned
FROM activity""",
    "user_features": f"""
SELECT *, trades_30d / 4.3 / ln(1 + account_age_days / 7.0) AS trading_intensity,
       1.0 / n_assets AS portfolio_concentration,
       CAST({engagement()} AS INTEGER) AS engagement_score,
       {RISKY} AS high_risk_profile,
       CASE WHEN account_age_days BETWEEN 1 AND 30 THEN 'new'
            WHEN account_age_days BETWEEN 31 AND 90 THEN 'growing'
            WHEN account_age_days BETWEEN 91 AND 180 THEN 'established'
            WHEN account_age_days BETWEEN 181 AND 365 THEN 'mature'
            WHEN account_age_days BETWEEN 366 AND 730 THEN 'veteran' END AS account_stage
FROM base_features""",
    "segmented": f"""
SELECT *, {tier('high_risk', 'medium_risk', 'low_risk')} AS risk_segment,
       CASE WHEN portfolio_value <= 0 THEN NULL WHEN portfolio_value <= 1000 THEN 'small'
            WHEN portfolio_value <= 10000 THEN 'medium' WHEN portfolio_value <= 50000 THEN 'large'
            ELSE 'whale' END AS value_segment
FROM user_features""",
    "encoded": """
SELECT *, CAST(dense_rank() OVER (ORDER BY segment) - 1 AS INTEGER) AS segment_encoded,
       CAST(dense_rank() OVER (ORDER BY account_stage) - 1 AS INTEGER) AS account_stage_encoded
FROM user_features""",
    "split_rows": """
SELECT *, CASE WHEN rn <= n_test THEN 'test'
               WHEN rn <= n_test + round((n - n_test) * CAST(0.125 AS DOUBLE)) THEN 'val'
               ELSE 'train' END AS split
FROM (SELECT *, round(n * CAST(0.2 AS DOUBLE)) AS n_test
      FROM (SELECT *, count(*) OVER (PARTITION BY churned) AS n,
                   row_number() OVER (PARTITION BY churned
                     ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) AS rn
            FROM encoded))""",
    "learnable": f"""
SELECT user_id, churned, row_number() OVER (PARTITION BY churned ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) AS rn,
       count(*) OVER (PARTITION BY churned) AS n
FROM (SELECT user_id, CASE WHEN {PRIOR} > CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0
                           THEN 1 ELSE 0 END AS churned FROM user_features)""",
    "held_out": """
SELECT user_id, churned, CASE WHEN rn <= n_test THEN 'test' ELSE 'val' END AS split
FROM (SELECT *, round(n * CAST(0.2 AS DOUBLE)) AS n_test FROM learnable)
WHERE rn <= n_test + round((n - n_test) * CAST(0.125 AS DOUBLE))""",
    "scored": """
SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, score,
       CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction
FROM (SELECT l_returnflag, round(l_discount * 5 + l_quantity / 100, 2) AS score FROM lineitem)""",
    "steps": """
SELECT score, sum(label) AS pos, sum(1 - label) AS neg,
       sum(sum(label)) OVER (ORDER BY score DESC) AS tp,
       sum(sum(1 - label)) OVER (ORDER BY score DESC) AS fp,
       sum(sum(label)) OVER () AS p, sum(sum(1 - label)) OVER () AS q
FROM scored GROUP BY score""",
    "scorers": f"""
SELECT model, user_id, churned AS label,
       CAST(round(CAST(CAST(raw AS DOUBLE) AS DECIMAL(38, 10)), 6) AS DOUBLE) AS score
FROM (SELECT 'published_logit' AS model, user_id, churned, {probability('trade_freq_trend')} AS raw FROM user_features
      UNION ALL SELECT 'rule_prior', user_id, churned, {PRIOR} FROM user_features)""",
    "model_steps": """
SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg,
       sum(sum(label)) OVER (PARTITION BY model ORDER BY score DESC) AS tp,
       sum(sum(1 - label)) OVER (PARTITION BY model ORDER BY score DESC) AS fp,
       sum(sum(label)) OVER (PARTITION BY model) AS p, sum(sum(1 - label)) OVER (PARTITION BY model) AS q
FROM scorers GROUP BY model, score""",
    "returns": """
SELECT CAST(ts AS DATE) AS date, (avg(value) - 50) / 1000 AS daily_return FROM events GROUP BY 1""",
}


VIEWS["operational"] = f"""
SELECT b.*, {RISKY} AS high_risk_profile, 1.0 / n_assets AS portfolio_concentration,
       CAST({engagement()} AS INTEGER) AS engagement_score
FROM (SELECT a.user_id, a.segment, a.account_age_days, a.portfolio_value, a.n_assets, a.trades_30d,
             coalesce(a.avg_trade_size, 0) AS avg_trade_size,
             CAST(coalesce(a.days_since_login, a.account_age_days) AS DOUBLE) AS days_since_login,
             coalesce(a.trade_freq_trend, 0) AS trade_freq_trend, a.yield_adoption, a.advanced_trading,
             coalesce(s.gain, 0) AS portfolio_return_30d,
             CASE WHEN a.status = 'churned' THEN 1 ELSE 0 END AS churned
      FROM activity a LEFT JOIN (
        SELECT user_id, (portfolio_value - earlier) / nullif(earlier, 0) * 100 AS gain
        FROM (SELECT *, lag(portfolio_value, 30) OVER (PARTITION BY user_id ORDER BY snapshot_date) AS earlier
              FROM snapshots)
        WHERE snapshot_date = {AS_OF}) s ON s.user_id = a.user_id) b"""


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it uses, directly or through others, in order."""
    needed: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                queue.append(view)
    parts = [f"{name} AS ({view.strip()})" for name, view in VIEWS.items() if name in needed]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body.strip()
