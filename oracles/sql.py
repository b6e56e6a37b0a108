"""The expected result of every query that SQL can state."""

from __future__ import annotations

import math

from oracles.views import AS_OF, DAY_BEFORE, PRIOR, SCALED, probability, r, with_views

FEATURE_COLUMNS = (
    "user_id, segment, account_age_days, portfolio_value, n_assets, trades_30d, avg_trade_size,"
    " days_since_login, trade_freq_trend, yield_adoption, advanced_trading, volatility_sensitivity,"
    " portfolio_return_30d, churned, trading_intensity, portfolio_concentration, engagement_score,"
    " high_risk_profile, account_stage"
).split(", ")

DOUBLES = {
    "portfolio_value", "avg_trade_size", "days_since_login", "trade_freq_trend",
    "volatility_sensitivity", "portfolio_return_30d", "trading_intensity",
    "portfolio_concentration",
}

NUMERIC = [name for name in FEATURE_COLUMNS if name not in ("user_id", "segment", "account_stage")]
# The bound ids are numbers too.
NUMERIC_BOUND = ["user_id", *NUMERIC]

HEATMAP = (
    "churned", "days_since_login", "trade_freq_trend", "engagement_score",
    "trades_30d", "n_assets", "yield_adoption", "portfolio_value",
)

FEATURE_ROWS = ", ".join(
    r(name, name) if name in DOUBLES else name for name in FEATURE_COLUMNS
)


def rates(key: str, source: str = "user_features") -> str:
    return f"""
SELECT {key}, {r('avg(churned)', 'churn_rate')}, count(churned) AS n_users
FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}"""


def complete_rates(key: str, labels: list[str], source: str) -> str:
    domain = ", ".join(f"({i}, '{label}')" for i, label in enumerate(labels))
    return f"""
SELECT d.label AS {key}, d.position, {r('avg(s.churned)', 'churn_rate')}, count(s.churned) AS n_users
FROM (VALUES {domain}) d(position, label) LEFT JOIN {source} s ON s.{key} = d.label
GROUP BY d.label, d.position"""


def experiment(extra: str, churn: str) -> str:
    se = "sqrt(p * (1 - p) / n)"
    return f"""
SELECT variant, n AS n_users, k AS churned_count, {r('p', 'churn_rate')}, {r(se, 'std_error')},
       {r(f'p - 1.96 * {se}', 'ci_lower')}, {r(f'p + 1.96 * {se}', 'ci_upper')}
FROM (SELECT variant, count(*) AS n, CAST(count(*) FILTER ({churn}) AS BIGINT) AS k,
             count(*) FILTER ({churn}) / CAST(count(*) AS DOUBLE) AS p
      FROM enrollments JOIN users USING (user_id)
      WHERE test_name = 'yield_education_intervention' AND enrolled_date >= {AS_OF} - 60 {extra}
      GROUP BY variant)"""


def bootstrap(replicates: int = 200) -> str:
    """Both arms drawn by the bits of each user's md5, four replicates to a hash."""
    steps = []
    for k in range(64):
        step = int(sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) * 2**32)
        if steps and step <= steps[-1]:
            break
        steps.append(step)
    weight = " + ".join(f"CAST(u >= {step} AS INTEGER)" for step in steps)
    rows = f"""(SELECT e.user_id, variant,
    coalesce(date_diff('day', enrolled_date, churned_date) BETWEEN 0 AND 30, false) AS hit
  FROM enrollments e JOIN users USING (user_id)
  WHERE test_name = 'yield_education_intervention' AND enrolled_date BETWEEN {AS_OF} - 60 AND {AS_OF} - 30)"""
    drawn = f"""(SELECT variant, replicate, sum(w) FILTER (hit) / nullif(CAST(sum(w) AS DOUBLE), 0) AS rate
  FROM (SELECT variant, replicate, hit, {weight} AS w
        FROM (SELECT variant, hit, block * 4 + i AS replicate,
                     CAST('0x' || substr(md5(user_id || ':' || block), 8 * i + 1, 8) AS BIGINT) AS u
              FROM {rows}, (SELECT unnest(range(0, {replicates // 4})) AS block), (SELECT unnest(range(0, 4)) AS i)))
  GROUP BY variant, replicate)"""
    z2 = "3.8414588206941236"
    middle = f"(p + {z2} / (2 * n)) / (1 + {z2} / n)"
    half = f"1.959963984540054 * sqrt(p * (1 - p) / n + {z2} / (4.0 * n * n)) / (1 + {z2} / n)"
    return f"""
SELECT o.variant, n AS n_users, k AS churned_count, {r('p', 'churn_rate')}, {r('q.lo', 'ci_lower')}, {r('q.hi', 'ci_upper')},
       {r(f'{middle} - {half}', 'wilson_lower')}, {r(f'{middle} + {half}', 'wilson_upper')},
       {r("p - max(CASE WHEN o.variant = 'control' THEN p END) OVER ()", 'lift')},
       {r('q.lift_lo', 'lift_lower')}, {r('q.lift_hi', 'lift_upper')}
FROM (SELECT variant, count(*) AS n, count(*) FILTER (hit) AS k, count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS p
      FROM {rows} GROUP BY variant) o
JOIN (SELECT a.variant, quantile_cont(a.rate, 0.025) AS lo, quantile_cont(a.rate, 0.975) AS hi,
             quantile_cont(a.rate - b.rate, 0.025) AS lift_lo, quantile_cont(a.rate - b.rate, 0.975) AS lift_hi
      FROM {drawn} a JOIN {drawn} b ON b.replicate = a.replicate AND b.variant = 'control'
      GROUP BY a.variant) q ON q.variant = o.variant"""


def described(name: str) -> str:
    quartiles = ", ".join(r(f"quantile_cont({name}, {q})", f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75))
    return f"""
SELECT '{name}' AS column_name, count({name}) AS n, {r(f'avg({name})', 'mean')},
       {r(f'stddev_samp({name})', 'std')}, {r(f'min({name})', '"min"')}, {quartiles},
       {r(f'max({name})', '"max"')}
FROM user_features"""


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["churn_daily_scoring"] = f"""
SELECT user_id, {r('churn_probability', 'churn_probability')}, risk_tier, days_since_login,
       engagement_score, scored_at
FROM scores ORDER BY churn_probability DESC NULLS LAST, user_id"""

    sql["churn_scoring_backfill"] = f"""
SELECT user_id, {r('churn_probability', 'churn_probability')}, risk_tier, days_since_login,
       engagement_score, scored_at
FROM scores_past"""

    trendless = "coalesce(trade_freq_trend, 0)"
    sql["churn_daily_scoring_zero_trend"] = f"""
SELECT user_id, {r(probability(trendless), 'churn_probability')}, risk_tier, days_since_login,
       engagement_score, scored_at
FROM scores"""

    sql["activity_features"] = f"""
SELECT user_id, segment, account_age_days, {r('portfolio_value', 'portfolio_value')}, n_assets,
       trades_30d, {r('avg_trade_size', 'avg_trade_size')}, days_since_login,
       {r('trade_freq_trend', 'trade_freq_trend')}, yield_adoption, advanced_trading
FROM activity WHERE status = 'active'"""

    sql["portfolio_return_lag30"] = f"""
SELECT user_id, snapshot_date, {r('portfolio_value', 'portfolio_value')},
       {r('(portfolio_value - earlier) / nullif(earlier, 0) * 100', 'portfolio_return_30d')}
FROM (SELECT *, lag(portfolio_value, 30) OVER (PARTITION BY user_id ORDER BY snapshot_date) AS earlier
      FROM snapshots)"""

    priority = "0.6 * churn_probability + 0.4 * (s.portfolio_value / 10000)"
    sql["high_risk_targeting"] = f"""
SELECT s.user_id, u.email, u.segment, {r('churn_probability', 'churn_probability')}, risk_tier,
       days_since_login, trades_30d, {r('s.portfolio_value', 'portfolio_value')},
       CASE WHEN days_since_login BETWEEN 7 AND 14 THEN
              CASE WHEN yield_adoption = 0 AND s.portfolio_value > 1000
                   THEN 'yield_product_education' ELSE 'general_reengagement' END
            WHEN s.n_assets = 1 AND s.portfolio_value > 500 THEN 'diversification_education'
            WHEN trade_freq_trend < -0.5 THEN 'market_insights_content'
            ELSE 'standard_retention' END AS recommended_intervention,
       {r(priority, 'intervention_priority')}
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY scored_at DESC) AS run
      FROM recent_scores WHERE scored_at >= {DAY_BEFORE}) s
JOIN users u ON u.user_id = s.user_id
WHERE run = 1 AND risk_tier <> 'low'
ORDER BY {priority} DESC NULLS LAST, s.user_id LIMIT 10000"""

    sql["cohort_retention"] = f"""
SELECT cohort_month, segment, count(*) AS cohort_size,
       count(*) FILTER (status = 'churned') AS churned_users,
       {r("count(*) FILTER (status = 'churned') / CAST(count(*) AS DOUBLE)", 'churn_rate')},
       {r("avg(date_diff('day', account_created_date, coalesce(churned_date, " + AS_OF + ")))", 'avg_lifetime_days')},
       count(*) FILTER (reached) AS users_with_intervention,
       {r("count(*) FILTER (reached AND status = 'active') / nullif(CAST(count(*) FILTER (reached) AS DOUBLE), 0)", 'intervention_retention_rate')}
FROM (SELECT u.*, CAST(date_trunc('month', account_created_date) AS DATE) AS cohort_month,
             EXISTS (SELECT 1 FROM interventions i WHERE i.user_id = u.user_id
                     AND i.intervention_date >= u.account_created_date) AS reached
      FROM users u)
WHERE cohort_month >= DATE '2023-01-31'
GROUP BY cohort_month, segment ORDER BY cohort_month DESC, segment"""

    sql["model_calibration"] = f"""
SELECT prediction_date, risk_tier, count(*) AS total_predictions,
       count(*) FILTER (date_diff('day', prediction_date, churned_date) <= 30) AS actual_churned,
       {r('avg(CASE WHEN churned_date IS NULL THEN 0 ELSE 1 END)', 'actual_churn_rate')},
       {r('avg(churn_probability)', 'avg_predicted_prob')},
       {r('avg(churn_probability) - avg(CASE WHEN churned_date IS NULL THEN 0 ELSE 1 END)', 'calibration_error')},
       {r("CASE WHEN risk_tier = 'high' THEN count(*) FILTER (date_diff('day', prediction_date, churned_date) <= 30) / CAST(count(*) AS DOUBLE) END", 'high_risk_precision')}
FROM (SELECT user_id, churn_probability, risk_tier, CAST(scored_at AS DATE) AS prediction_date
      FROM logged_scores WHERE scored_at >= {AS_OF} - 60) s
LEFT JOIN (SELECT user_id, churned_date FROM users WHERE churned_date >= {AS_OF} - 30) u USING (user_id)
WHERE prediction_date <= {AS_OF} - 30
GROUP BY prediction_date, risk_tier"""

    elapsed = "date_diff('day', enrolled_date, churned_date)"
    sql["ab_test_ci"] = experiment("", f"{elapsed} <= 30")
    sql["ab_test_ci_observed"] = experiment(
        f"AND enrolled_date <= {AS_OF} - 30", f"{elapsed} BETWEEN 0 AND 30"
    )

    sql["ab_test_bootstrap"] = bootstrap()
    reach = ", ".join(
        f"count(DISTINCT CASE WHEN {condition} THEN user_id END) AS {name}"
        for name, condition in (
            ("users", "true"),
            ("users_with_intervention", "intervention_date >= account_created_date"),
            ("retained", "intervention_date >= account_created_date AND status = 'active'"),
        )
    )
    joined = """(SELECT u.user_id, u.segment, u.status, u.account_created_date, i.intervention_date,
  CAST(date_trunc('month', u.account_created_date) AS DATE) AS cohort_month
  FROM users u LEFT JOIN interventions i ON i.user_id = u.user_id)"""
    levels = {
        "cohort_segment": ("cohort_month", "segment"), "cohort": ("cohort_month",),
        "day": ("intervention_date",), "all": (),
    }
    kinds = {"cohort_month": "DATE", "segment": "VARCHAR", "intervention_date": "DATE"}
    sql["contact_reach"] = " UNION ALL ".join(
        f"SELECT '{level}' AS level, "
        + ", ".join(name if name in kept else f"CAST(NULL AS {kind}) AS {name}" for name, kind in kinds.items())
        + f", {reach} FROM {joined}"
        + (f" GROUP BY {', '.join(kept)}" if kept else "")
        for level, kept in levels.items()
    )
    sql["contacted_users_trailing"] = f"""
SELECT d.day AS intervention_date, count(DISTINCT i.user_id) FILTER (i.intervention_date = d.day) AS users_day,
       count(DISTINCT i.user_id) AS users_trailing
FROM (SELECT DISTINCT CAST(unnest(generate_series(intervention_date,
        least(intervention_date + 6, {AS_OF}), INTERVAL 1 DAY)) AS DATE) AS day
      FROM interventions WHERE intervention_date <= {AS_OF}) d
JOIN interventions i ON i.intervention_date BETWEEN d.day - 6 AND d.day GROUP BY d.day"""
    sql["signup_contacts"] = f"""
SELECT CAST(date_trunc('month', u.account_created_date) AS DATE) AS cohort_month, u.segment,
       count(*) AS n_users, count(m.k) AS contacted_users, CAST(coalesce(sum(m.k), 0) AS BIGINT) AS n_contacts,
       {r('avg(m.wait)', 'avg_days_to_contact')}
FROM users u LEFT JOIN (
  SELECT v.user_id, count(*) AS k, min(date_diff('day', v.account_created_date, i.intervention_date)) AS wait
  FROM users v JOIN interventions i ON i.user_id = v.user_id
    AND i.intervention_date BETWEEN v.account_created_date AND v.account_created_date + 90
  WHERE i.intervention_date <= {AS_OF} GROUP BY v.user_id) m ON m.user_id = u.user_id
GROUP BY 1, 2"""
    sql["market_after_signup"] = f"""
SELECT CAST(date_trunc('month', account_created_date) AS DATE) AS cohort_month, segment,
       count(*) AS n_user_days, {r('avg(daily_return)', 'avg_return')}
FROM users JOIN returns ON date BETWEEN account_created_date AND account_created_date + 29
GROUP BY 1, 2"""

    sql["derived_features"] = f"""
SELECT user_id, {r('trading_intensity', 'trading_intensity')},
       {r('portfolio_concentration', 'portfolio_concentration')}, engagement_score,
       high_risk_profile, account_stage
FROM user_features"""
    sql["operational_features"] = f"""
SELECT user_id, segment, account_age_days, {r('portfolio_value', 'portfolio_value')}, n_assets, trades_30d,
       {r('avg_trade_size', 'avg_trade_size')}, days_since_login, {r('trade_freq_trend', 'trade_freq_trend')},
       yield_adoption, advanced_trading, {r('portfolio_return_30d', 'portfolio_return_30d')}, churned,
       {r('trades_30d / 4.3 / nullif(ln(1 + account_age_days / 7.0), 0)', 'trading_intensity')},
       {r('portfolio_concentration', 'portfolio_concentration')}, engagement_score, high_risk_profile,
       CASE WHEN account_age_days BETWEEN 1 AND 30 THEN 'new'
            WHEN account_age_days BETWEEN 31 AND 90 THEN 'growing'
            WHEN account_age_days BETWEEN 91 AND 180 THEN 'established'
            WHEN account_age_days BETWEEN 181 AND 365 THEN 'mature'
            WHEN account_age_days BETWEEN 366 AND 730 THEN 'veteran' END AS account_stage
FROM operational"""
    sql["interaction_features"] = f"""
SELECT user_id, {r('portfolio_value / (engagement_score + 1)', 'value_engagement_ratio')},
       {r('days_since_login * greatest(-trade_freq_trend, 0)', 'inactivity_decline_risk')},
       {r('portfolio_concentration * greatest(-portfolio_return_30d, 0)', 'concentration_loss')}
FROM user_features"""
    sql["user_segments"] = "SELECT user_id, risk_segment, value_segment FROM segmented"
    sql["rule_churn_prior"] = f"SELECT user_id, {r(PRIOR, 'churn_prior')} FROM user_features"

    sql["churn_by_segment"] = rates("segment")
    sql["churn_by_yield"] = rates("yield_adoption")
    sql["churn_by_advanced"] = rates("advanced_trading")
    sql["churn_by_assets"] = rates("n_assets")
    age = """(SELECT churned, CASE WHEN account_age_days BETWEEN 1 AND 30 THEN '0-30d'
  WHEN account_age_days BETWEEN 31 AND 90 THEN '31-90d'
  WHEN account_age_days BETWEEN 91 AND 180 THEN '91-180d'
  WHEN account_age_days BETWEEN 181 AND 365 THEN '181-365d'
  WHEN account_age_days BETWEEN 366 AND 730 THEN '365+d' END AS age_bucket FROM user_features)"""
    sql["churn_by_age_bucket"] = complete_rates(
        "age_bucket", ["0-30d", "31-90d", "91-180d", "181-365d", "365+d"], age
    )
    sql["churn_by_risk"] = complete_rates(
        "risk_segment", ["low_risk", "medium_risk", "high_risk"], "segmented"
    )
    dimensions = {name: name for name in ("segment", "yield_adoption", "advanced_trading", "n_assets", "risk_segment")}
    sql["churn_by_all"] = " UNION ALL ".join(
        f"SELECT '{name}' AS dimension, CAST({name} AS VARCHAR) AS value, {r('avg(churned)', 'churn_rate')},"
        f" count(churned) AS n_users FROM {source} WHERE {name} IS NOT NULL GROUP BY {name}"
        for name, source in {**dict.fromkeys(dimensions, "segmented"), "age_bucket": age}.items()
    )
    sql["profile_shape"] = f"""
SELECT count(*) AS n_rows, 19 AS n_columns, {r('avg(churned)', 'churn_rate')} FROM user_features"""
    sql["profile_value_counts"] = f"""
SELECT segment, count(*) AS n, {r('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', '"share"')}
FROM user_features GROUP BY segment"""
    sql["profile_describe"] = " UNION ALL ".join(described(name) for name in NUMERIC_BOUND)
    activity = (
        "user_id segment account_age_days portfolio_value n_assets trades_30d avg_trade_size"
        " days_since_login trade_freq_trend yield_adoption advanced_trading"
    ).split()
    sql["profile_null_counts"] = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) - count({name}) AS n_null FROM activity"
        for name in activity
    )
    sql["corr_with_target"] = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, {r(f'corr({name}, churned)', 'correlation')} FROM user_features"
        for name in NUMERIC_BOUND
    )
    sql["corr_matrix"] = " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})', 'correlation')}"
        " FROM user_features"
        for a in HEATMAP
        for b in HEATMAP
    )
    numeric = [name for name in NUMERIC_BOUND if name not in ("avg_trade_size", "trade_freq_trend")]
    cells = ", ".join(f"('{name}', CAST({name} AS DOUBLE))" for name in numeric)
    cells += ", ('avg_trade_size', nullif(avg_trade_size, 0)), ('trade_freq_trend', nullif(trade_freq_trend, 0))"
    long = f"(SELECT user_id AS id, name, x FROM user_features, LATERAL (VALUES {cells}) v(name, x) WHERE x IS NOT NULL)"
    sql["comoment_matrix"] = f"""
SELECT a.name AS feature_a, b.name AS feature_b, {r('CASE WHEN stddev_pop(a.x) * stddev_pop(b.x) > 0 THEN corr(a.x, b.x) END', 'correlation')}, count(*) AS n
FROM {long} a JOIN {long} b ON a.id = b.id GROUP BY a.name, b.name"""
    sql["histogram_by_class"] = f"""
SELECT b.churned, b.bin, {r('lo + (hi - lo) / 30 * (b.bin - 1)', 'bin_lo')},
       {r('lo + (hi - lo) / 30 * b.bin', 'bin_hi')}, count(x) AS n
FROM (SELECT *, unnest(range(1, 31)) AS bin
      FROM (SELECT churned, min(days_since_login) AS lo, max(days_since_login) AS hi
            FROM user_features GROUP BY churned)) b
LEFT JOIN (SELECT f.churned, f.days_since_login AS x,
                  least(CAST(floor(30 * (days_since_login - l) / (h - l)) AS BIGINT) + 1, 30) AS bin
           FROM user_features f
           JOIN (SELECT churned, min(days_since_login) AS l, max(days_since_login) AS h
                 FROM user_features GROUP BY churned) m ON m.churned = f.churned) v
  ON v.churned = b.churned AND v.bin = b.bin
GROUP BY b.churned, b.bin, lo, hi"""
    sql["boxplot_by_class"] = f"""
SELECT f.churned, {r('q1', 'q1')}, {r('median', 'median')}, {r('q3', 'q3')},
       {r('min(x) FILTER (x >= q1 - 1.5 * (q3 - q1))', 'whisker_lo')},
       {r('max(x) FILTER (x <= q3 + 1.5 * (q3 - q1))', 'whisker_hi')},
       count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT churned, days_since_login AS x FROM user_features) f
JOIN (SELECT churned, quantile_cont(days_since_login, 0.25) AS q1,
             quantile_cont(days_since_login, 0.5) AS median,
             quantile_cont(days_since_login, 0.75) AS q3
      FROM user_features GROUP BY churned) q ON q.churned = f.churned
GROUP BY f.churned, q1, median, q3"""
    sql["head_preview"] = f"SELECT {FEATURE_ROWS} FROM user_features ORDER BY user_id LIMIT 10"

    sql["label_encode"] = """
SELECT user_id, segment, account_stage, segment_encoded, account_stage_encoded FROM encoded"""
    sql["stratified_split"] = "SELECT user_id, churned, split FROM split_rows"
    scaled = ", ".join(
        r(
            f"({name} - avg({name}) FILTER (split = 'train') OVER ())"
            f" / nullif(stddev_pop({name}) FILTER (split = 'train') OVER (), 0)",
            f"{name}_scaled",
        )
        for name in SCALED
    )
    sql["standard_scale"] = f"SELECT user_id, split, {scaled} FROM split_rows"
    sql["class_weights"] = f"""
SELECT label, n, {r('sum(n) OVER () / CAST(2 * n AS DOUBLE)', 'balanced_weight')},
       {r('sum(n) FILTER (label = 0) OVER () / CAST(sum(n) FILTER (label = 1) OVER () AS DOUBLE)', 'scale_pos_weight')}
FROM (SELECT churned AS label, count(*) AS n FROM split_rows WHERE split = 'train' GROUP BY churned)"""
    sql["sample_rows"] = """
SELECT user_id, segment, churned FROM user_features
ORDER BY md5(CAST(user_id AS VARCHAR)), user_id LIMIT 1000"""

    sql["confusion_matrix"] = """
SELECT l.label, p.prediction, count(s.label) AS n
FROM (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) p(prediction)
LEFT JOIN scored s ON s.label = l.label AND s.prediction = p.prediction
GROUP BY l.label, p.prediction"""
    sql["classification_report"] = f"""
WITH per_class AS (
  SELECT k, name,
         count(*) FILTER (label = k AND prediction = k) / CAST(count(*) FILTER (prediction = k) AS DOUBLE) AS p,
         count(*) FILTER (label = k AND prediction = k) / CAST(count(*) FILTER (label = k) AS DOUBLE) AS c,
         count(*) FILTER (label = k) AS support
  FROM scored, (VALUES (0, 'Retained'), (1, 'Churned')) v(k, name) GROUP BY k, name),
lines AS (
  SELECT name, p, c, 2 * p * c / (p + c) AS f, support FROM per_class
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (
    SELECT avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS a, count(*) AS n FROM scored)
  UNION ALL SELECT 'macro avg', avg(p), avg(c), avg(2 * p * c / (p + c)), sum(support) FROM per_class
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(c * support) / sum(support),
    sum(2 * p * c / (p + c) * support) / sum(support), sum(support) FROM per_class)
SELECT name AS class_name, {r('p', '"precision"')}, {r('c', 'recall')}, {r('f', 'f1')},
       CAST(support AS BIGINT) AS support
FROM lines"""
    sql["roc_curve"] = f"""
SELECT {r('score', 'threshold')}, {r('fp / CAST(q AS DOUBLE)', 'fpr')}, {r('tp / CAST(p AS DOUBLE)', 'tpr')}
FROM steps UNION ALL SELECT NULL, 0.0, 0.0"""
    sql["pr_curve"] = f"""
SELECT {r('score', 'threshold')}, {r('tp / CAST(tp + fp AS DOUBLE)', '"precision"')},
       {r('tp / CAST(p AS DOUBLE)', 'recall')}, {r('p / CAST(p + q AS DOUBLE)', 'baseline')}
FROM steps UNION ALL SELECT NULL, 1.0, 0.0, {r('avg(label)', 'baseline')} FROM scored"""
    sql["auc_roc"] = f"""
SELECT {r('sum(neg * (tp - pos / 2.0)) / CAST(max(p) * max(q) AS DOUBLE)', 'auc_roc')} FROM steps"""
    sql["average_precision"] = f"""
SELECT {r('sum(pos / CAST(p AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE))', 'average_precision')} FROM steps"""
    sql["precision_at_top_decile"] = f"""
SELECT {r('max(cut)', 'threshold')}, count(*) AS n_selected, {r('avg(label)', 'precision_at_10pct')}
FROM scored, (SELECT quantile_cont(score, 0.9) AS cut FROM scored) WHERE score >= cut"""

    decided = """(SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scorers)"""
    area = "sum(neg * (tp - pos / 2.0)) / (CAST(max(p) AS DOUBLE) * max(q))"
    sql["scorer_comparison"] = f"""
SELECT a.model, {r('auc', 'auc_roc')}, {r('ap', 'auc_pr')}, {r('coalesce(prec, 0)', '"precision"')},
       {r('coalesce(rec, 0)', 'recall')}, {r('coalesce(f, 0)', 'f1')}, {r('top', 'precision_at_10pct')}
FROM (SELECT model, {area} AS auc, sum(pos / CAST(p AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE)) AS ap
      FROM model_steps GROUP BY model) a
JOIN (SELECT model, count(*) FILTER (label = 1 AND prediction = 1) / nullif(CAST(sum(prediction) AS DOUBLE), 0) AS prec,
             count(*) FILTER (label = 1 AND prediction = 1) / nullif(CAST(sum(label) AS DOUBLE), 0) AS rec,
             2 * count(*) FILTER (label = 1 AND prediction = 1) / nullif(CAST(sum(prediction) + sum(label) AS DOUBLE), 0) AS f
      FROM {decided} GROUP BY model) b ON b.model = a.model
JOIN (SELECT s.model, avg(label) AS top FROM scorers s
      JOIN (SELECT model, quantile_cont(score, 0.9) AS cut FROM scorers GROUP BY model) q ON q.model = s.model
      WHERE score >= cut GROUP BY s.model) t ON t.model = a.model"""
    sql["scorer_best"] = f"""
SELECT model, {r(area, 'auc_roc')} FROM model_steps GROUP BY model ORDER BY {area} DESC, model LIMIT 1"""
    sql["scorer_roc_curve"] = f"""
SELECT model, {r('score', 'threshold')}, {r('fp / CAST(q AS DOUBLE)', 'fpr')}, {r('tp / CAST(p AS DOUBLE)', 'tpr')}
FROM model_steps UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM scorers"""
    sql["scorer_pr_curve"] = f"""
SELECT model, {r('score', 'threshold')}, {r('tp / CAST(tp + fp AS DOUBLE)', '"precision"')},
       {r('tp / CAST(p AS DOUBLE)', 'recall')}, {r('p / CAST(p + q AS DOUBLE)', 'baseline')}
FROM model_steps UNION ALL
SELECT model, CAST(NULL AS DOUBLE), 1.0, 0.0, {r('avg(label)', 'baseline')} FROM scorers GROUP BY model"""
    sql["scorer_confusion"] = f"""
SELECT m.model, l.label, p.prediction, count(s.label) AS n
FROM (SELECT DISTINCT model FROM scorers) m CROSS JOIN (VALUES (0), (1)) l(label)
CROSS JOIN (VALUES (0), (1)) p(prediction)
LEFT JOIN {decided} s ON s.model = m.model AND s.label = l.label AND s.prediction = p.prediction
GROUP BY m.model, l.label, p.prediction"""
    sql["store_targeting"] = sql["high_risk_targeting"]
    sql["store_calibration"] = sql["model_calibration"]
    sql["model_score_store"] = f"""
SELECT {AS_OF} AS score_date, count(*) AS n_users, count(*) AS n_scored FROM user_features"""

    models = "(VALUES ('logistic_regression'), ('random_forest'), ('gradient_boosting')) m(model)"
    sql["model_checks"] = f"""
SELECT m.model, split || '_' || name AS name, CAST(CASE name WHEN 'positives' THEN sum(churned) ELSE count(*) END AS BIGINT) AS n
FROM held_out, {models}, (VALUES ('rows'), ('positives'), ('bounded'), ('decided')) c(name)
GROUP BY m.model, split, name
UNION ALL SELECT m.model, 'test_reloaded', count(*) FROM held_out, {models} WHERE split = 'test' GROUP BY m.model
UNION ALL SELECT 'logistic_regression', 'test_attributed', count(*) FROM held_out WHERE split = 'test'
UNION ALL SELECT 'logistic_regression', 'gradient_vanishes', 1"""

    sql["rolling_volatility"] = f"""
SELECT date, {r('daily_return', 'daily_return')}, {r('v', 'raw_volatility')},
       {r('coalesce(v, avg(v) OVER ())', 'volatility')}
FROM (SELECT *, CASE WHEN count(*) OVER w = 7 THEN stddev_samp(daily_return) OVER w * sqrt(365) END AS v
      FROM returns WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""
    sql["price_index"] = f"""
SELECT date, {r('daily_return', 'daily_return')},
       {r('40000 * exp(sum(daily_return) OVER (ORDER BY date))', 'price')}
FROM returns"""
    sql["date_spine"] = f"""
SELECT CAST(day AS DATE) AS date, count(ts) AS n_rows
FROM (SELECT unnest(generate_series({AS_OF} - 89, {AS_OF}, INTERVAL 1 DAY)) AS day)
LEFT JOIN events ON CAST(ts AS DATE) = CAST(day AS DATE) GROUP BY 1"""

    sql["format_user_id"] = """
SELECT user_id, 'user_' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(6, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0')
  AS user_label FROM users"""
    sql["round_and_cast"] = f"""
SELECT user_id, {r('round_even(CAST(portfolio_value / 10 AS DECIMAL(18, 4)), 1)', 'rounded')},
       CAST(trunc(portfolio_value / 10) AS INTEGER) AS truncated
FROM users"""

    sql["csv_roundtrip"] = f"SELECT {FEATURE_ROWS} FROM user_features"
    sql["portfolio_return_daily"] = f"""
SELECT * FROM ({sql['portfolio_return_lag30']}) WHERE snapshot_date > {AS_OF} - 5"""
    sql["activity_windows_daily"] = f"""
SELECT d.day, t.user_id, count(*) AS trades_30d, {r('avg(t.trade_amount)', 'avg_trade_size')},
       {r("(count(*) FILTER (t.trade_date >= d.day - 14) - count(*) FILTER (t.trade_date BETWEEN d.day - 28 AND d.day - 14)) / nullif(CAST(count(*) FILTER (t.trade_date BETWEEN d.day - 28 AND d.day - 14) AS DOUBLE), 0)", 'trade_freq_trend')}
FROM (SELECT CAST(unnest(generate_series({AS_OF} - 19, {AS_OF}, INTERVAL 1 DAY)) AS DATE) AS day) d
JOIN trades t ON t.trade_date BETWEEN d.day - 30 AND d.day GROUP BY d.day, t.user_id"""
    sql["bucketed_targeting"] = sql["high_risk_targeting"]
    sql["bucketed_calibration"] = sql["model_calibration"]

    def column(name: str, kind: str, present: str, bad: str) -> str:
        return f"""
SELECT '{name}' AS column_name, '{kind}' AS type, count(*) FILTER ({present}) AS n_values,
       count(*) FILTER (NOT ({present})) AS n_null, count(*) FILTER ({bad}) AS n_bad FROM users"""

    many = "user_id % 60 = 2"
    sql["csv_inferred_types"] = " UNION ALL ".join(
        [
            column("user_id", "int", "true", "false"),
            column("segment", "string", "true", "false"),
            column("portfolio_value", "double", "true", "user_id % 50 = 1"),
            column("n_assets", "int", f"{many} OR user_id % 3 > 0", many),
            column("created", "date", "true", "user_id % 70 = 3"),
            column("churned", "boolean", "true", "false"),
            column("big", "bigint", "true", "false"),
        ]
    )
    sql["csv_quarantine"] = " UNION ALL ".join(
        f"SELECT CAST(user_id AS INTEGER) AS user_id, '{name}' AS column_name, '{cell}' AS cell FROM users WHERE {bad}"
        for name, cell, bad in (
            ("portfolio_value", "n/a", "user_id % 50 = 1"), ("n_assets", "many", many),
            ("created", "2023-13-45", "user_id % 70 = 3"),
        )
    )
    sql["csv_typed"] = f"""
SELECT CAST(user_id AS INTEGER) AS user_id, segment,
       {r('CASE WHEN user_id % 50 <> 1 THEN portfolio_value END', 'portfolio_value')},
       CASE WHEN user_id % 60 <> 2 AND user_id % 3 > 0 THEN n_assets END AS n_assets,
       CASE WHEN user_id % 70 <> 3 THEN account_created_date END AS created, status = 'churned' AS churned,
       user_id * 3000000000 AS big
FROM users"""
    sql["score_store_roundtrip"] = f"""
SELECT CAST(scored_at AS DATE) AS score_date, risk_tier, count(*) AS n_users,
       count(churn_probability) AS n_scored, {r('sum(churn_probability)', 'expected_churn')}
FROM recent_scores GROUP BY 1, 2"""
    return sql


def oracle_sql() -> dict[str, str]:
    """Complete statements, each with the views it needs."""
    complete = {}
    for name, body in statements().items():
        body = body.strip()
        if body.startswith("WITH "):
            views = with_views(body)
            head, inner = views.split("\nWITH ", 1) if "\nWITH " in views else ("", body[5:])
            complete[name] = f"{head}, {inner}" if head else body
        else:
            complete[name] = with_views(body)
    return complete
