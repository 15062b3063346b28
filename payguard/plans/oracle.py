"""SQL over the test tables with the same results as the plans, written for an independent engine."""

from __future__ import annotations

#: Country codes and currencies of the test views; fixed values.
_C = "['FR', 'US', 'GB', 'DE', 'ES', 'IT', 'NL', 'BE', 'CA', 'RU', 'NG', 'KP', 'IR', 'VE', 'BY', 'JP']"
_CUR = "['EUR', 'USD', 'GBP', 'JPY', 'CAD', 'AUD']"

_PARTS = {
    "merchants": f"""merchants AS (
  SELECT s_suppkey AS merchant_id, s_name AS name, {_C}[1 + s_nationkey % 16] AS country_code,
    CASE WHEN s_suppkey % 10 < 6 THEN 'standard' WHEN s_suppkey % 10 < 9 THEN 'premium' ELSE 'enterprise' END AS tier, 'active' AS status FROM supplier)""",
    "customers": f"""customers AS (
  SELECT c_custkey AS customer_id, 'c' || c_custkey || '@example.com' AS email, c_name AS name, {_C}[1 + c_nationkey % 16] AS country_code,
    CASE WHEN c_custkey % 20 < 3 THEN 'premium' WHEN c_custkey % 20 < 13 THEN 'standard' WHEN c_custkey % 20 < 18 THEN 'new' ELSE 'inactive' END AS segment FROM customer)""",
    "pms": """pms AS (
  SELECT pm_id, customer_id, type, CASE WHEN type = 'card' THEN ['visa', 'mastercard', 'amex', 'cb'][pm_id % 4 + 1] END AS brand,
    CASE WHEN type = 'card' THEN sha256(pm_id::VARCHAR) END AS fingerprint, CASE WHEN type = 'card' THEN lpad((pm_id % 10000)::VARCHAR, 4, '0') END AS last4
  FROM (SELECT c_custkey * 2 + k AS pm_id, c_custkey AS customer_id,
    CASE WHEN (c_custkey * 2 + k) % 20 < 17 THEN 'card' WHEN (c_custkey * 2 + k) % 20 < 19 THEN 'wallet' ELSE 'bank_transfer' END AS type
    FROM customer, (SELECT unnest([0, 1]) AS k)))""",
    "t": f"""t AS (
  SELECT event_id AS txn_id, event_id % (SELECT count(*) FROM supplier) AS merchant_id, CASE WHEN event_id % 97 <> 0 THEN user_id END AS customer_id, user_id * 2 + event_id % 2 AS pm_id,
    round(value * 100)::BIGINT * CASE WHEN event_id % 11 = 0 THEN 10 ELSE 1 END AS amount, {_CUR}[1 + event_id % 6] AS currency,
    CASE WHEN event_id % 10 = 3 THEN 'failed' ELSE 'succeeded' END AS status, 'key-' || event_id AS idempotency_key,
    CASE event_type WHEN 'purchase' THEN 'pos' WHEN 'view' THEN 'desktop' WHEN 'signup' THEN 'tablet' ELSE 'mobile' END AS device_type,
    {_C}[1 + k % 16] AS ip_country, ts AS created_at, epoch_us(ts) AS us, CASE WHEN event_id % 50 <> 7 THEN k >= 87 END AS is_fraud, event_id % 50 <> 7 AS labelled
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))""",
    "v": """v AS (
  SELECT *, count(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS velocity_1h,
    count(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS velocity_24h
  FROM t WHERE customer_id IS NOT NULL)""",
    "p": """p AS (
  SELECT *, CASE WHEN amount > 100000 THEN 'R1_high_amount' END AS r1, CASE WHEN amount > 0 AND amount < 200 AND device_type IN ('pos', 'mobile') THEN 'R2_card_testing' END AS r2,
    CASE WHEN ip_country IN ('RU', 'NG', 'KP', 'IR', 'VE', 'BY') THEN 'R3_high_risk_geo' END AS r3, CASE WHEN velocity_1h > 2 THEN 'R4_velocity_1h' END AS r4, CASE WHEN velocity_24h > 5 THEN 'R5_velocity_24h' END AS r5 FROM v)""",
    "sc": """sc AS (
  SELECT *, points / 10000.0 AS fraud_score, CASE WHEN points >= 8500 THEN 'block' WHEN points >= 6000 THEN 'review' ELSE 'allow' END AS decision, 'rule-based-v1' AS model_version,
    list_filter([r1, r2, r3, r4, r5], lambda x: x IS NOT NULL) AS rules_triggered
  FROM (SELECT *, least(10000, 1000 + (r1 IS NOT NULL)::INT * 3500 + (r2 IS NOT NULL)::INT * 1500 + (r3 IS NOT NULL)::INT * 4000 + (r4 IS NOT NULL)::INT * 2500 + (r5 IS NOT NULL)::INT * 1500)::BIGINT AS points FROM p))""",
    "fi": "fi AS (SELECT * FROM sc WHERE decision IN ('review', 'block'))",
    "d": "d AS (SELECT t.*, sc.fraud_score, sc.points, sc.decision, sc.model_version, sc.velocity_1h, sc.velocity_24h FROM t LEFT JOIN sc USING (txn_id))",
    "o": f"""o AS (
  SELECT o_orderkey AS txn_id, o_orderkey % (SELECT count(*) FROM supplier) AS merchant_id, o_custkey AS customer_id, o_custkey * 2 + o_orderkey % 2 AS pm_id, round(o_totalprice * 100)::BIGINT % 200000 AS amount,
    {_CUR}[1 + o_orderkey % 6] AS currency, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'succeeded' END AS status, {_C}[1 + o_orderkey % 16] AS ip_country, o_orderdate AS created_at FROM orders)""",
    "refunds": "refunds AS (SELECT txn_id AS refund_id, txn_id, amount // 2 AS amount, 'requested' AS reason, CASE WHEN txn_id % 50 = 0 THEN 'pending' ELSE 'succeeded' END AS status, created_at + INTERVAL 1 DAY AS created_at FROM t WHERE txn_id % 25 = 0)",
    "geo": """geo AS (SELECT * FROM (VALUES (1, 'FR', 'Europe', false), (2, 'US', 'Americas', false), (3, 'GB', 'Europe', false), (4, 'DE', 'Europe', false), (5, 'ES', 'Europe', false), (6, 'IT', 'Europe', false),
  (7, 'NL', 'Europe', false), (8, 'BE', 'Europe', false), (9, 'CA', 'Americas', false), (10, 'JP', 'Asia', false), (11, 'AU', 'Oceania', false), (12, 'BR', 'Americas', false), (13, 'RU', 'Europe/Asia', true),
  (14, 'NG', 'Africa', true), (15, 'KP', 'Asia', true), (16, 'IR', 'Asia', true), (17, 'VE', 'Americas', true)) AS g (geo_key, country_code, region, is_high_risk))""",
}
#: Velocity from strictly earlier rows, as in training.
_PARTS["x"] = """x AS (
  SELECT *, count(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS velocity_1h, count(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS velocity_24h
  FROM t WHERE customer_id IS NOT NULL)"""
_NEEDS = {"v": ["t"], "p": ["v"], "sc": ["p"], "fi": ["sc"], "d": ["t", "sc"], "refunds": ["t"], "x": ["t"]}


def with_tables(names: str, body: str) -> str:
    """`body` with the named common tables, and those that they need, before it."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in names.split():
        add(n)
    rest = body.strip()
    return "WITH " + ",\n".join(_PARTS[n] for n in wanted) + (",\n" + rest[5:] if rest.startswith("WITH ") else "\n" + rest)


def ratio(n: str, d: str, digits: int, factor: int = 1) -> str:
    """Half up, in whole numbers."""
    return f"((2 * ({n}) * {factor * 10**digits} + ({d})) // nullif(2 * ({d}), 0)) / {10**digits}.0"


def even(n: str, d: str, digits: int, factor: int = 1) -> str:
    """Half to even, in whole numbers."""
    x = f"(({n}) * {factor * 10**digits})"
    q, r = f"({x} // nullif(({d}), 0))", f"({x} % nullif(({d}), 0))"
    return f"({q} + (2 * {r} > ({d}) OR (2 * {r} = ({d}) AND {q} % 2 = 1))::INT) / {10**digits}.0"


def when(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
