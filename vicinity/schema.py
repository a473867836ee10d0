"""Fixed schemas; nothing is inferred."""

from __future__ import annotations

import re

DIMS = 14

TRANSACTION = """
id STRING,
transaction STRUCT<amount: DOUBLE, installments: INT, requested_at: STRING>,
customer STRUCT<avg_amount: DOUBLE, tx_count_24h: INT, known_merchants: ARRAY<STRING>>,
merchant STRUCT<id: STRING, mcc: STRING, avg_amount: DOUBLE>,
terminal STRUCT<is_online: BOOLEAN, card_present: BOOLEAN, km_from_home: DOUBLE>,
last_transaction STRUCT<timestamp: STRING, km_from_current: DOUBLE>
"""
REFERENCE = "vector ARRAY<DOUBLE>, label STRING"
EVALUATION = (
    "entries ARRAY<STRUCT<request: STRUCT<"
    + re.sub(r"(?m)^(\w+) ", r"\1: ", TRANSACTION).strip()
    + ">, expected_approved: BOOLEAN>>"
)
STATS = "stats STRUCT<total: BIGINT, fraud_count: BIGINT, legit_count: BIGINT, fraud_rate: DOUBLE, legit_rate: DOUBLE, edge_case_count: BIGINT, edge_case_rate: DOUBLE>"
POSTINGS = "cluster_id INT, ref_id BIGINT, v ARRAY<INT>, is_fraud INT, dist_centroid DOUBLE"
CENTROIDS = "cluster_id INT, qc ARRAY<INT>, mn ARRAY<INT>, mx ARRAY<INT>, cnt BIGINT"
