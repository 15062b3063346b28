"""Row schemas of the operational tables, documents and change events."""

from pyspark.sql import types as T

_STRING, _LONG, _TIME, _BOOL = T.StringType(), T.LongType(), T.TimestampType(), T.BooleanType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


MERCHANTS = _struct(("merchant_id", _LONG, False), ("name", _STRING, False), ("email", _STRING, True), ("country_code", _STRING, True), ("tier", _STRING, True), ("status", _STRING, True), ("created_at", _TIME, True), ("updated_at", _TIME, True))
CUSTOMERS = _struct(("customer_id", _LONG, False), ("email", _STRING, True), ("name", _STRING, True), ("country_code", _STRING, True), ("segment", _STRING, True), ("created_at", _TIME, True))
PAYMENT_METHODS = _struct(("pm_id", _LONG, False), ("customer_id", _LONG, False), ("type", _STRING, True), ("brand", _STRING, True), ("last4", _STRING, True), ("fingerprint", _STRING, True), ("is_default", _BOOL, False), ("expires_at", T.DateType(), True), ("created_at", _TIME, True))
TRANSACTIONS = _struct(("txn_id", _LONG, False), ("merchant_id", _LONG, False), ("customer_id", _LONG, True), ("pm_id", _LONG, True), ("amount", _LONG, False), ("currency", _STRING, False), ("status", _STRING, False), ("fraud_score", T.DecimalType(5, 4), True), ("idempotency_key", _STRING, True), ("device_type", _STRING, True), ("ip_country", _STRING, True), ("metadata", _STRING, True), ("created_at", _TIME, False), ("updated_at", _TIME, True))
REFUNDS = _struct(("refund_id", _LONG, False), ("txn_id", _LONG, False), ("amount", _LONG, False), ("reason", _STRING, True), ("status", _STRING, False), ("created_at", _TIME, False))
FRAUD_INDICATORS = _struct(("fraud_id", _LONG, False), ("txn_id", _LONG, False), ("anomaly_score", T.DecimalType(5, 4), False), ("rules_triggered", T.ArrayType(_STRING), True), ("model_version", _STRING, True), ("decision", _STRING, False), ("created_at", _TIME, False))
#: A change message: either the flattened row or an envelope around it.
CHANGE_ROW = _struct(("txn_id", _LONG, True), ("merchant_id", _LONG, True), ("customer_id", _LONG, True), ("pm_id", _LONG, True), ("amount", _LONG, True), ("currency", _STRING, True), ("status", _STRING, True), ("fraud_score", T.DoubleType(), True), ("device_type", _STRING, True), ("ip_country", _STRING, True), ("metadata", _STRING, True), ("created_at", _STRING, True), ("__deleted", _STRING, True))
TABLES = {"merchants": MERCHANTS, "customers": CUSTOMERS, "payment_methods": PAYMENT_METHODS, "transactions": TRANSACTIONS, "refunds": REFUNDS, "fraud_indicators": FRAUD_INDICATORS}
