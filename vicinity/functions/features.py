"""The 14 features as Spark expressions with float32 arithmetic, and their quantisation.

Spark divides floats as doubles, so every quotient is cast back; otherwise values that lie half-way flip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_RISK, MAX_KNOWN, NormConfig

#: What stands for a missing last transaction; it takes part in distances.
SENTINEL = -1.0
SCALE = 10000.0


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, f32(1.0)), f32(0.0))


def scaled(x: Column, inverse: float) -> Column:
    """clamp(x * inverse); a missing x counts as 0."""
    return clamp(F.coalesce(f32(x), f32(0.0)) * f32(inverse))


def ratio(amount: Column, average: Column, inverse: float) -> Column:
    """amount / average, an average that isn't positive counting as 1."""
    avg = F.when(f32(average) > f32(0.0), f32(average)).otherwise(f32(1.0))
    return clamp(f32(F.coalesce(f32(amount), f32(0.0)) / avg) * f32(inverse))


def hour_of_day(ts: Column) -> Column:
    return f32(F.hour(ts)) * f32(f32(1.0) / f32(23.0))


def day_of_week(ts: Column) -> Column:
    """Monday 0."""
    return f32(F.weekday(ts)) * f32(f32(1.0) / f32(6.0))


def minutes_since(ts: Column, last: Column, inverse: float) -> Column:
    minutes = f32(f32(F.unix_timestamp(ts) - F.unix_timestamp(last)) / f32(60.0))
    return F.when(last.isNull(), f32(SENTINEL)).otherwise(clamp(minutes * f32(inverse)))


def km_from_last(km: Column, last: Column, inverse: float) -> Column:
    return F.when(last.isNull(), f32(SENTINEL)).otherwise(scaled(km, inverse))


def flag(x: Column) -> Column:
    return f32(F.coalesce(x, F.lit(False)).cast("int"))


def unknown_merchant(known: Column, merchant: Column) -> Column:
    """0 if the merchant is among the first MAX_KNOWN known ones, else 1.

    exists() also keeps the projection out of whole-stage code, where 14 features make one method that is too long for the
    JVM to compile."""
    known = F.exists(F.slice(known, 1, MAX_KNOWN), lambda x: x == merchant)
    return F.when(F.coalesce(known, F.lit(False)), f32(0.0)).otherwise(f32(1.0))


def risk(mcc: Column, risks: dict[str, float]) -> Column:
    if not risks:
        return f32(DEFAULT_RISK)
    table = F.create_map(*[x for k, v in risks.items() for x in (F.lit(k), f32(v))])
    return F.coalesce(F.try_element_at(table, mcc), f32(DEFAULT_RISK))


def quantise_f32(x: Column) -> Column:
    """round(x * 10000) of a float32 feature, half away from zero, within the scale."""
    return F.round(F.greatest(F.least(x.cast("double") * SCALE, F.lit(SCALE)), F.lit(-SCALE)), 0).cast("int")


def quantise(vector: Column) -> Column:
    """Each double clipped to [-1, 1] and scaled to whole numbers, half away from zero."""
    return F.transform(vector, lambda x: F.round(F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * SCALE, 0).cast("int"))


def parse_time(text: Column) -> Column:
    """The first 19 characters as a time; zone and fraction don't count."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def feature_vector(c: dict[str, Column], config: NormConfig) -> Column:
    """Quantised array of the 14 features. c: amount, installments, avg_amount, at, last_at, km_from_last,
    km_from_home, tx_count_24h, is_online, card_present, known_merchants, merchant_id, mcc, merchant_avg."""
    inv = config.inverse
    dims = [
        scaled(c["amount"], inv("max_amount")),
        scaled(c["installments"], inv("max_installments")),
        ratio(c["amount"], c["avg_amount"], inv("amount_vs_avg_ratio")),
        hour_of_day(c["at"]),
        day_of_week(c["at"]),
        minutes_since(c["at"], c["last_at"], inv("max_minutes")),
        km_from_last(c["km_from_last"], c["last_at"], inv("max_km")),
        scaled(c["km_from_home"], inv("max_km")),
        scaled(c["tx_count_24h"], inv("max_tx_count_24h")),
        flag(c["is_online"]),
        flag(c["card_present"]),
        unknown_merchant(c["known_merchants"], c["merchant_id"]),
        risk(c["mcc"], config.risk),
        scaled(c["merchant_avg"], inv("max_merchant_avg_amount")),
    ]
    return F.array(*map(quantise_f32, dims))


def vectorise(requests: DataFrame, config: NormConfig | None = None) -> DataFrame:
    """id, rejected and v of transactions in the fixed schema; v is null where the request is rejected."""
    c = F.col
    valid = c("transaction.requested_at").isNotNull() & c("merchant.id").isNotNull()
    # columns of their own, else each feature that needs a time would parse it anew
    times = (parse_time(c("transaction.requested_at")).alias("_at"), parse_time(c("last_transaction.timestamp")).alias("_last"))
    rows, at, last = requests.select("*", (~valid).alias("rejected"), *times), c("_at"), c("_last")
    columns = {
        "amount": c("transaction.amount"), "installments": c("transaction.installments"), "avg_amount": c("customer.avg_amount"),
        "at": at, "last_at": last, "km_from_last": c("last_transaction.km_from_current"), "km_from_home": c("terminal.km_from_home"),
        "tx_count_24h": c("customer.tx_count_24h"), "is_online": c("terminal.is_online"), "card_present": c("terminal.card_present"),
        "known_merchants": c("customer.known_merchants"), "merchant_id": c("merchant.id"), "mcc": c("merchant.mcc"), "merchant_avg": c("merchant.avg_amount"),
    }
    return rows.select(*requests.columns, "rejected", F.when(~c("rejected"), feature_vector(columns, config or NormConfig())).alias("v"))
