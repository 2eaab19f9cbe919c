"""Schemas of requests, reference vectors, answers and evaluation entries."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

REQUEST = _struct(
    id=S,
    transaction=_struct(amount=D, installments=I, requested_at=S),
    customer=_struct(avg_amount=D, tx_count_24h=I, known_merchants=T.ArrayType(S)),
    merchant=_struct(id=S, mcc=S, avg_amount=D),
    terminal=_struct(is_online=B, card_present=B, km_from_home=D),
    last_transaction=_struct(timestamp=S, km_from_current=D),
)
REFERENCE = _struct(vector=T.ArrayType(D), is_fraud=B, fraud=B, label=S)
RESPONSE = _struct(approved=B, fraud_score=D)
ENTRY = _struct(request=REQUEST, expected_approved=B)
