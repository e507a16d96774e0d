"""Declared schemas and the column contract of the public operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CATALOG = _schema(
    sku=T.StringType(),
    name=T.StringType(),
    brand=T.StringType(),
    category=T.StringType(),
    our_price=T.DoubleType(),
    cost=T.DoubleType(),
    stock=T.IntegerType(),
)

PRICES = _schema(
    sku=T.StringType(),
    competitor=T.StringType(),
    price=T.DoubleType(),
    in_stock=T.BooleanType(),
    date=T.DateType(),
)

LISTINGS = _schema(
    competitor=T.StringType(),
    listing_name=T.StringType(),
    price=T.DoubleType(),
    in_stock=T.BooleanType(),
    date=T.DateType(),
    true_sku=T.StringType(),
)

SALES = _schema(
    sku=T.StringType(),
    category=T.StringType(),
    gap=T.DoubleType(),
    units=T.DoubleType(),
    capped=T.BooleanType(),
)

ELASTICITY = _schema(category=T.StringType(), elasticity=T.DoubleType())

SUGGESTIONS = _schema(
    sku=T.StringType(),
    recommended_price=T.DoubleType(),
    confidence=T.DoubleType(),
    reasoning=T.StringType(),
)

RECOMMENDATIONS = _schema(
    sku=T.StringType(),
    current_price=T.DoubleType(),
    recommended_price=T.DoubleType(),
    confidence=T.DoubleType(),
    reasoning=T.StringType(),
    projected_margin_pct=T.DoubleType(),
    reversible=T.BooleanType(),
    guardrail_violation=T.StringType(),
    source=T.StringType(),
)

PENDING = _schema(
    run_id=T.StringType(),
    sku=T.StringType(),
    current_price=T.DoubleType(),
    recommended_price=T.DoubleType(),
    confidence=T.DoubleType(),
    guardrail_violation=T.StringType(),
    reasoning=T.StringType(),
    created_at=T.TimestampType(),
    status=T.StringType(),
)

DECISIONS = _schema(
    run_id=T.StringType(),
    sku=T.StringType(),
    approved=T.BooleanType(),
    decided_at=T.TimestampType(),
)

LOGGED_RECOMMENDATION = _schema(
    sku=T.StringType(),
    recommended_price=T.DoubleType(),
    source=T.StringType(),
    min_competitor_price=T.DoubleType(),
    max_competitor_price=T.DoubleType(),
    avg_competitor_trend_pct=T.DoubleType(),
)

EVENT_DATA = _schema(
    success=T.BooleanType(),
    latency_ms=T.DoubleType(),
    generate_attempts=T.LongType(),
    generate_successes=T.LongType(),
    recommendations=T.ArrayType(LOGGED_RECOMMENDATION),
)

#: What the log holds: batches of one event carry their number, which gives their order.
LOGGED_DATA = T.StructType([*EVENT_DATA.fields, T.StructField("batch", T.LongType())])

EVENTS = _schema(
    timestamp=T.TimestampType(),
    run_id=T.StringType(),
    agent=T.StringType(),
    event=T.StringType(),
    data=EVENT_DATA,
    latency_ms=T.DoubleType(),
)

CALLS = _schema(
    run_id=T.StringType(),
    seq=T.LongType(),
    request_key=T.StringType(),
    model=T.StringType(),
    model_rank=T.IntegerType(),
    attempt=T.IntegerType(),
    ok=T.BooleanType(),
    tokens_in=T.LongType(),
    tokens_out=T.LongType(),
    latency_ms=T.LongType(),
)

REQUESTS = _schema(run_id=T.StringType(), seq=T.LongType(), request_key=T.StringType())

STRATEGY_DAYS = _schema(
    strategy=T.StringType(),
    sku=T.StringType(),
    day=T.DateType(),
    price=T.DoubleType(),
    start_price=T.DoubleType(),
    cost=T.DoubleType(),
    units=T.DoubleType(),
)

VIOLATIONS = ("none", "below_min_margin", "exceeds_max_price_change", "low_stock_blocks_raise")
OUTCOMES = ("auto_approved", "human_approved", "human_rejected", "timed_out", "queued_for_review")
QUEUE_STATES = ("pending", "approved", "rejected")


class ContractError(ValueError):
    """A frame does not have the columns or types that an operator declares."""


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _fits(declared: T.DataType, found: T.DataType) -> bool:
    if isinstance(declared, _WHOLE):
        return isinstance(found, _WHOLE)
    return isinstance(found, type(declared))


def differences(declared: T.DataType, found: T.DataType, path: str = "") -> list[tuple[str, str, str]]:
    """(path, declared type, found type or `missing`) of every place where a schema breaks its declaration.

    Goes down into structs, arrays (`path[]`) and map values (`path{}`). Additional columns are allowed.
    """
    if isinstance(declared, T.StructType) and isinstance(found, T.StructType):
        by_name = {f.name: f.dataType for f in found.fields}
        wrong = []
        for field in declared.fields:
            place = f"{path}.{field.name}" if path else field.name
            if field.name not in by_name:
                wrong.append((place, field.dataType.simpleString(), "missing"))
            else:
                wrong += differences(field.dataType, by_name[field.name], place)
        return wrong
    if isinstance(declared, T.ArrayType) and isinstance(found, T.ArrayType):
        return differences(declared.elementType, found.elementType, f"{path}[]")
    if isinstance(declared, T.MapType) and isinstance(found, T.MapType):
        keys = differences(declared.keyType, found.keyType, f"{path}{{key}}")
        return keys + differences(declared.valueType, found.valueType, f"{path}{{}}")
    if _fits(declared, found):
        return []
    return [(path, declared.simpleString(), found.simpleString())]


def _mismatches(declared: T.StructType, found: T.StructType, optional) -> list[str]:
    return [
        f"{path}: missing" if there == "missing" else f"{path}: expected {wanted}, found {there}"
        for path, wanted, there in differences(declared, found)
        if not (there == "missing" and path in optional)
    ]


def require(df: DataFrame, declared: T.StructType, what: str, optional=()) -> DataFrame:
    """Return `df` unchanged, or raise when a declared column is missing or mistyped.

    Reads the schema only; no job runs.
    """
    wrong = _mismatches(declared, df.schema, optional)
    if wrong:
        raise ContractError(f"{what}: " + "; ".join(wrong))
    return df
