"""Reading a plain value as the type of the column that it is compared with."""

from __future__ import annotations

import math
import uuid
from datetime import date, datetime, timezone
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import QueryError

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _moment(value, zoned: bool) -> datetime:
    if isinstance(value, datetime):
        found = value
    elif isinstance(value, date):
        found = datetime(value.year, value.month, value.day)
    else:
        try:
            found = datetime.fromisoformat(str(value).strip())
        except ValueError:
            raise QueryError(f"{value!r} is no timestamp") from None
    if found.tzinfo:
        found = found.astimezone(timezone.utc)
        return found if zoned else found.replace(tzinfo=None)
    return found.replace(tzinfo=timezone.utc) if zoned else found


def coerce(value, kind: T.DataType | None):
    """The value as a Python value of the type; QueryError if it can't be read so. None stays None.

    Text is read as the column's type; a whole-number column compared with a fraction keeps the exact
    decimal; a text column compared with a number takes the number's text; NaN and infinities are refused.
    """
    if value is None or kind is None:
        return value
    if isinstance(value, float) and not math.isfinite(value):
        raise QueryError("NaN and infinities are no filter values")
    try:
        if isinstance(kind, T.BooleanType):
            if isinstance(value, bool):
                return value
            if str(value).lower() in ("true", "t", "1", "false", "f", "0"):
                return str(value).lower() in ("true", "t", "1")
            raise QueryError(f"{value!r} is no boolean")
        if isinstance(kind, WHOLE):
            number = Decimal(str(value)) if not isinstance(value, bool) else Decimal(int(value))
            return int(number) if number == number.to_integral_value() else number
        if isinstance(kind, T.DecimalType):
            return Decimal(str(value))
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value)
        if isinstance(kind, T.DateType):
            return value if isinstance(value, date) and not isinstance(value, datetime) else _moment(value, False).date()
        if isinstance(kind, T.TimestampNTZType):
            return _moment(value, False)
        if isinstance(kind, T.TimestampType):
            return _moment(value, True)
        if isinstance(kind, T.StringType):
            if isinstance(value, bool):
                return "true" if value else "false"
            return str(value).lower() if isinstance(value, uuid.UUID) else str(value)
    except (InvalidOperation, ValueError) as e:
        if isinstance(e, QueryError):
            raise
        raise QueryError(f"{value!r} can't be read as {kind.simpleString()}") from None
    return value


def literal(value, kind: T.DataType | None) -> Column:
    """The value as a typed literal."""
    if isinstance(value, Column):
        return value
    value = coerce(value, kind)
    if value is None:
        return F.lit(None).cast(kind) if kind is not None else F.lit(None)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(int(value.timestamp() * 1_000_000)))
    if isinstance(kind, WHOLE) and isinstance(value, Decimal):
        return F.lit(value)
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value) if kind is None or isinstance(kind, T.StringType) else F.lit(value).cast(kind)
