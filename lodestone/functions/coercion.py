"""Turning literals of a request into values of a field's type, strictly and on the driver."""

from __future__ import annotations

import math
import struct
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

INTEGERS = {"byte": (-(2**7), 2**7 - 1), "short": (-(2**15), 2**15 - 1), "integer": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1), "unsigned_long": (0, 2**64 - 1)}
FLOATS = {"float": 3.4028234663852886e38, "double": 1.7976931348623157e308}
NUMERIC = {*INTEGERS, *FLOATS}
SPARK = {
    "bool": T.BooleanType(),
    "keyword": T.StringType(),
    "text": T.StringType(),
    "byte": T.ByteType(),
    "short": T.ShortType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "unsigned_long": T.DecimalType(20, 0),
    "float": T.FloatType(),
    "double": T.DoubleType(),
}
TRUE, FALSE = {"1", "t", "T", "TRUE", "true", "True"}, {"0", "f", "F", "FALSE", "false", "False"}


class _NoMatch:
    def __repr__(self) -> str:
        return "NO_MATCH"


#: What a literal becomes that has no value of the field's type: it matches nothing.
NO_MATCH = _NoMatch()


def scalar(value: object) -> bool:
    """Whether a value can be written as a string: what a query may look for."""
    return isinstance(value, (bool, int, float, str, Decimal))


def text_of(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def coerce(kind: str, value: object):
    if not scalar(value):
        return NO_MATCH
    if kind in ("keyword", "text"):
        return text_of(value)
    if kind == "bool":
        if isinstance(value, str):
            return True if value in TRUE else False if value in FALSE else NO_MATCH
        return bool(value)
    try:
        number = Decimal(int(value)) if isinstance(value, (bool, int)) else Decimal(str(value).strip() if isinstance(value, str) else repr(value) if isinstance(value, float) else value)
    except (InvalidOperation, ValueError):
        return NO_MATCH
    if not number.is_finite():
        return NO_MATCH
    if kind in INTEGERS:
        low, high = INTEGERS[kind]
        if number != number.to_integral_value() or not low <= number <= high:
            return NO_MATCH
        return Decimal(int(number)) if kind == "unsigned_long" else int(number)
    found = float(number)
    if math.isinf(found) or abs(found) > FLOATS[kind]:
        return NO_MATCH
    return struct.unpack("f", struct.pack("f", found))[0] if kind == "float" else found
