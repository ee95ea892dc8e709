"""One folder of parquet parts written at different times, read with one merged schema.

Later writes may have more columns or wider types. The parts of one write share a schema and the write's id in
their names, so one part of each write is looked at, however many there are. Types are merged only
where no value can change; the engine's reader then widens every part to the merged type while it scans,
so filters and column selection still reach the files. Columns that a part lacks read null.
"""

import re
from functools import reduce

from pyspark.sql import types as T

_WRITE = re.compile(r"part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")
#: Digits that hold every value of an integer type.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_INTEGERS = list(_DIGITS)


def _decimal(kind):
    """(digits before the point, digits after) of integers and decimals, else None."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    return (_DIGITS[type(kind)], 0) if type(kind) in _DIGITS else None


def wider(a, b, name="value"):
    """The type that holds all values of both, exactly; a ValueError names a column that has none."""
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged(a, b, name + ".")
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType, name + "[]"))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(wider(a.keyType, b.keyType, name + " key"), wider(a.valueType, b.valueType, name + " value"))
    kinds = {type(a), type(b)}
    if kinds <= set(_INTEGERS):
        return max(a, b, key=lambda t: _INTEGERS.index(type(t)))
    small = {T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType}
    if kinds <= small and kinds & {T.FloatType, T.DoubleType}:
        return T.DoubleType()  # every integer of 32 bits and every float is a double
    if kinds == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    one, two = _decimal(a), _decimal(b)
    if one and two:
        before, after = max(one[0], two[0]), max(one[1], two[1])
        if before + after <= 38:
            return T.DecimalType(before + after, after)
    raise ValueError(f"no type holds both {a.simpleString()} and {b.simpleString()}: {name}")


def merged(one, two, prefix=""):
    """All columns of both schemas, those of ``one`` first, each with the wider type, all nullable."""
    later = {f.name: f for f in two}
    fields = [
        T.StructField(f.name, wider(f.dataType, later[f.name].dataType, prefix + f.name) if f.name in later else f.dataType)
        for f in one
    ]
    known = set(one.names)
    return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in two if f.name not in known])


def generations(spark, folder):
    """One part of each write in a folder, in the order of the parts' names; parts named otherwise stand for themselves."""
    parts = spark.read.schema("_none string").parquet(folder).inputFiles()
    found = {}
    for part in sorted(parts):
        match = _WRITE.search(part)
        found.setdefault(match.group(1) if match else part, part)
    return list(found.values())


def merged_schema(spark, folder, files=None):
    """The schema that holds all generations; equal schemas are merged once."""
    schemas = {}
    for part in files or generations(spark, folder):
        schema = spark.read.parquet(part).schema
        schemas.setdefault(schema.json(), schema)
    if not schemas:
        raise FileNotFoundError(f"no parquet parts in {folder}")
    return reduce(merged, schemas.values())


def read_generations(spark, folder):
    """All parts of a folder as one frame with the merged schema; partition columns come from the folder names."""
    return spark.read.schema(merged_schema(spark, folder)).parquet(folder)
