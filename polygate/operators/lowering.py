"""Results in the five classes that wire clients know: integer, real, text, blob and null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polygate.dialect import quote


def lower(df: DataFrame) -> DataFrame:
    """A last projection, from the schema alone: booleans and integers to bigint, decimals to double, dates to text."""
    out = []
    for f in df.schema:
        c = F.col(quote(f.name))
        if isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string")
        elif not isinstance(f.dataType, (T.LongType, T.DoubleType, T.StringType, T.BinaryType)):
            c = F.to_json(F.struct(c)) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
        out.append(c.alias(f.name))
    if len(set(df.columns)) < len(df.columns):  # by position where names repeat
        return lower(df.toDF(*[f"__{i}" for i in range(len(df.columns))])).toDF(*df.columns)
    return df.select(*out)


def wire_class(t: T.DataType) -> str:
    """INTEGER, REAL, TEXT or BLOB."""
    if isinstance(t, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INTEGER"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "REAL"
    return "BLOB" if isinstance(t, T.BinaryType) else "TEXT"
