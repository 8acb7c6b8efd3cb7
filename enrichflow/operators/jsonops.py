"""JSON columns: encode, decode, strict metric extraction, schema profile."""
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from enrichflow.sources.scratch import written


def strict_path_bigint(payload: Column, path: tuple[str, ...]) -> Column:
    """Non-negative integer at a JSON path; a missing path, boolean, fraction or text gives NULL."""
    shape: T.DataType = T.LongType()
    for name in reversed(path):
        shape = T.StructType([T.StructField(name, shape)])
    value = F.from_json(payload, shape)
    for name in path:
        value = value[name]
    return F.when(value >= 0, value)


def finite(value: Column, kind: T.DataType) -> Column:
    """Same value with NaN and infinities replaced by NULL at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        limit = F.lit(float("inf")).cast(kind)
        return F.when(~F.isnan(value) & (F.abs(value) < limit), value)
    if isinstance(kind, T.ArrayType) and _has_reals(kind):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType) and _has_reals(kind.valueType):
        return F.transform_values(value, lambda _, x: finite(x, kind.valueType))
    if isinstance(kind, T.StructType) and _has_reals(kind):
        inner = F.struct(*(finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), inner)
    return value


def _has_reals(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_reals(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_reals(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_reals(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def encode_json(df: DataFrame, column: str, into: str = "json_str") -> DataFrame:
    """JSON text of any column; nulls are written and non-finite numbers become null."""
    kind = df.schema[column].dataType
    value = finite(F.col(column), kind)
    options = {"ignoreNullFields": "false"}
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(value, options)
    else:
        listed = F.to_json(F.array(value), options)
        text = F.substring(listed, F.lit(2), F.length(listed) - 2)
    return df.withColumn(into, F.coalesce(text, F.lit("null")))


def decode_json(df: DataFrame, column: str, into: str = "value") -> DataFrame:
    """VARIANT value of a JSON text, plus ``malformed`` for text that is not JSON."""
    parsed = df.withColumn(into, F.try_parse_json(column))
    return parsed.withColumn("malformed", F.col(into).isNull() & F.col(column).isNotNull())


def _scalar_type(kind: Column) -> Column:
    return (
        F.when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(kind == "STRING", "string")
        .otherwise("any")
    )


def _quoted(key: Column) -> Column:
    listed = F.to_json(F.array(key))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _type(kind: Column) -> Column:
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(_scalar_type(kind))


def _inside(values: DataFrame, *keep: str) -> DataFrame:
    """The members of objects and items of arrays in ``_v``, with their paths below ``path``; an empty container has none."""
    spark = values.sparkSession
    entries = values.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*keep, "path", "key", F.col("value").alias("_v"))
    key = F.when(F.col("key").rlike("^[A-Za-z0-9_]+$"), F.col("key")).otherwise(_quoted(F.col("key")))
    path = F.concat("path", F.when(F.col("key").isNotNull(), F.concat(F.lit("."), key)).otherwise("[]"))
    return entries.select(*keep, path.alias("path"), "_v", F.schema_of_variant("_v").alias("_kind"))


def json_profile(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """(path, type, n) over a JSON column: how many values below the whole (``$``) have this type at this path or inside it.

    Several types at one path stand for a union; an empty array has string items. Keys that are no plain words are
    quoted, so ``"c.d"`` and ``c`` with ``d`` inside differ. A value that has a type at a path several times counts once. Nested
    containers are opened level by level; the levels are few, and each reads only the containers left by the one before.
    """
    parsed = df.select(*groups, F.try_parse_json(column).alias("_v"), F.lit("$").alias("path")).filter(F.col("_v").isNotNull())
    whole = F.schema_of_variant("_v")
    roots = parsed.select(*groups, "path", _type(whole).alias("type")).groupBy(*groups, "path", "type").agg(F.count("*").alias("n"))
    nested = F.col("_kind").rlike("^(OBJECT|ARRAY)")
    first = _inside(parsed, *groups)
    bare = parsed.filter(F.schema_of_variant("_v") == "ARRAY<VOID>").select(*groups, F.lit("$[]").alias("path"), F.lit("string").alias("type"))
    bare = bare.groupBy(*groups, "path", "type").agg(F.count("*").alias("n"))
    plain = first.filter(~nested).groupBy(*groups, "path", _type(F.col("_kind")).alias("type")).agg(F.count("*").alias("n"))
    keep = (*groups, "_value")
    level, found = written(first.filter(nested).withColumn("_value", F.monotonically_increasing_id())), []
    while not level.isEmpty():
        found.append(level.select(*keep, "path", _type(F.col("_kind")).alias("type")))
        empty = level.filter(F.col("_kind") == "ARRAY<VOID>")
        found.append(empty.select(*keep, F.concat("path", F.lit("[]")).alias("path"), F.lit("string").alias("type")))
        below = written(_inside(level, *keep))
        found.append(below.filter(~nested).select(*keep, "path", _type(F.col("_kind")).alias("type")))
        level = below.filter(nested)
    out = roots.unionByName(plain).unionByName(bare)
    if found:
        once_each = reduce(DataFrame.unionByName, found).groupBy(*keep, "path", "type").agg(F.lit(1).alias("_one"))
        out = out.unionByName(once_each.groupBy(*groups, "path", "type").agg(F.count("*").alias("n")))
    return out.groupBy(*groups, "path", "type").agg(F.sum("n").alias("n"))
