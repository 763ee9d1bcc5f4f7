"""JSON payloads as VARIANT: typed, nested, one schema for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, NullType, StructType, VariantType

from kredo.functions.payload import FIELD_GROUPS

MAX_SCHEMA = 1 << 20     # characters of a schema that is to become columns


def parsed(payload: Column | str) -> Column:
    """JSON text as VARIANT, NULL unless it is an object.  Numbers, flags, texts,
    lists and nested objects keep their types; NaN is no JSON."""
    v = F.try_parse_json(F.col(payload) if isinstance(payload, str) else payload)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _ddl(kind: DataType) -> str:
    """A type as Spark reads it; values of several types are text, as are fields that
    were never anything but null."""
    if isinstance(kind, (VariantType, NullType)):
        return "STRING"
    if isinstance(kind, StructType):
        quoted = [f"`{f.name.replace('`', '``')}`: {_ddl(f.dataType)}" for f in kind.fields]
        return f"STRUCT<{', '.join(quoted)}>" if quoted else "STRING"
    if isinstance(kind, ArrayType):
        return f"ARRAY<{_ddl(kind.elementType)}>"
    return "DOUBLE" if isinstance(kind, DecimalType) else kind.simpleString().upper()


def object_schema(df: DataFrame, payload: str = "input_data", max_length: int = MAX_SCHEMA) -> str:
    """The schema of all objects of a column, found in one pass: ``STRUCT<...>`` with
    nested objects, DOUBLE for fractions, STRING where rows differ.  Free keys make no
    schema: one longer than ``max_length`` raises."""
    found = df.select(parsed(payload).alias("v")).where("v IS NOT NULL").agg(F.schema_of_variant_agg("v").alias("s"))
    found = found.select(F.length("s").alias("n"), F.left("s", F.lit(max_length)).alias("s")).first()
    if found["n"] is not None and found["n"] > max_length:
        raise ValueError(f"the payloads' schema takes {found['n']} characters; name the fields to read")
    if not (found["s"] or "").startswith("OBJECT<") or found["s"] == "OBJECT<>":
        return "STRUCT<>"
    return _ddl(DataType.fromDDL(found["s"].replace("OBJECT<", "STRUCT<")))


def variant_frame(df: DataFrame, payload: str = "input_data", keep: list[str] | tuple = (),
                  schema: str | None = None) -> DataFrame:
    """One typed column for each field of the payloads, nested objects as structs
    (``payload.flatten`` makes them dotted columns, N3).  Rows whose payload is no object
    or has no field are dropped.  With a ``schema`` no pass is needed to find one;
    what doesn't fit a field's type there is NULL.  A field with the name of a kept column
    gets the payload's name before its own."""
    schema = object_schema(df, payload) if schema is None else schema
    if schema == "STRUCT<>":
        return df.select(*keep).limit(0)
    fields = DataType.fromDDL(schema).fields
    v = df.select(*keep, parsed(payload).alias("_v")).where("_v IS NOT NULL").where(
        F.size(F.try_variant_get("_v", "$", "map<string,variant>")) > 0)

    def value(name: str, kind: DataType) -> Column:
        # field by field, so that one that doesn't fit leaves the others as they are
        return F.try_variant_get("_v", _path(name), _ddl(kind)).alias(f"{payload}_{name}" if name in keep else name)

    return v.select(*keep, *[value(f.name, f.dataType) for f in fields])


def _path(name: str) -> str:
    quote = '"' if "'" in name else "'"
    return f"$[{quote}{name}{quote}]"


def field_groups(df: DataFrame, payload: str = "input_data", groups: dict[str, list[str]] | None = None) -> DataFrame:
    """One map column for each group, from the group's keys that are present to
    their values (VARIANT, nested ones too); NULL where the payload is no object."""
    entries = F.try_variant_get(parsed(payload), "$", "map<string,variant>")
    groups = FIELD_GROUPS if groups is None else groups
    out = df.withColumn("_entries", entries)
    return out.withColumns({name: _present(keys) for name, keys in groups.items()}).drop("_entries")


def _present(keys: list[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in keys])
    return F.map_filter("_entries", lambda k, _: F.array_contains(wanted, k))


def client_id(v: Column) -> Column:
    """SK_ID_CURR, else client_id, as number or text; a 0 falls through like a
    missing one, and 100001.0 is 100001."""
    def whole(key: str) -> Column:
        return F.try_variant_get(v, f"$.{key}", "string").try_cast("decimal(38,6)").try_cast("long")
    return F.coalesce(F.nullif(whole("SK_ID_CURR"), F.lit(0).cast("long")), whole("client_id"))


def json_text(v: Column) -> Column:
    """A VARIANT as JSON text, nulls kept, keys in order."""
    return F.to_json(v)
