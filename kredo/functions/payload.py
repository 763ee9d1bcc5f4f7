"""JSON payload helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def parse_object(payload: Column | str) -> Column:
    """JSON text -> map<string,string>; bad JSON, non-objects and blanks
    give NULL (``from_json`` in PERMISSIVE mode)."""
    c = F.col(payload) if isinstance(payload, str) else payload
    return F.from_json(F.when(F.trim(c) != "", c), "map<string,string>")


MAX_KEYS = 10_000
_BAD = "_malformed"


def payload_keys(df: DataFrame, payload: str = "input_data", max_keys: int = MAX_KEYS) -> list[str]:
    """Distinct top-level keys, to become columns.  Keys are free text: more than
    ``max_keys`` of them are no schema, and that raises."""
    keys = (df.select(F.explode(F.map_keys(parse_object(payload))).alias("k"))
            .distinct().orderBy("k").limit(max_keys + 1))
    found = [r.k for r in keys.collect()]
    if len(found) > max_keys:
        raise ValueError(f"more than {max_keys} different payload keys; name the fields to read")
    return found


def payload_frame(df: DataFrame, payload: str = "input_data", fields: list[str] | None = None,
                  keep: list[str] | tuple = ()) -> DataFrame:
    """One column per payload key (text values; rows whose payload is not
    an object, or an empty one, are dropped)."""
    fields = payload_keys(df, payload) if fields is None else fields
    # the fields as a struct: the parser builds no map, and nothing else of the payload;
    # through a generator, so that a filter is not pushed below it with a second parse
    schema = StructType([*[StructField(f, StringType()) for f in fields], StructField(_BAD, StringType())])
    text = F.col(payload)
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rows = df.where(text.rlike(r'^\s*\{\s*"')).select(*[F.col(c).alias(f"_kept_{c}") for c in keep], F.inline(F.array(parsed)))
    return rows.where(F.col(_BAD).isNull()).select(*[F.col(f"_kept_{c}").alias(c) for c in keep], *[F.col(f"`{f}`") for f in fields])


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> dotted top-level columns (schema walk only)."""
    cols = []

    def walk(prefix: list[str], st: StructType):
        for f in st.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, StructType):
                walk(path, f.dataType)
            else:
                cols.append(F.col(".".join("`" + p.replace("`", "``") + "`" for p in path)).alias(sep.join(path)))
    walk([], df.schema)
    return df.select(*cols)


def to_json_text(*cols: str) -> Column:
    """Columns -> JSON text, NULL kept as null (NaN made NULL first)."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


# The payload field groups shown for one logged request.
FIELD_GROUPS = {
    "personal": ["CODE_GENDER", "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "NAME_EDUCATION_TYPE",
                 "OCCUPATION_TYPE"],
    "financial": ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE"],
    "work": ["DAYS_EMPLOYED", "DAYS_BIRTH", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "FLAG_OWN_CAR",
             "FLAG_OWN_REALTY"],
    "external": ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "NAME_CONTRACT_TYPE"],
}


def field_groups(df: DataFrame, payload: str = "input_data",
                 groups: dict[str, list[str]] | None = None) -> DataFrame:
    """One map column per group with the payload keys of that group
    that are present (absent keys are left out, like the reference)."""
    m = parse_object(payload)
    groups = FIELD_GROUPS if groups is None else groups
    cols = {}
    for name, keys in groups.items():
        wanted = F.array(*[F.lit(k) for k in keys])
        cols[name] = F.map_filter(m, lambda k, v: F.array_contains(wanted, k))
    return df.withColumns(cols)


def client_id(payload_map: Column) -> Column:
    """SK_ID_CURR, else client_id; a 0 id falls through like a missing one.
    ``100001.0``, as a nullable integer column is written, is 100001."""
    def whole(key):
        return payload_map[key].try_cast("decimal(38,6)").try_cast("long")
    return F.coalesce(F.nullif(whole("SK_ID_CURR"), F.lit(0).cast("long")), whole("client_id"))
