"""Records at the edges of the engine: account fields, key cases, packed signatures, JSON and status lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.names import TECHNOLOGIES, plain_slug

#: The name to show for a technology's slug; of names with one slug the last.
DISPLAY_NAMES = {plain_slug(name): name for name in TECHNOLOGIES}


def account_email(email: Column) -> Column:
    """The address an account is known by: in lower case."""
    return F.lower(email)


def account_name(name: Column) -> Column:
    """A name without blanks around it."""
    return F.regexp_replace(name, r"^\s+|\s+$", "")


def display_name(slugged: Column, name: Column) -> Column:
    """How a technology is written; any other entity keeps its name."""
    pairs = [F.lit(x) for item in DISPLAY_NAMES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), slugged), name)


def camel(key: str) -> str:
    return re.sub("_([a-z])", lambda m: m[1].upper(), key)


def snake(key: str) -> str:
    return re.sub("[A-Z]", lambda m: f"_{m[0].lower()}", key)


def _renamed(kind: T.DataType, rename) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(rename(f.name), _renamed(f.dataType, rename), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_renamed(kind.elementType, rename), kind.containsNull)
    return kind


def rename_keys(df: DataFrame, rename=camel) -> DataFrame:
    """Columns, and the fields of structs in them at any depth, renamed by ``camel`` or ``snake``; the keys of maps stay."""
    return df.select(*[F.col(f"`{f.name}`").cast(_renamed(f.dataType, rename)).alias(rename(f.name)) for f in df.schema])


def pack_uint64(values: Column) -> Column:
    """Bytes of 64-bit numbers, big end first, side by side."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


def unpack_uint64(packed: Column) -> Column:
    """The numbers that ``pack_uint64`` packed, as signed ones; of odd bytes at the end there is none."""
    count = F.floor(F.octet_length(packed) / 8).cast("int")
    number = lambda i: F.conv(F.hex(F.substring(packed, i * 8 + 1, F.lit(8))), 16, -10).cast("bigint")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), number)).when(count == 0, F.array().cast("array<bigint>"))


def json_row(*columns: Column | str) -> Column:
    """A JSON object of columns, those that are null included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def status_lines(*columns: Column | str) -> Column:
    """A server-sent event with columns as its data."""
    return F.concat(F.lit("data: "), json_row(*columns), F.lit("\n\n"))
