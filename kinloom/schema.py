"""The person relation: schema, discovery of optional columns, column mapping, validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERSON = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("uuid", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("middle_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("birthdate", T.DateType()),
        T.StructField("hh_id", T.StringType()),
    ]
)
NAMES = PERSON.fieldNames()


class SchemaError(ValueError):
    """A table lacks a column that the chosen role needs, or a name isn't an identifier."""


def validate_ident(name: str) -> str:
    """name, if it consists of ASCII letters, digits and underscores."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name or ""):
        raise SchemaError(f"not an identifier: {name!r}")
    return name


@dataclass(frozen=True)
class ColumnMapping:
    """Source column of each canonical one; None where the source has none (uuid, middle_name and hh_id only)."""

    id: str = "id"
    uuid: str | None = "uuid"
    first_name: str = "first_name"
    middle_name: str | None = "middle_name"
    last_name: str = "last_name"
    birthdate: str = "birthdate"
    hh_id: str | None = "hh_id"

    def __post_init__(self) -> None:
        for f in fields(self):
            name = getattr(self, f.name)
            if name is not None:
                validate_ident(name)
            elif f.name not in ("uuid", "middle_name", "hh_id"):
                raise SchemaError(f"{f.name} has to be mapped")


@dataclass(frozen=True)
class TableColumns:
    """Which canonical columns a table has."""

    present: frozenset[str]

    @classmethod
    def of(cls, df: DataFrame, mapping: ColumnMapping | None = None) -> TableColumns:
        have, m = set(map(str.lower, df.columns)), mapping or ColumnMapping()
        return cls(frozenset(n for n in NAMES if (getattr(m, n) or "").lower() in have))

    def missing(self, role: int) -> list[str]:
        """Required columns that are absent; table 1 also needs uuid."""
        need = ["id", "first_name", "last_name", "birthdate"] + (["uuid"] if role == 1 else [])
        return [n for n in need if n not in self.present]

    def validate(self, role: int) -> None:
        if gone := self.missing(role):
            raise SchemaError(f"table {role} lacks {', '.join(gone)}")


def select_list(columns: list[str], mapping: ColumnMapping | None = None) -> list[Column]:
    """The canonical projection: renamed, cast, and NULL for what the source lacks; upper and lower case of names don't differ."""
    m, out, have = mapping or ColumnMapping(), [], {c.lower(): c for c in reversed(columns)}
    for field in PERSON.fields:
        source = have.get((getattr(m, field.name) or "").lower())
        if source is not None:
            c = F.to_date(F.col(source)) if field.name == "birthdate" else F.col(source).cast(field.dataType)
        else:
            c = F.lit(None).cast(field.dataType)
        out.append(c.alias(field.name))
    return out


def to_persons(df: DataFrame, mapping: ColumnMapping | None = None, role: int | None = None) -> DataFrame:
    """df as the person relation; role 1 or 2 checks the columns that the table's role needs."""
    if role is not None:
        TableColumns.of(df, mapping).validate(role)
    return df.select(*select_list(df.columns, mapping))
