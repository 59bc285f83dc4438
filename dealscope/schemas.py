"""Column lists and schemas shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns each source table must supply.
SOURCE_COLUMNS = {
    "objects": ("id", "entity_type", "parent_id", "category_code", "founded_at", "closed_at",
                "country_code", "state_code", "city", "region"),
    "funding_rounds": ("object_id", "raised_amount_usd", "participants"),
    "acquisitions": ("acquired_object_id", "acquiring_object_id", "acquired_at"),
    "ipos": ("object_id", "public_at"),
    "offices": ("object_id",),
    "relationships": ("person_object_id", "relationship_object_id"),
    "degrees": ("object_id", "degree_type"),
}

DATE_COLUMNS = ("founded_at", "closed_at", "acquired_at", "public_at")

# Degrees counted by name; every other degree counts as "other".
DEGREES = ("mba", "phd", "ms")
OTHER = "other"

# Columns of the companies, and of the joined table.
COMPANY_COLUMNS = ("company_id", "category_code", "founded_at", "closed_at", "country_code",
                   "state_code", "city", "region")

BASE_COLUMNS = COMPANY_COLUMNS + (
    "average_funded", "total_rounds", "average_participants", "public_at", "acquired_at",
    "products_number", "offices", "acquired_companies")

LABEL = "is_acquired"


def degree_columns(degrees=DEGREES) -> list[str]:
    return [f"{name}_degree" for name in (*degrees, OTHER)]


def features_schema(key_type: T.DataType | None = None) -> T.StructType:
    """Schema of the feature table; the key may be of any type."""
    text, number, flag = T.StringType(), T.DoubleType(), T.BooleanType()
    count = T.LongType()
    fields = [("company_id", key_type or T.LongType()), ("category_code", text),
              ("country_code", text), ("state_code", text), ("average_funded", number),
              ("total_rounds", count), ("average_participants", number),
              ("products_number", count), ("offices", count), ("acquired_companies", count)]
    fields += [(name, count) for name in degree_columns()]
    fields += [("ipo", flag), (LABEL, flag), ("is_closed", flag), ("age", T.IntegerType())]
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


FEATURE_COLUMNS = tuple(features_schema().fieldNames())

# Columns that may hold missing numbers, in feature-table order (the correlation input).
NUMERIC_GAP_COLUMNS = ("average_funded", "average_participants", "products_number", "offices",
                       "acquired_companies", *degree_columns(), "age")

# Columns of the pair plots.
ECONOMIC_COLUMNS = ("average_funded", "average_participants", "total_rounds", "offices",
                    "products_number", "acquired_companies")
