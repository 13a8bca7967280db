"""The feature type system: a Spark type, a family and a default event aggregator for each of 53 types.

A feature is a column; its type is the `ftype` key in the field's metadata. Empty values (empty strings stay) are null:
an empty list, set or map and null mean the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


@dataclass(frozen=True)
class FeatureType:
    name: str
    spark: T.DataType
    family: str  # numeric, date, text, category, list, set, location, vector, map kinds with a "map:" prefix
    aggregator: str
    nullable: bool = True


def _registry() -> dict[str, FeatureType]:
    out: dict[str, FeatureType] = {}

    def add(name: str, spark: T.DataType, family: str, aggregator: str, nullable: bool = True) -> None:
        out[name] = FeatureType(name, spark, family, aggregator, nullable)

    add("Binary", B, "binary", "LogicalOr")
    add("Integral", L, "integral", "SumIntegral")
    for n in ("Real", "Currency"):
        add(n, D, "real", f"Sum{n}")
    add("RealNN", D, "real", "SumRealNN", False)
    add("Percent", D, "real", "MeanPercent")
    for n in ("Date", "DateTime"):
        add(n, L, "date", f"Max{n}")
    for n in ("Text", "TextArea"):
        add(n, S, "text", f"Concat{n}")
    for n in ("Base64", "ComboBox", "Email", "ID", "Phone", "URL", "Country", "State", "City", "PostalCode", "Street"):
        add(n, S, "category", f"Concat{n}")
    add("PickList", S, "category", "ModePickList")
    add("OPVector", T.ArrayType(D), "vector", "CombineVector", False)
    add("TextList", T.ArrayType(S), "list", "ConcatTextList")
    for n in ("DateList", "DateTimeList"):
        add(n, T.ArrayType(L), "datelist", f"Concat{n}")
    add("Geolocation", T.ArrayType(D), "location", "GeolocationMidpoint")
    add("MultiPickList", T.ArrayType(S), "set", "UnionMultiPickList")
    texts = ("Base64", "ComboBox", "Email", "ID", "Phone", "PickList", "TextArea", "Text", "URL", "Country", "State", "City", "PostalCode", "Street")
    for n in texts:
        add(f"{n}Map", T.MapType(S, S), "map:text", f"UnionConcat{n}Map")
    add("NameStats", T.MapType(S, S), "map:text", "UnionConcatNameStats")
    add("BinaryMap", T.MapType(S, B), "map:binary", "UnionBinaryMap")
    for n in ("Currency", "Real"):
        add(f"{n}Map", T.MapType(S, D), "map:real", f"Union{n}Map")
    add("PercentMap", T.MapType(S, D), "map:real", "UnionMeanPercentMap")
    add("IntegralMap", T.MapType(S, L), "map:integral", "UnionIntegralMap")
    for n in ("Date", "DateTime"):
        add(f"{n}Map", T.MapType(S, L), "map:date", f"UnionMax{n}Map")
    add("MultiPickListMap", T.MapType(S, T.ArrayType(S)), "map:set", "UnionMultiPickListMap")
    add("GeolocationMap", T.MapType(S, T.ArrayType(D)), "map:location", "UnionGeolocationMidpointMap")
    add("Prediction", T.MapType(S, D), "prediction", "UnionMeanPrediction", False)
    return out


TYPES = _registry()


def infer(field: T.StructField) -> str:
    """The feature type of a column: its `ftype`, or what its Spark type suggests. Types without a meaning are an error."""
    if "ftype" in (field.metadata or {}):
        return field.metadata["ftype"]
    t = field.dataType
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return "Real" if field.nullable else "RealNN"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integral"
    if isinstance(t, T.DateType):
        return "Date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    if isinstance(t, T.StringType):
        return "Text"
    if isinstance(t, T.BooleanType):
        return "Binary"
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, T.StringType):
            return "TextList"
        if isinstance(t.elementType, T.LongType):
            return "DateList"
        if isinstance(t.elementType, T.DoubleType):
            return "Geolocation"
    if isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType):
        v = t.valueType
        if isinstance(v, T.StringType):
            return "TextMap"
        if isinstance(v, T.DoubleType):
            return "RealMap"
        if isinstance(v, T.LongType):
            return "IntegralMap"
        if isinstance(v, T.BooleanType):
            return "BinaryMap"
        if isinstance(v, T.ArrayType):
            return "MultiPickListMap" if isinstance(v.elementType, T.StringType) else "GeolocationMap"
    if type(t).__name__ == "VectorUDT":
        return "OPVector"
    raise TypeError(f"column {field.name} of type {t.simpleString()} has no feature type")


def empty_to_null(name: str):
    """Column function: empty collections become null."""
    from pyspark.sql import functions as F

    kind = TYPES[name].spark
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return lambda c: F.when(F.size(c) > 0, c)
    return lambda c: c
