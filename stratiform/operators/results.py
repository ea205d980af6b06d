"""Tool results of any form as one typed row, through VARIANT columns, and rows of any type as plain JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Layers by category, with their colour, type, name and the property that features without it get.
LAYER_STYLES = {
    "water": ("#87CEEB", "sensitivity_zone", "水系", {"sensitivity_level": "中敏感区"}),
    "road": ("#FF6B6B", "development_axis", "道路", {"axis_type": "交通主轴"}),
    "residential": ("#FFD700", "function_zone", "居民地", {"zone_type": "居住用地"}),
}
# Fields of an analysis, what a layer without type or name is called, what errors say.
ANALYSIS = ["overall_score", "suitability_level", "sensitivity_class", "recommendations", "summary", "coverage_rate", "reachable_count"]
LAYER_TYPE, LAYER_NAME = "analysis", "分析结果"
EMPTY, UNKNOWN, UNKNOWN_TYPE = "工具返回空结果", "未知错误", "未知返回类型"

_LAYER = "struct<layerType:string,layerName:string,color:string,features:int,geojson:string>"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, path: str, kind: str) -> Column:
    """Whether the value at a path is an ``OBJECT``, ``ARRAY`` or ``STRING``."""
    return F.coalesce(F.schema_of_variant(_get(v, path, "variant")).startswith(kind), F.lit(False))


def _truthy(v: Column, path: str) -> Column:
    """Whether a value is there and neither null, false, zero nor empty."""
    return F.coalesce(~_get(v, path).isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def _features(v: Column, path: str) -> Column:
    return F.coalesce(F.size(_get(v, f"{path}.geojson.features", "array<variant>")), F.lit(0))


def _layer(v: Column, path: str) -> Column:
    """The GeoJSON at a path as a list of one layer, empty where it has no features."""
    one = F.struct(
        F.coalesce(_get(v, f"{path}.layer_type"), F.lit(LAYER_TYPE)).alias("layerType"), F.coalesce(_get(v, f"{path}.layer_name"), F.lit(LAYER_NAME)).alias("layerName"),
        F.lit(None).cast("string").alias("color"), _features(v, path).alias("features"), F.to_json(_get(v, f"{path}.geojson", "variant")).alias("geojson"),
    )
    return F.when(_features(v, path) > 0, F.array(one)).otherwise(F.array().cast(f"array<{_LAYER}>"))


def _category(v: Column, name: str) -> Column:
    """A category of the data as a list of one layer: successful, with features, whose properties get the defaults they lack."""
    color, kind, title, defaults = LAYER_STYLES[name]
    at = f"$.data.{name}"
    own = F.create_map(*[x for k, d in defaults.items() for x in (F.lit(k), F.to_variant_object(F.array(F.lit(d))))])
    plain = F.transform_values(own, lambda _, d: F.variant_get(d, "$[0]", "variant"))

    def dressed(feature: Column) -> Column:
        fields = F.coalesce(F.try_variant_get(feature, "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
        given = F.coalesce(F.try_variant_get(feature, "$.properties", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
        lacking = F.map_filter(plain, lambda k, _: ~F.array_contains(F.map_keys(given), k))
        kept = F.map_filter(fields, lambda k, _: k != "properties")
        props = F.to_variant_object(F.map_concat(lacking, given))
        return F.to_variant_object(F.map_concat(kept, F.create_map(F.lit("properties"), props)))

    features = F.transform(_get(v, f"{at}.geojson.features", "array<variant>"), dressed)
    rest = F.map_filter(_get(v, f"{at}.geojson", "map<string,variant>"), lambda k, _: k != "features")
    whole = F.to_variant_object(F.map_concat(rest, F.create_map(F.lit("features"), F.to_variant_object(features))))
    one = F.struct(F.lit(kind).alias("layerType"), F.lit(title).alias("layerName"), F.lit(color).alias("color"), _features(v, at).alias("features"), F.to_json(whole).alias("geojson"))
    return F.when(_truthy(v, f"{at}.success") & (_features(v, at) > 0), F.array(one)).otherwise(F.array().cast(f"array<{_LAYER}>"))


def normalised(results: DataFrame, result: str = "result") -> DataFrame:
    """Results with success, data_type (geojson, analysis, text, error), error, text_data, layers, analysis_data, center and location.

    Null is an error, a text that is no JSON is a text; JSON that is no object, or without
    ``success``, is an error. Layers come from ``geojson`` or ``layers`` at the top, else from
    ``data.geojson``, else from the categories of ``data``, in order; GeoJSON at the top decides
    for its type even without features. Analysis is ``data.summary``, else the known fields at
    the top. ``center`` is a pair, at the top or in ``data``.
    """
    v = F.try_parse_json(F.col(result))
    out = results.withColumn("_v", v)
    v = F.col("_v")
    object_ = _is(v, "$", "OBJECT")
    good = object_ & _truthy(v, "$.success")
    data = _is(v, "$.data", "OBJECT")
    nothing = F.array().cast(f"array<{_LAYER}>")
    listed = F.transform(_get(v, "$.layers", "array<variant>"), lambda x: F.struct(_get(x, "$.layerType").alias("layerType"), _get(x, "$.layerName").alias("layerName"), _get(x, "$.color").alias("color"), _features(x, "$").alias("features"), F.to_json(_get(x, "$.geojson", "variant")).alias("geojson")))
    top = F.when(_truthy(v, "$.geojson"), _layer(v, "$")).when(_truthy(v, "$.layers"), F.coalesce(listed, nothing)).otherwise(nothing)
    nested = F.when(data & _truthy(v, "$.data.geojson"), _layer(v, "$.data")).otherwise(nothing)
    kinds = F.concat(*[_category(v, name) for name in LAYER_STYLES])
    layers = F.when(F.size(top) > 0, top).when(F.size(nested) > 0, nested).when(data, kinds).otherwise(nothing)
    fields = F.map_filter(F.coalesce(_get(v, "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda k, x: k.isin(*ANALYSIS) & ~F.is_variant_null(x))
    summary = F.when(data & _truthy(v, "$.data.summary"), F.to_json(F.struct(_get(v, "$.data.summary", "variant").alias("summary"))))
    analysis = F.coalesce(summary, F.when(F.size(fields) > 0, F.to_json(fields)))
    words = F.when(_is(v, "$.data", "STRING"), _get(v, "$.data"))
    center = F.coalesce(_get(v, "$.center", "array<double>"), F.when(data, _get(v, "$.data.center", "array<double>")))
    text_only = F.col(result).isNotNull() & v.isNull()
    kind = F.when(F.col(result).isNull() | (~text_only & ~good), "error").when(text_only, "text").when((F.size("layers") > 0) | _truthy(v, "$.geojson"), "geojson")
    kind = kind.when(F.col("analysis_data").isNotNull(), "analysis").when(F.length("text_data") > 0, "text").otherwise("analysis")
    error = F.when(F.col(result).isNull(), EMPTY).when(~text_only & ~object_, UNKNOWN_TYPE).when(~text_only & ~good, F.coalesce(_get(v, "$.error"), F.lit(UNKNOWN)))
    out = out.withColumns({
        "layers": F.when(good, layers).otherwise(nothing), "analysis_data": F.when(good, analysis), "text_data": F.when(text_only, F.col(result)).when(good, words),
        "center": F.when(good & (F.size(center) == 2), center), "location": F.when(good, _get(v, "$.location")),
    })
    return out.withColumns({"data_type": kind, "error": error}).withColumn("success", F.col("error").isNull()).drop("_v")


def plain(value: Column, kind: T.DataType) -> Column:
    """A value as JSON can hold it, whatever its nesting: times in ISO form, sets as the arrays they are, all else that is no JSON as text."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(F.date_format(value, "SSSSSS") == "000000", whole).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        texts = F.transform_keys(value, lambda k, _: plain(k, kind.keyType).cast("string"))
        return F.transform_values(texts, lambda _, x: plain(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.NullType, T.VariantType)) and not isinstance(kind, T.DecimalType):
        return value
    return value.cast("string")


def sanitised(df: DataFrame, *columns: str) -> DataFrame:
    """The given columns (all, if none) as JSON can hold them."""
    names = columns or tuple(df.columns)
    return df.select(*[plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if f.name in names else F.col(f"`{f.name}`") for f in df.schema.fields])


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as one object, nulls kept."""
    return sanitised(df).select(F.col(key), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
