"""GeoJSON layers: typed geometry in, feature collections out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Properties that tell a layer's kind, by the geometry of its first feature, and the kind without them.
LAYER_KINDS = {
    "Polygon": ([("boundary", ["boundary", "admin_level"]), ("water", ["water", "waterway"]), ("road", ["highway"])], "boundary"),
    "LineString": ([("road", ["highway", "railway"]), ("water", ["waterway"])], "road"),
    "Point": ([("residential", ["place", "building"])], None),
}
FEATURE = "struct<type: string, features: array<struct<geometry: struct<type: string, coordinates: string>, properties: string>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, geometry_type, coordinates, properties): coordinates and free properties stay JSON text."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", FEATURE).alias("c"))
    f = files.select("path", F.posexplode_outer("c.features").alias("pos", "f"))
    return f.select("path", "pos", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties")).filter("geometry_type is not null")


def point(coordinates: Column) -> Column:
    return F.from_json(coordinates, "array<double>")


def outer_rings(geometry_type: Column, coordinates: Column) -> Column:
    """Outer ring of a polygon, or of each polygon of several; null for other geometries."""
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(geometry_type == "Polygon", F.array(F.try_element_at(one, F.lit(1)))).when(geometry_type == "MultiPolygon", F.transform(many, lambda p: F.try_element_at(p, F.lit(1))))


def layer_kind(geometry_type: Column, properties: Column) -> Column:
    """boundary, road, water or residential of a layer's first feature; null if it tells none. Empty, zero and false properties count as absent."""
    out = None
    for geometry, (kinds, otherwise) in LAYER_KINDS.items():
        kind = F.lit(otherwise).cast("string")
        for name, keys in reversed(kinds):
            given = [F.coalesce(~F.get_json_object(properties, f"$.{k}").isin("", "0", "false", "null", "[]", "{}"), F.lit(False)) for k in keys]
            kind = F.when(given[0] if len(given) == 1 else given[0] | given[1], name).otherwise(kind)
        mine = (geometry_type == geometry) | ((geometry_type == f"Multi{geometry}") & F.lit(geometry != "Point"))
        out = F.when(mine, kind) if out is None else out.when(mine, kind)
    return out


def point_features(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """One JSON feature per row; the other columns become properties, missing numbers become null."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature a line (GeoJSON text sequences), so that the write stays distributed."""
    features.select("feature").write.mode("overwrite").text(path)
