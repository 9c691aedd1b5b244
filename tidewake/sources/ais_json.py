"""Vessel broadcast envelopes: JSON text to positions and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.labels import optional_double, optional_int, text_or_null, utc_micros

_POSITION = "struct<UserID: string, Sog: string, Cog: string, TrueHeading: string, NavigationalStatus: string, Latitude: string, Longitude: string, Name: string, Type: string>"
ENVELOPE = (
    "MessageType string, MetaData struct<MMSI: string, ShipName: string, latitude: string, longitude: string, time_utc: string>, "
    f"Message struct<PositionReport: {_POSITION}, StandardClassBPositionReport: {_POSITION}, ExtendedClassBPositionReport: {_POSITION}, "
    "ShipStaticData: struct<UserID: string, Name: string, Type: string, CallSign: string>, "
    "StaticDataReport: struct<UserID: string, PartNumber: string, ReportA: struct<Name: string>, ReportB: struct<ShipType: string, CallSign: string>>>"
)
# Message kinds with a position, and with an identity.
POSITION_KINDS = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport")
IDENTITY_KINDS = ("ShipStaticData", "ExtendedClassBPositionReport", "StaticDataReport")


def decode(lines: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes of the known kinds; lines that aren't JSON are skipped. All fields stay text."""
    parsed = lines.withColumn("m", F.from_json(F.col(column), ENVELOPE, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.col("m.MessageType").isin(*POSITION_KINDS, *IDENTITY_KINDS)).select("*", "m.*").drop("m", column)


def _or(*cs: Column) -> Column:
    """The first value that is neither missing, empty nor zero."""
    real = [F.when((c != "") & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0), c) for c in cs]
    return F.coalesce(*real)


def _body(kinds: tuple[str, ...], field: str) -> Column:
    out = F.lit(None).cast("string")
    for k in kinds:
        out = F.when(F.col("MessageType") == k, F.col(f"Message.{k}.{field}")).otherwise(out)
    return out


def positions(envelopes: DataFrame) -> DataFrame:
    """mmsi, time_us, lon, lat, sog, cog, true_heading, nav_status of classes A and B.

    A row needs an identity, a time and both coordinates; class B never has a status.
    """
    p = envelopes.filter(F.col("MessageType").isin(*POSITION_KINDS))
    body = lambda f: _body(POSITION_KINDS, f)
    out = p.select(
        optional_double(_or(F.col("MetaData.MMSI"), body("UserID"))).cast("long").alias("mmsi"), utc_micros(F.col("MetaData.time_utc")).alias("time_us"),
        optional_double(F.coalesce(body("Longitude"), F.col("MetaData.longitude"))).alias("lon"), optional_double(F.coalesce(body("Latitude"), F.col("MetaData.latitude"))).alias("lat"),
        optional_double(body("Sog")).alias("sog"), optional_double(body("Cog")).alias("cog"), optional_int(body("TrueHeading")).cast("short").alias("true_heading"),
        F.when(F.col("MessageType") == "PositionReport", optional_int(body("NavigationalStatus"))).cast("short").alias("nav_status"),
    )
    return out.dropna(subset=["mmsi", "time_us", "lon", "lat"])


def identities(envelopes: DataFrame) -> DataFrame:
    """mmsi, time_us, ship_name, ship_type, callsign; a static report's part A names, its part B types.

    A message that says nothing is dropped. An extended class B report is a position and an
    identity at once.
    """
    p = envelopes.filter(F.col("MessageType").isin(*IDENTITY_KINDS))
    kind = F.col("MessageType")
    part_b = F.lower(F.coalesce("Message.StaticDataReport.PartNumber", F.lit("0"))).isin("1", "true")
    static = "Message.StaticDataReport"
    name = F.when(kind == "ShipStaticData", F.col("Message.ShipStaticData.Name")).when(kind == "ExtendedClassBPositionReport", F.col("Message.ExtendedClassBPositionReport.Name")).when(~part_b, F.col(f"{static}.ReportA.Name"))
    type_ = F.when(kind == "ShipStaticData", F.col("Message.ShipStaticData.Type")).when(kind == "ExtendedClassBPositionReport", F.col("Message.ExtendedClassBPositionReport.Type")).when(part_b, F.col(f"{static}.ReportB.ShipType"))
    sign = F.when(kind == "ShipStaticData", F.col("Message.ShipStaticData.CallSign")).when((kind == "StaticDataReport") & part_b, F.col(f"{static}.ReportB.CallSign"))
    out = p.select(
        optional_double(_or(F.col("MetaData.MMSI"), _body(IDENTITY_KINDS, "UserID"))).cast("long").alias("mmsi"), utc_micros(F.col("MetaData.time_utc")).alias("time_us"),
        F.substring(text_or_null(name), 1, 20).alias("ship_name"), optional_int(type_).cast("short").alias("ship_type"), F.substring(text_or_null(sign), 1, 7).alias("callsign"),
    )
    return out.dropna(subset=["mmsi", "time_us"]).filter(F.coalesce(F.col("ship_name"), F.col("callsign"), F.col("ship_type").cast("string")).isNotNull())


def to_envelopes(positions_: DataFrame) -> DataFrame:
    """Position rows as envelope lines (for replays and tests)."""
    body = F.struct(F.col("mmsi").alias("UserID"), F.col("sog").alias("Sog"), F.col("cog").alias("Cog"), F.col("true_heading").alias("TrueHeading"), F.col("nav_status").alias("NavigationalStatus"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"))
    stamp = F.date_format(F.timestamp_micros("time_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.concat(stamp, F.lit("123 +0000 UTC")).alias("time_utc"))
    return positions_.select(F.to_json(F.struct(F.lit("PositionReport").alias("MessageType"), meta.alias("MetaData"), F.struct(body.alias("PositionReport")).alias("Message"))).alias("value"))


def subscription(regions: list[dict], key: str) -> dict:
    """The feed's subscription: every region's box as [[lat, lon], [lat, lon]] and the five kinds."""
    kinds = list(dict.fromkeys((*POSITION_KINDS, *IDENTITY_KINDS)))
    boxes = [[[r["ais_min_lat"], r["ais_min_lon"]], [r["ais_max_lat"], r["ais_max_lon"]]] for r in regions]
    return {"APIKey": key, "BoundingBoxes": boxes, "FilterMessageTypes": kinds}
