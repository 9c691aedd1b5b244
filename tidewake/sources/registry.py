"""Static registries: tracked regions, station prefixes, code labels."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The table of station prefixes that ships with the package; any other of its form will do.
PREFIXES = Path(__file__).with_name("station_prefixes.txt")

# Regions with their display name, message box, imaging box, mode and usable passes in 30 days.
REGIONS = (
    ("north_taiwan", "North Taiwan", (120.70, 24.90, 122.40, 26.30), (120.90, 24.95, 122.20, 25.60), "fused", 7),
    ("gulf_of_finland", "Gulf of Finland", (24.50, 59.20, 28.60, 60.40), (25.20, 59.45, 27.60, 60.28), "fused", 20),
    ("skagen_kattegat", "Skagen Anchorage", (9.85, 57.15, 11.95, 58.45), (10.00, 57.40, 11.60, 58.20), "fused", 20),
    ("bosphorus_marmara", "Bosphorus Approaches", (28.20, 40.55, 29.70, 41.15), (28.45, 40.72, 28.85, 41.00), "fused", 15),
    ("malta_hurds_bank", "Hurd Bank, Malta", (13.90, 35.30, 15.35, 36.50), (14.35, 35.75, 14.95, 36.15), "fused", 15),
    ("syria_coast_sts", "Syrian Coast", (35.40, 34.65, 36.15, 35.50), (35.55, 34.80, 36.00, 35.30), "fused", 20),
    ("hormuz_strait", "Strait of Hormuz", (55.65, 26.00, 56.95, 27.00), (55.95, 26.15, 56.85, 26.85), "survey", 10),
    ("musandam_stage", "Musandam Staging Area", (56.80, 25.50, 57.50, 26.10), (56.90, 25.60, 57.40, 26.05), "survey", 10),
    ("kharg_island", "Kharg Island Terminal", (50.00, 29.00, 50.70, 29.60), (50.10, 29.10, 50.60, 29.50), "survey", 10),
    ("eopl_tompok_utara", "Tompok Utara Anchorage", (104.30, 1.10, 105.15, 1.80), (104.65, 1.25, 105.10, 1.70), "survey", 5),
    ("kerch_strait", "Kerch Strait", (36.30, 45.00, 36.80, 45.50), (36.35, 45.05, 36.75, 45.45), "survey", 10),
    ("somali_coast", "Northeast Somalia Coast", (50.50, 8.40, 51.50, 9.45), (51.02, 8.60, 51.38, 9.25), "survey", 10),
)

# Hull categories by code, first and last.
SHIP_TYPES = (
    (20, 29, "Wing in ground"), (30, 30, "Fishing"), (31, 32, "Towing"), (33, 33, "Dredging"), (34, 34, "Diving ops"), (35, 35, "Military"),
    (36, 36, "Sailing"), (37, 37, "Pleasure craft"), (40, 49, "High-speed craft"), (50, 59, "Special craft"), (60, 69, "Passenger"), (70, 79, "Cargo"),
    (80, 89, "Tanker"), (90, 99, "Other"),
)

# Navigational status by code.
NAV_STATUS = (
    "under way using engine", "at anchor", "not under command", "restricted manoeuvrability", "constrained by draught", "moored",
    "aground", "engaged in fishing", "under way sailing",
)

# Publishable failure reasons, the first whose token occurs wins.
FAILURES = (
    (("real data", "coverage"), "Swath missed the box"),
    (("credential", "401", "403"), "Imagery access rejected"),
    (("timeout", "timed out"), "Imagery fetch timed out"),
    (("model checkpoint", "dependencies"), "Detector unavailable"),
    (("killed for memory", "subprocess died"), "Detector ran out of memory"),
    (("interrupted by restart",), "Interrupted by a restart"),
    (("ais",), "No AIS reference in window"),
)
FAILURE_UNKNOWN = "Analysis error"
FAILURE_UNREACHABLE = ("Imagery access rejected", "Imagery fetch timed out")

_BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def region_rows() -> list[tuple]:
    return [(n, label, *ais, *sar, mode, passes) for n, label, ais, sar, mode, passes in REGIONS]


REGION_COLUMNS = ("name", "label", *(f"ais_{c}" for c in _BOX), *(f"sar_{c}" for c in _BOX), "mode", "passes_per_month")


def regions(spark: SparkSession) -> DataFrame:
    """The twelve regions: small and fixed, so joins with them are broadcast."""
    kinds = ["string", "string", *["double"] * 8, "string", "int"]
    return spark.createDataFrame(region_rows(), ", ".join(f"{c} {k}" for c, k in zip(REGION_COLUMNS, kinds)))


def region(name: str) -> dict:
    """One region's values; an unknown name is an error that lists the known ones."""
    for row in region_rows():
        if row[0] == name:
            return dict(zip(REGION_COLUMNS, row))
    raise ValueError(f"unknown region {name!r}; known: {', '.join(sorted(r[0] for r in REGIONS))}")


def flag_rows(path: str | Path = PREFIXES) -> list[tuple[int, str, str]]:
    """(prefix, letters, administration) of a prefix table; lines that start with # are remarks."""
    with open(path, encoding="utf-8") as f:
        parts = [line.rstrip("\n").split(" ", 2) for line in f if line.strip() and not line.startswith("#")]
    return [(int(mid), iso2, country) for mid, iso2, country in parts]


def flag_table(spark: SparkSession, rows: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """(mid, flag_iso2, flag_country), at most one row for each three-digit prefix (a proven bound)."""
    return spark.createDataFrame(rows if rows is not None else flag_rows(), "mid int, flag_iso2 string, flag_country string").dropDuplicates(["mid"])


def values_sql(rows: list[tuple], names: tuple[str, ...]) -> str:
    """Rows as a VALUES table for an oracle."""
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else repr(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({', '.join(names)}))"
