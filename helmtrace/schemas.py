"""Column layouts, parameters and code tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

PING_COLUMNS = [
    "MMSI",
    "VesselName",
    "VesselType",
    "LAT",
    "LON",
    "SOG",
    "COG",
    "Heading",
    "BaseDateTime",
]

PING_SCHEMA = T.StructType(
    [
        T.StructField("MMSI", T.LongType()),
        T.StructField("VesselName", T.StringType()),
        T.StructField("VesselType", T.IntegerType()),
        T.StructField("LAT", T.DoubleType()),
        T.StructField("LON", T.DoubleType()),
        T.StructField("SOG", T.DoubleType()),
        T.StructField("COG", T.DoubleType()),
        T.StructField("Heading", T.DoubleType()),
        T.StructField("BaseDateTime", T.TimestampType()),
        T.StructField("file_date", T.DateType()),
    ]
)

OPTIONAL_NUMBERS = ["Length", "Width", "Draft"]
OPTIONAL_TEXTS = ["Status", "IMO", "CallSign", "Flag"]

# Anomaly type names, in the order the detectors report them.
ANOMALY_TYPES = [
    "AIS_Beacon_On",
    "AIS_Beacon_Off",
    "Speed",
    "Course",
    "Loitering",
    "Rendezvous",
    "Identity_Spoofing",
    "Zone_Violation",
]

ANOMALY_SCHEMA = T.StructType(
    PING_SCHEMA.fields
    + [
        T.StructField("AnomalyType", T.StringType()),
        T.StructField("SpeedAnomaly", T.BooleanType()),
        T.StructField("PositionAnomaly", T.BooleanType()),
        T.StructField("CourseAnomaly", T.BooleanType()),
        T.StructField("Date", T.DateType()),
        T.StructField("ReportDate", T.StringType()),
        T.StructField("BeaconAnomaly", T.BooleanType()),
        T.StructField("BeaconGapMinutes", T.DoubleType()),
        T.StructField("Distance", T.DoubleType()),
        T.StructField("TimeDiff", T.DoubleType()),
        T.StructField("ImpliedSpeed", T.DoubleType()),
        T.StructField("CourseHeadingDiff", T.DoubleType()),
        T.StructField("LoiteringRadiusNM", T.DoubleType()),
        T.StructField("LoiteringDurationHours", T.DoubleType()),
        T.StructField("LoiteringRecordCount", T.LongType()),
        T.StructField("TimeWindow", T.IntegerType()),
        T.StructField("RendezvousMMSI2", T.LongType()),
        T.StructField("RendezvousDistanceNM", T.DoubleType()),
        T.StructField("RendezvousLat", T.DoubleType()),
        T.StructField("RendezvousLon", T.DoubleType()),
        T.StructField("SpoofingIssue", T.StringType()),
        T.StructField("NameCount", T.LongType()),
        T.StructField("VesselNames", T.StringType()),
        T.StructField("ZoneName", T.StringType()),
        T.StructField("ZoneLatMin", T.DoubleType()),
        T.StructField("ZoneLatMax", T.DoubleType()),
        T.StructField("ZoneLonMin", T.DoubleType()),
        T.StructField("ZoneLonMax", T.DoubleType()),
        T.StructField("Confidence", T.DoubleType()),
    ]
)

ZONE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("geometry_type", T.StringType()),
        T.StructField("lat_min", T.DoubleType()),
        T.StructField("lat_max", T.DoubleType()),
        T.StructField("lon_min", T.DoubleType()),
        T.StructField("lon_max", T.DoubleType()),
        T.StructField("center_lat", T.DoubleType()),
        T.StructField("center_lon", T.DoubleType()),
        T.StructField("radius_meters", T.DoubleType()),
        T.StructField("coordinates", T.StringType()),
        T.StructField("tolerance_meters", T.DoubleType()),
        T.StructField("is_selected", T.BooleanType()),
    ]
)

# The zones used when none is selected.
DEFAULT_ZONES = [
    {"name": "Strait of Hormuz", "lat_min": 25.0, "lat_max": 27.0, "lon_min": 55.0, "lon_max": 57.5},
    {"name": "South China Sea", "lat_min": 5.0, "lat_max": 25.0, "lon_min": 105.0, "lon_max": 120.0},
]

# AIS ship-type code names (ITU-R M.1371 codes as the reports print them).
VESSEL_TYPE_NAMES = {
    20: "Wing in ground (WIG), all ships of this type",
    21: "Wing in ground (WIG), Hazardous category A",
    22: "Wing in ground (WIG), Hazardous category B",
    23: "Wing in ground (WIG), Hazardous category C",
    24: "Wing in ground (WIG), Hazardous category D",
    30: "Fishing",
    31: "Towing",
    32: "Towing: length exceeds 200m or breadth exceeds 25m",
    33: "Dredging or underwater ops",
    34: "Diving ops",
    35: "Military ops",
    36: "Sailing",
    37: "Pleasure Craft",
    38: "Reserved",
    39: "Reserved",
    40: "High speed craft (HSC), all ships of this type",
    41: "High speed craft (HSC), Hazardous category A",
    42: "High speed craft (HSC), Hazardous category B",
    43: "High speed craft (HSC), Hazardous category C",
    44: "High speed craft (HSC), Hazardous category D",
    45: "High speed craft (HSC), Reserved",
    46: "High speed craft (HSC), Reserved",
    47: "High speed craft (HSC), Reserved",
    48: "High speed craft (HSC), Reserved",
    49: "High speed craft (HSC), No additional information",
    50: "Pilot Vessel",
    51: "Search and Rescue vessel",
    52: "Tug",
    53: "Port Tender",
    54: "Anti-pollution equipment",
    55: "Law Enforcement",
    56: "Spare - Local Vessel",
    57: "Spare - Local Vessel",
    58: "Medical Transport",
    59: "Noncombatant ship (RR Resolution No. 18)",
    60: "Passenger, all ships of this type",
    61: "Passenger, Hazardous category A",
    62: "Passenger, Hazardous category B",
    63: "Passenger, Hazardous category C",
    64: "Passenger, Hazardous category D",
    69: "Passenger, No additional information",
    70: "Cargo, all ships of this type",
    71: "Cargo, Hazardous category A",
    72: "Cargo, Hazardous category B",
    73: "Cargo, Hazardous category C",
    74: "Cargo, Hazardous category D",
    79: "Cargo, No additional information",
    80: "Tanker, all ships of this type",
    81: "Tanker, Hazardous category A",
    82: "Tanker, Hazardous category B",
    83: "Tanker, Hazardous category C",
    84: "Tanker, Hazardous category D",
    89: "Tanker, No additional information",
    90: "Other, all ships of this type",
    91: "Other, Hazardous category A",
    92: "Other, Hazardous category B",
    93: "Other, Hazardous category C",
    94: "Other, Hazardous category D",
    99: "Other, No additional information",
}

# Ship types analysed when a run names none.
DEFAULT_SHIP_TYPES = [
    20, 21, 22, 23, 24, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53,
    54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 69, 70, 71, 72, 73, 74, 79, 80, 81, 82, 83, 84, 89, 90, 91, 92, 93, 94,
]

# Ship-type groups of the training reports.
VESSEL_CATEGORIES = {
    "Fishing": [30],
    "Cargo": [70, 71, 72, 73, 74, 79],
    "Tanker": [80, 81, 82, 83, 84, 89],
    "Passenger": list(range(60, 70)),
    "Towing": [31, 32],
    "Special Purpose": list(range(50, 60)),
    "HSC": list(range(40, 50)),
    "Other": list(range(90, 100)),
}

# Display names and short report names of the anomaly types.
ANOMALY_LABELS = {
    "AIS_Beacon_Off": "AIS Beacon Off",
    "AIS_Beacon_On": "AIS Beacon On",
    "Speed": "Excessive Travel Distance (Fast)",
    "Course": "Course over Ground-Heading Inconsistency",
    "Loitering": "Loitering",
    "Rendezvous": "Rendezvous",
    "Identity_Spoofing": "Identity Spoofing",
    "Zone_Violation": "Zone Violations",
}
ANOMALY_REPORT_NAMES = {
    "AIS_Beacon_Off": "AIS off",
    "AIS_Beacon_On": "AIS on",
    "Speed": "Speed",
    "Course": "Course",
    "Loitering": "Loitering",
    "Rendezvous": "Rendezvous",
    "Identity_Spoofing": "Identity Spoofing",
    "Zone_Violation": "Zone Violations",
}
EXTRA_LABELS = {"Excessive Travel Distance (Slow)": "Speed"}


@dataclass(frozen=True)
class Params:
    """Thresholds of a detection run; defaults are the effective ones.

    ``ship_types``: None means ``DEFAULT_SHIP_TYPES``, an empty list means all types and rows without one.
    ``max_anomalies_per_vessel``: 0 means all.
    """

    speed_threshold: float = 102.0
    time_diff_threshold_min: float = 240.0
    beacon_hours: float = 6.0
    cog_heading_max_diff: float = 45.0
    min_speed_for_cog: float = 10.0
    drop_heading_511: bool = False
    loitering_radius_nm: float = 5.0
    loitering_hours: float = 24.0
    loitering_min_records: int = 10
    rendezvous_nm: float = 0.5
    rendezvous_min_records: int = 3
    include_first_day: bool = False
    ship_types: list[int] | None = None
    enabled_types: list[str] = field(default_factory=lambda: list(ANOMALY_TYPES))
    min_latitude: float = -90.0
    max_latitude: float = 90.0
    min_longitude: float = -180.0
    max_longitude: float = 180.0
    start_hour: int = 0
    end_hour: int = 24
    mmsi_list: list[int] = field(default_factory=list)
    max_anomalies_per_vessel: int = 0
    rendezvous_salts: int = 8

    def selected_types(self) -> list[int]:
        return DEFAULT_SHIP_TYPES if self.ship_types is None else self.ship_types
