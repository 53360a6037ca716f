"""The same results as SQL over the raw test tables, written independently of the operators."""

from __future__ import annotations

import re

from helmtrace.checks.fixtures import PINGS_SQL, RAW_SQL
from helmtrace.schemas import ANOMALY_LABELS, ANOMALY_REPORT_NAMES, VESSEL_CATEGORIES, VESSEL_TYPE_NAMES

TYPES = sorted(ANOMALY_LABELS)


def R(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x} + 1e-9, {digits}) + 0.0 AS {name or x.split('.')[-1]}"


def TS(x: str, name: str | None = None) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f') AS {name or x.split('.')[-1]}"


def DT(x: str, name: str | None = None) -> str:
    return f"strftime({x}, '%Y-%m-%d') AS {name or x.split('.')[-1]}"


def H(a: str, b: str, c: str, d: str, r: float = 3440.1) -> str:
    return (
        f"(2 * {r} * asin(sqrt(least(1.0, pow(sin(radians(({c}) - ({a})) / 2), 2)"
        f" + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))))"
    )


def HRS(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 3600000000.0)"


def MINS(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 60000000.0)"


def WRAP(d: str) -> str:
    return (
        f"CASE WHEN ({d}) > 180 THEN ({d}) - 360 * ceil((({d}) - 180) / 360)"
        f" WHEN ({d}) < -180 THEN ({d}) + 360 * ceil((-({d}) - 180) / 360) ELSE ({d}) END"
    )


def P(t: str = "") -> str:
    """The ping columns in shown form."""
    t = f"{t}." if t else ""
    return ", ".join(
        [f"{t}MMSI AS MMSI", f"{t}VesselName AS VesselName", f"coalesce({t}VesselType, -1) AS VesselType"]
        + [R(f"{t}{c}", c) for c in ("LAT", "LON", "SOG", "COG", "Heading")]
        + [TS(f"{t}BaseDateTime", "BaseDateTime")]
    )


def STAMP(kind: str, speed: bool, position: bool, course: bool, day: str) -> str:
    return (
        f"'{kind}' AS AnomalyType, {speed} AS SpeedAnomaly, {position} AS PositionAnomaly, {course} AS CourseAnomaly, "
        f"{DT(day, 'Date')}, {DT(day, 'ReportDate')}"
    )


def BEARING(a: str, b: str, c: str, d: str) -> str:
    return (
        f"atan2(sin(radians({d}) - radians({b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c}))"
        f" - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b})))"
    )


def NAMES(table: dict, column: str, other: str) -> str:
    cases = " ".join(f"WHEN {column} = {k!r} THEN '{v}'" for k, v in table.items())
    return f"CASE {cases} ELSE {other} END"


def TYPE_NAME(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN NULL ELSE {NAMES(VESSEL_TYPE_NAMES, column, f'''concat('Vessel Type ', {column})''')} END"


def CATEGORY(column: str) -> str:
    cases = " ".join(f"WHEN {column} IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in VESSEL_CATEGORIES.items())
    return f"CASE {cases} ELSE 'Unknown' END"


WEDGE = [(24.74, -82.26), (24.7581, -82.24), (24.74, -82.24)]
CABLE = ((24.99, -82.01), (25.02, -81.98))


def IN_RING(ring: list[tuple[float, float]]) -> str:
    parts = []
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if a == c:
            continue
        at = f"({b} + (LAT - {a}) * ({d} - ({b})) / ({c} - ({a})))"
        inside = "true" if b == d else f"LON <= {at}"
        parts.append(
            f"CASE WHEN LAT > {min(a, c)} AND LAT <= {max(a, c)} AND LON <= {max(b, d)} AND {inside} THEN 1 ELSE 0 END"
        )
    return f"(({' + '.join(parts)}) % 2 = 1)"


def LINE_M(line) -> str:
    (a, b), (c, d) = line
    m = 6371000.0
    to_a, to_b = H("LAT", "LON", str(a), str(b), m), H("LAT", "LON", str(c), str(d), m)
    length = H(str(a), str(b), str(c), str(d), m)
    turn = f"({BEARING(str(a), str(b), 'LAT', 'LON')} - {BEARING(str(a), str(b), str(c), str(d))})"
    across = f"asin(greatest(-1.0, least(1.0, sin({to_a} / {m}) * sin({turn}))))"
    along = f"(acos(greatest(-1.0, least(1.0, cos({to_a} / {m}) / cos({across})))) * {m})"
    return f"CASE WHEN {along} BETWEEN 0 AND {length} THEN abs({across}) * {m} ELSE least({to_a}, {to_b}) END"


IN_BOX = "(LAT BETWEEN 24.0 AND 24.3 AND LON BETWEEN -83.1 AND -82.6)"
IN_CIRCLE = f"({H('LAT', 'LON', '24.5', '-82.5', 6371000.0)} <= 900.0)"
WC = "(PARTITION BY MMSI, segment_id ORDER BY BaseDateTime, LAT, LON)"
PART = "PARTITION BY MMSI, file_date"


def detector_parts(src: str, s: str = "") -> dict[str, str]:
    """Detector records of one ping source, as named parts with suffix ``s``."""
    return {
        f"clean{s}": f"SELECT * FROM {src} WHERE LAT BETWEEN -90 AND 90 AND LON BETWEEN -180 AND 180 AND SOG <= 102",
        f"days{s}": f"SELECT file_date, row_number() OVER (ORDER BY file_date) AS di, "
        f"file_date IN (SELECT file_date FROM clean{s}) AS has FROM (SELECT DISTINCT file_date FROM {src})",
        f"later{s}": f"SELECT c.* FROM clean{s} c JOIN days{s} d USING (file_date) "
        f"WHERE d.di > (SELECT min(di) FROM days{s} WHERE has)",
        f"fp{s}": f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER ({PART} ORDER BY BaseDateTime, LAT, LON) rn FROM clean{s}) WHERE rn = 1",
        f"lp{s}": f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER ({PART} ORDER BY BaseDateTime DESC, LAT DESC, LON DESC) rn FROM clean{s}) WHERE rn = 1",
        f"d_on{s}": f"SELECT f.*, {MINS('CAST(f.file_date AS TIMESTAMP)', 'f.BaseDateTime')} AS gap, f.file_date AS Day FROM fp{s} f "
        f"JOIN days{s} d ON d.file_date = f.file_date JOIN days{s} p ON p.di = d.di - 1 AND p.has "
        f"WHERE NOT EXISTS (SELECT 1 FROM fp{s} x WHERE x.MMSI = f.MMSI AND x.file_date = p.file_date) "
        f"AND {MINS('CAST(f.file_date AS TIMESTAMP)', 'f.BaseDateTime')} >= 360",
        f"d_off{s}": f"SELECT l.*, {MINS('l.BaseDateTime', '''CAST(l.file_date AS TIMESTAMP) + INTERVAL 86399 SECOND''')} AS gap, n.file_date AS Day FROM lp{s} l "
        f"JOIN days{s} d ON d.file_date = l.file_date JOIN days{s} n ON n.di = d.di + 1 AND n.has "
        f"WHERE NOT EXISTS (SELECT 1 FROM fp{s} x WHERE x.MMSI = l.MMSI AND x.file_date = n.file_date) "
        f"AND {MINS('l.BaseDateTime', '''CAST(l.file_date AS TIMESTAMP) + INTERVAL 86399 SECOND''')} >= 360",
        f"d_speed{s}": f"SELECT * FROM (SELECT f.*, f.file_date AS Day, {H('l.LAT', 'l.LON', 'f.LAT', 'f.LON')} AS nm, {MINS('l.BaseDateTime', 'f.BaseDateTime')} AS mins "
        f"FROM fp{s} f JOIN days{s} d ON d.file_date = f.file_date JOIN days{s} p ON p.di = d.di - 1 "
        f"JOIN lp{s} l ON l.MMSI = f.MMSI AND l.file_date = p.file_date) WHERE mins <= 240 AND nm / (mins / 60) > 102",
        f"d_course{s}": f"SELECT * FROM (SELECT *, file_date AS Day, {WRAP('COG - Heading')} AS turn FROM later{s} WHERE SOG >= 10) WHERE abs(turn) > 45",
        f"d_loiter{s}": f"SELECT f.*, f.file_date AS Day, g.n, g.span, g.far FROM fp{s} f JOIN (SELECT MMSI, file_date, count(*) n, {HRS('min(BaseDateTime)', 'max(BaseDateTime)')} span, "
        f"max({H('cla', 'clo', 'LAT', 'LON')}) far FROM (SELECT *, avg(LAT) OVER ({PART}) cla, avg(LON) OVER ({PART}) clo FROM later{s}) GROUP BY ALL) g "
        f"ON g.MMSI = f.MMSI AND g.file_date = f.file_date WHERE n >= 3 AND span >= 12 AND far < 5",
        f"hourly{s}": f"SELECT file_date, hour(BaseDateTime) AS h, MMSI, avg(LAT) la, avg(LON) lo, min(BaseDateTime) t0 FROM later{s} GROUP BY ALL HAVING count(*) >= 3",
        f"d_meet{s}": f"SELECT c.*, a.file_date AS Day, a.h, b.MMSI AS other, {H('a.la', 'a.lo', 'b.la', 'b.lo')} nm, (a.la + b.la) / 2 la, (a.lo + b.lo) / 2 lo "
        f"FROM hourly{s} a JOIN hourly{s} b ON a.file_date = b.file_date AND a.h = b.h AND a.MMSI < b.MMSI "
        f"JOIN clean{s} c ON c.MMSI = a.MMSI AND c.file_date = a.file_date AND c.BaseDateTime = a.t0 WHERE {H('a.la', 'a.lo', 'b.la', 'b.lo')} < 0.5",
        f"names{s}": f"SELECT MMSI, file_date, VesselName, row_number() OVER ({PART} ORDER BY t) i FROM "
        f"(SELECT MMSI, file_date, VesselName, min(BaseDateTime) t FROM later{s} WHERE VesselName IS NOT NULL GROUP BY ALL)",
        f"d_names{s}": f"SELECT f.*, f.file_date AS Day, g.n, g.l FROM fp{s} f JOIN (SELECT MMSI, file_date, count(*) n, string_agg(VesselName, ', ' ORDER BY i) l FROM names{s} GROUP BY ALL) g "
        f"ON g.MMSI = f.MMSI AND g.file_date = f.file_date WHERE n > 1",
        f"inzone{s}": f"SELECT *, 'Box' AS ZoneName FROM {{base}} WHERE {IN_BOX} UNION ALL SELECT *, 'Ring' FROM {{base}} WHERE {IN_CIRCLE} "
        f"UNION ALL SELECT *, 'Wedge' FROM {{base}} WHERE {IN_RING(WEDGE)} UNION ALL SELECT *, 'Cable' FROM {{base}} WHERE {LINE_M(CABLE)} <= 150".format(base=f"later{s}"),
        f"d_zone{s}": f"SELECT * EXCLUDE rn, file_date AS Day FROM (SELECT *, row_number() OVER (PARTITION BY MMSI, file_date, ZoneName ORDER BY BaseDateTime, LAT, LON) rn FROM inzone{s}) WHERE rn = 1",
    }


_ANOM_COLUMNS = "MMSI, VesselName, VesselType, LAT, LON, SOG, COG, Heading, BaseDateTime, Day"


def _anom(kind: str, rank: int, src: str, **extra: str) -> str:
    cols = {"RendezvousMMSI2": "CAST(NULL AS BIGINT)", "ZoneName": "CAST(NULL AS VARCHAR)", "gap": "CAST(NULL AS DOUBLE)",
            "knots": "CAST(NULL AS DOUBLE)", "turn": "CAST(NULL AS DOUBLE)", "NameCount": "CAST(NULL AS BIGINT)", "radius": "CAST(NULL AS DOUBLE)",
            "spell": "CAST(NULL AS DOUBLE)", "records": "CAST(NULL AS BIGINT)", "apart": "CAST(NULL AS DOUBLE)", "south": "CAST(NULL AS DOUBLE)", "east": "CAST(NULL AS DOUBLE)"} | extra
    return f"SELECT {_ANOM_COLUMNS}, '{kind}' AS AnomalyType, {rank} AS kr, {', '.join(f'{v} AS {k}' for k, v in cols.items())} FROM {src}"


def _zone_rows() -> str:
    cos = "cos(radians(24.5))"
    lat = [p[0] for p in WEDGE]
    lon = [p[1] for p in WEDGE]
    return (
        "(VALUES ('Box', 24.0, 24.3, -83.1, -82.6), "
        f"('Ring', 24.5 - 900.0 / 111000.0, 24.5 + 900.0 / 111000.0, -82.5 - 900.0 / (111000.0 * {cos}), -82.5 + 900.0 / (111000.0 * {cos})), "
        f"('Wedge', {min(lat)}, {max(lat)}, {min(lon)}, {max(lon)}), ('Cable', 24.99, 25.02, -82.01, -81.98)) z(zn, a, b, c, d)"
    )


def _CUT(line: str) -> str:
    """One round of corner cutting of a list; lists of one value stay."""
    return (
        f"CASE WHEN len({line}) < 2 THEN {line} ELSE list_concat(flatten(list_transform(range(1, len({line})), "
        f"lambda k: [{line}[k] * 0.75 + {line}[k + 1] * 0.25, {line}[k] * 0.25 + {line}[k + 1] * 0.75])), [{line}[-1]]) END"
    )


def _all_anoms(s: str = "") -> str:
    return " UNION ALL ".join(
        [
            _anom("AIS_Beacon_On", 1, f"d_on{s}", gap="gap"),
            _anom("AIS_Beacon_Off", 2, f"d_off{s}", gap="gap"),
            _anom("Speed", 3, f"d_speed{s}", knots="nm / (mins / 60)"),
            _anom("Course", 4, f"d_course{s}", turn="turn"),
            _anom("Loitering", 5, f"d_loiter{s}", radius="far", spell="span", records="n"),
            _anom("Rendezvous", 6, f"d_meet{s}", RendezvousMMSI2="other", apart="nm"),
            _anom("Identity_Spoofing", 7, f"d_names{s}", NameCount="n"),
            f"SELECT z.* REPLACE (b.b_south AS south, b.b_east AS east) FROM ({_anom('Zone_Violation', 8, f'd_zone{s}', ZoneName='ZoneName')}) z "
            f"JOIN (SELECT zn, a AS b_south, d AS b_east FROM {_zone_rows()}) b ON b.zn = z.ZoneName",
        ]
    )


PARTS: dict[str, str] = {
    "pings": PINGS_SQL.format(v="user_id"),
    "dense": PINGS_SQL.format(v="user_id % 10"),
    "raw": RAW_SQL,
    **detector_parts("pings"),
    **detector_parts("dense", "_n"),
    "odd": "SELECT * REPLACE (CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 0 WHEN event_id % 23 = 0 THEN 100 ELSE VesselType END AS VesselType) FROM pings",
    **detector_parts("odd", "_t"),
    "clean_t": "SELECT * FROM odd WHERE LAT BETWEEN -90 AND 90 AND LON BETWEEN -180 AND 180 AND SOG <= 102 AND (VesselType BETWEEN 20 AND 24 OR VesselType BETWEEN 30 AND 64 "
    "OR VesselType BETWEEN 69 AND 74 OR VesselType BETWEEN 79 AND 84 OR VesselType BETWEEN 89 AND 94)",
    "anom": _all_anoms(),
    "anom_t": _all_anoms("_t"),
    "minfo": "SELECT v.MMSI, n.VesselName AS InfoName, t.VesselType AS InfoType FROM (SELECT DISTINCT MMSI FROM pings) v "
    "LEFT JOIN (SELECT MMSI, VesselName FROM (SELECT MMSI, VesselName, row_number() OVER (PARTITION BY MMSI ORDER BY count(*) DESC, VesselName) r FROM pings WHERE VesselName IS NOT NULL GROUP BY MMSI, VesselName) WHERE r = 1) n USING (MMSI) "
    "LEFT JOIN (SELECT MMSI, VesselType FROM (SELECT MMSI, VesselType, row_number() OVER (PARTITION BY MMSI ORDER BY count(*) DESC, VesselType) r FROM pings WHERE VesselType IS NOT NULL GROUP BY MMSI, VesselType) WHERE r = 1) t USING (MMSI)",
    "shifted": "SELECT MMSI, AnomalyType, VesselName, VesselType, LAT, LON, COG, Heading, CASE WHEN MMSI % 2 = 0 THEN SOG END AS SOG, "
    "BaseDateTime + to_microseconds((MMSI % 7) * 3600000000 - 9000000000) AS BaseDateTime, row_number() OVER () AS id FROM anom",
    "matched": "SELECT * EXCLUDE rn FROM (SELECT a.*, p.BaseDateTime AS mt, p.LAT AS mlat, p.SOG AS msog, p.COG AS mcog, p.Heading AS mhead, "
    "row_number() OVER (PARTITION BY a.id ORDER BY abs(epoch_us(p.BaseDateTime) - epoch_us(a.BaseDateTime)), p.BaseDateTime) rn "
    "FROM shifted a JOIN pings p ON p.MMSI = a.MMSI) WHERE rn = 1",
}


def _track_parts(src: str, s: str = "") -> dict[str, str]:
    return {
        f"steps{s}": f"SELECT *, lag(BaseDateTime) OVER (PARTITION BY MMSI ORDER BY BaseDateTime, LAT, LON) AS pt, "
        f"row_number() OVER (PARTITION BY MMSI ORDER BY BaseDateTime, LAT, LON) - 1 AS pos FROM {src} WHERE BaseDateTime IS NOT NULL",
        f"numbered{s}": f"SELECT *, CAST(sum(CASE WHEN {HRS('pt', 'BaseDateTime')} > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY MMSI ORDER BY BaseDateTime, LAT, LON ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM steps{s}",
        f"segs{s}": f"SELECT MMSI, segment_id, count(*) AS points, min(BaseDateTime) AS t0, max(BaseDateTime) AS t1, {HRS('min(BaseDateTime)', 'max(BaseDateTime)')} AS span FROM numbered{s} GROUP BY ALL",
        f"tracks{s}": f"SELECT n.* FROM numbered{s} n JOIN segs{s} g ON g.MMSI = n.MMSI AND g.segment_id = n.segment_id WHERE g.points >= 2 AND g.span >= 1",
        f"moves{s}": f"SELECT *, {HRS('lag(BaseDateTime) OVER ' + WC, 'BaseDateTime')} AS dt, SOG - lag(SOG) OVER {WC} AS dv, "
        f"{WRAP('COG - lag(COG) OVER ' + WC)} AS dc, {H('lag(LAT) OVER ' + WC, 'lag(LON) OVER ' + WC, 'LAT', 'LON', 3440.065)} AS nm, "
        f"row_number() OVER {WC} - 1 AS k, row_number() OVER (PARTITION BY MMSI, segment_id ORDER BY BaseDateTime DESC, LAT DESC, LON DESC) AS back FROM tracks{s}",
    }


PARTS |= _track_parts("pings") | _track_parts("dense", "_n")
PARTS |= {
    "starts": f"SELECT MMSI, segment_id, min(BaseDateTime) AS t0, max(BaseDateTime) AS t1, {HRS('min(BaseDateTime)', 'max(BaseDateTime)')} AS span FROM traj GROUP BY ALL",
    "traj": "SELECT * FROM tracks_n WHERE SOG IS NULL OR SOG <= 100",
    "plan": "SELECT *, 6 AS slide, CASE WHEN span < 24 THEN 1 ELSE CAST(floor((span - 24) / 6) AS BIGINT) + 1 END AS wins FROM starts",
    "wins": "SELECT MMSI, segment_id, t0, t1, span, slide, unnest(range(wins)) AS window_no FROM plan",
    "wpoints": "SELECT w.window_no, t.* FROM wins w JOIN traj t ON t.MMSI = w.MMSI AND t.segment_id = w.segment_id "
    "WHERE w.span < 24 OR (epoch_us(t.BaseDateTime) - epoch_us(w.t0) >= w.window_no * w.slide * 3600000000 AND epoch_us(t.BaseDateTime) - epoch_us(w.t0) < (w.window_no * w.slide + 24) * 3600000000)",
    "ends": "SELECT MMSI, segment_id, window_no, count(*) AS length, max(BaseDateTime) AS last_known_time FROM wpoints GROUP BY ALL HAVING count(*) >= 2",
    "seqs": "SELECT * EXCLUDE rn FROM (SELECT e.*, t.BaseDateTime AS prediction_time, t.LAT AS target_lat, t.LON AS target_lon, t.SOG AS target_sog, t.COG AS target_cog, "
    "row_number() OVER (PARTITION BY e.MMSI, e.segment_id, e.window_no ORDER BY abs(epoch_us(t.BaseDateTime) - epoch_us(e.last_known_time) - 172800000000), t.BaseDateTime) AS rn "
    "FROM ends e JOIN traj t ON t.MMSI = e.MMSI AND t.segment_id = e.segment_id AND t.BaseDateTime > e.last_known_time) WHERE rn = 1",
    "spoints": "SELECT w.*, row_number() OVER (PARTITION BY w.MMSI, w.segment_id, w.window_no ORDER BY w.BaseDateTime, w.LAT, w.LON) - 1 AS i "
    "FROM wpoints w JOIN seqs s ON s.MMSI = w.MMSI AND s.segment_id = w.segment_id AND s.window_no = w.window_no",
    "sized": "SELECT *, max(length) OVER (PARTITION BY bin, batch) AS padded_length FROM batches",
    "batched": "SELECT *, CASE WHEN length <= 8 THEN 0 WHEN length <= 20 THEN 1 WHEN length <= 50 THEN 2 WHEN length <= 100 THEN 3 WHEN length <= 200 THEN 4 ELSE 5 END AS bin FROM seqs",
    "batches": "SELECT *, (row_number() OVER (PARTITION BY bin ORDER BY MMSI, segment_id, window_no) - 1) // 32 AS batch FROM batched",
    "scored": "SELECT s.*, t.LAT + 0.01 AS lat, t.LON - 0.01 AS lon, 0.02 + s.length * 0.005 AS std_lat, 0.03 AS std_lon, t.SOG + 25 AS speed, t.COG AS course, t.COG + 40 AS last_course "
    "FROM seqs s JOIN traj t ON t.MMSI = s.MMSI AND t.segment_id = s.segment_id AND t.BaseDateTime = s.last_known_time",
    "recent": "SELECT * FROM (SELECT *, max(BaseDateTime) OVER (PARTITION BY MMSI) AS mx FROM pings) WHERE BaseDateTime >= mx - INTERVAL 24 HOUR "
    "QUALIFY count(*) OVER (PARTITION BY MMSI) >= 2",
}
PARTS |= _track_parts("recent", "_r")
PARTS |= {
    "context": "SELECT MMSI, list(LAT ORDER BY BaseDateTime, LAT DESC, LON DESC) AS lats, list(LON ORDER BY BaseDateTime, LAT DESC, LON DESC) AS lons "
    "FROM (SELECT *, max(segment_id) OVER (PARTITION BY MMSI) AS newest FROM tracks_r) WHERE segment_id = newest GROUP BY MMSI",
    "drifted": "WITH RECURSIVE w AS (SELECT MMSI, 0 AS step, lats, lons FROM context UNION ALL SELECT MMSI, step + 1, "
    "list_append(lats, lats[-1] + (lats[-1] - lats[1]) / greatest(1, len(lats) - 1))[-24:], list_append(lons, lons[-1] + (lons[-1] - lons[1]) / greatest(1, len(lons) - 1))[-24:] "
    "FROM w WHERE step < 8) SELECT * FROM w",
    "known": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY MMSI ORDER BY segment_id DESC, BaseDateTime DESC) AS rn FROM tracks_r) WHERE rn = 1",
    "guess": "WITH RECURSIVE g AS (SELECT MMSI, 0 AS step, LAT AS lat, LON AS lon, coalesce(SOG, 0) AS speed, coalesce(COG, Heading, 0) AS course FROM known "
    "UNION ALL SELECT MMSI, step + 1, lat + speed * 6 / 60 * cos(radians(course)), lon + speed * 6 / (60 * cos(radians(lat))) * sin(radians(course)), speed, course FROM g WHERE step < 8) "
    "SELECT *, step * 0.05 AS std_lat, step * 0.05 AS std_lon FROM g WHERE step > 0",
    "cfix": "SELECT g.MMSI, g.step, g.lat, g.lon, g.speed, CASE WHEN g.MMSI % 2 = 0 THEN g.course END AS course, CASE WHEN g.MMSI % 5 <> 0 THEN g.step * 8.0 END AS std_lat, g.step * 8.0 AS std_lon, "
    "k.LAT AS llat, k.LON AS llon, k.SOG AS lsog, coalesce(k.COG, k.Heading) AS lcourse, "
    "coalesce(lag(g.lat) OVER (PARTITION BY g.MMSI ORDER BY g.step), k.LAT) AS plat, coalesce(lag(g.lon) OVER (PARTITION BY g.MMSI ORDER BY g.step), k.LON) AS plon "
    "FROM guess g JOIN known k ON k.MMSI = g.MMSI",
    "cplan": "SELECT MMSI, step, lat, lon, llat, llon, coalesce(course, CASE WHEN step = 1 THEN lcourse END, (degrees("
    + BEARING("plat", "plon", "lat", "lon")
    + ") + 360) % 360) AS course, least(45.0, coalesce((std_lat + std_lon) / 2 * 0.5, 2.0) * step / 8) AS spread, least(500.0, coalesce(speed, lsog, 10) * 6) AS dist FROM cfix",
    "cone": "WITH RECURSIVE c AS (SELECT DISTINCT MMSI, 0 AS step, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS course, CAST(NULL AS DOUBLE) AS spread, CAST(NULL AS DOUBLE) AS dist, llat AS pla, llon AS plo, llat AS sla, llon AS slo FROM cplan "
    "UNION ALL SELECT MMSI, step, lat, lon, course, spread, dist, CASE WHEN pok THEN pa ELSE lat END, CASE WHEN pok THEN po ELSE lon END, CASE WHEN sok THEN sa ELSE lat END, CASE WHEN sok THEN so ELSE lon END FROM "
    "(SELECT *, pa BETWEEN -90 AND 90 AND po BETWEEN -180 AND 180 AS pok, sa BETWEEN -90 AND 90 AND so BETWEEN -180 AND 180 AS sok FROM "
    "(SELECT p.*, c.pla + p.dist / 60 * cos(radians(p.course - p.spread)) AS pa, c.plo + p.dist / (60 * cos(radians(c.pla))) * sin(radians(p.course - p.spread)) AS po, "
    "c.sla + p.dist / 60 * cos(radians(p.course + p.spread)) AS sa, c.slo + p.dist / (60 * cos(radians(c.sla))) * sin(radians(p.course + p.spread)) AS so "
    "FROM c JOIN cplan p ON p.MMSI = c.MMSI AND p.step = c.step + 1))) SELECT * FROM c WHERE step > 0",
}


def compose(body: str) -> str:
    """Puts the named parts a query mentions in front of it, in order of need."""
    order: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", text):
            if word in PARTS and word not in order:
                need(PARTS[word])
                if word not in order:
                    order.append(word)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in order) + "\n" + body


A_OUT = f"{P()}, AnomalyType, {DT('Day', 'Date')}, {DT('Day', 'ReportDate')}, coalesce(RendezvousMMSI2, -1) AS RendezvousMMSI2, ZoneName"
COUNTS = ", ".join(f"count(*) FILTER (AnomalyType = '{t}') AS {t}" for t in TYPES)
CUSTOMER = ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']
NULLS = ["MMSI", "VesselName", "VesselType", "LAT", "LON", "SOG", "COG", "Heading", "BaseDateTime", "file_date", "Length"]
BOUNDS = {
    "Box": (24.0, 24.3, -83.1, -82.6),
    "Ring": (24.5, -82.5, 900.0),
}


def _null_counts(skip: set[str]) -> str:
    return ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in NULLS if c not in skip)


def _quant(p: float, c: str, name: str) -> str:
    return R(f"quantile_cont(CAST({c} AS DOUBLE), {p})", name)


def _vstats(extra: str = "") -> str:
    counts = ", ".join(
        f"coalesce(a.{t}, 0) AS Anomaly_{t}" for t in ANOMALY_LABELS
    )
    return (
        f"SELECT p.MMSI, p.n AS Total_Records, coalesce(f.VesselName, 'Unknown') AS VesselName, k.VesselType AS VesselType, {TS('p.t0', 'First_Seen')}, {TS('p.t1', 'Last_Seen')}, "
        f"{R('p.a', 'Avg_Speed')}, {R('p.x', 'Max_Speed')}, {R('p.i', 'Min_Speed')}, {R('p.la0', 'Min_Latitude')}, {R('p.la1', 'Max_Latitude')}, {R('p.lo0', 'Min_Longitude')}, {R('p.lo1', 'Max_Longitude')}, "
        f"CAST(floor((epoch_us(p.t1) - epoch_us(p.t0)) / 86400000000.0) AS BIGINT) + 1 AS Days_Active, coalesce(a.n, 0) AS Anomaly_Count, {counts} "
        f"FROM (SELECT MMSI, count(*) n, min(BaseDateTime) t0, max(BaseDateTime) t1, avg(SOG) a, max(SOG) x, min(SOG) i, min(LAT) la0, max(LAT) la1, min(LON) lo0, max(LON) lo1 FROM pings GROUP BY MMSI) p "
        f"LEFT JOIN (SELECT MMSI, count(*) n, {COUNTS} FROM anom GROUP BY MMSI) a ON a.MMSI = p.MMSI "
        f"LEFT JOIN (SELECT * FROM (SELECT MMSI, VesselName, row_number() OVER (PARTITION BY MMSI ORDER BY BaseDateTime) r FROM pings WHERE VesselName IS NOT NULL) WHERE r = 1) f ON f.MMSI = p.MMSI "
        f"LEFT JOIN (SELECT * FROM (SELECT MMSI, VesselType, row_number() OVER (PARTITION BY MMSI ORDER BY BaseDateTime) r FROM pings) WHERE r = 1) k ON k.MMSI = p.MMSI"
    )


_SEQ = f"MMSI, segment_id, window_no, length, {TS('last_known_time')}, {TS('prediction_time')}, {R('target_lat')}, {R('target_lon')}, {R('target_sog')}, {R('target_cog')}"
_T = f"MMSI, segment_id, {TS('BaseDateTime')}, {R('LAT')}, {R('LON')}"


def _losses() -> str:
    def nll(side: str) -> str:
        return f"(0.5 * ln(2 * pi() * std_{side} * std_{side}) + 0.5 * pow(target_{side} - {side}, 2) / (std_{side} * std_{side}))"

    turn = "least(abs(course - last_course), 360 - abs(course - last_course)) / 48.0"
    return (
        "SELECT "
        + ", ".join(R(f"{c}", f"{c}_loss") for c in ("position", "speed", "course", "uncertainty", "physics"))
        + ", "
        + R("position + speed * 0.5 + course * 0.5 + uncertainty * 0.3 + physics * 0.2", "total_loss")
        + " FROM (SELECT (avg(pow(lat - target_lat, 2)) + avg(pow(lon - target_lon, 2))) / 2 AS position, avg(pow(speed - target_sog, 2)) AS speed, "
        f"avg(1 - cos(radians(course - target_cog))) AS course, avg({nll('lat')} + {nll('lon')}) AS uncertainty, "
        f"(avg(greatest(speed - 30, 0)) + avg(greatest({turn} - 0.5, 0))) / 2 AS physics FROM scored)"
    )


def _circular(c: str, p: str) -> str:
    return (
        f"{R(f'CASE WHEN sqrt(s{p} * s{p} + c{p} * c{p}) > 1e-6 THEN CASE WHEN degrees(atan2(s{p}, c{p})) < 0 THEN degrees(atan2(s{p}, c{p})) + 360 ELSE degrees(atan2(s{p}, c{p})) END END', f'{c}_mean')}, "
        f"{R(f'1 - sqrt(s{p} * s{p} + c{p} * c{p})', f'{c}_variance')}, {R(f'sqrt(s{p} * s{p} + c{p} * c{p})', f'{c}_consistency')}, "
        f"{R(f'CASE WHEN sqrt(s{p} * s{p} + c{p} * c{p}) > 1e-6 THEN degrees(sqrt(greatest(0, -2 * ln(sqrt(s{p} * s{p} + c{p} * c{p}))))) END', f'{c}_std')}"
    )


def _features() -> str:
    return (
        f"SELECT MMSI, segment_id, points, {', '.join(R(c) for c in ('last_lat', 'last_lon', 'lat_mean', 'lon_mean', 'lat_std', 'lon_std', 'sog_mean', 'sog_std', 'sog_max', 'sog_min', 'sog_last', 'sog_trend'))}, "
        f"{_circular('cog', '1')}, {R('cog_last')}, {_circular('heading', '2')}, {R('heading_last')}, "
        + ", ".join(R(f"{m}_{x}") for m in ("acceleration", "rate_of_turn") for x in ("mean", "max", "std"))
        + f", {R('d1', 'distance_total_nm')}, {R('d2', 'distance_mean_nm')}, {R('d3', 'distance_std_nm')}, {R('hour_mean')}, {R('hour_std')}, hour_last, {R('dow', 'day_of_week_mean')}, dow_last AS day_of_week_last, "
        f"{R('time_span_hours')}, {R('since', 'time_since_last_hours')}, vessel_type FROM (SELECT MMSI, segment_id, count(*) AS points, "
        "max(LAT) FILTER (back = 1) AS last_lat, max(LON) FILTER (back = 1) AS last_lon, avg(LAT) AS lat_mean, avg(LON) AS lon_mean, stddev_samp(LAT) AS lat_std, stddev_samp(LON) AS lon_std, "
        "avg(SOG) AS sog_mean, stddev_samp(SOG) AS sog_std, max(SOG) AS sog_max, min(SOG) AS sog_min, max(SOG) FILTER (back = 1) AS sog_last, regr_slope(SOG, k) AS sog_trend, "
        "avg(sin(radians(COG))) AS s1, avg(cos(radians(COG))) AS c1, avg(sin(radians(Heading))) AS s2, avg(cos(radians(Heading))) AS c2, "
        "arg_max(COG, BaseDateTime) FILTER (COG IS NOT NULL) AS cog_last, arg_max(Heading, BaseDateTime) FILTER (Heading IS NOT NULL) AS heading_last, "
        "avg(dv / dt) AS acceleration_mean, max(abs(dv / dt)) AS acceleration_max, stddev_samp(dv / dt) AS acceleration_std, "
        "avg(dc / dt) AS rate_of_turn_mean, max(abs(dc / dt)) AS rate_of_turn_max, stddev_samp(dc / dt) AS rate_of_turn_std, "
        "sum(nm) AS d1, avg(nm) AS d2, stddev_pop(nm) AS d3, avg(hour(BaseDateTime)) AS hour_mean, stddev_samp(hour(BaseDateTime)) AS hour_std, max(hour(BaseDateTime)) FILTER (back = 1) AS hour_last, "
        "avg(isodow(BaseDateTime) - 1) AS dow, max(isodow(BaseDateTime) - 1) FILTER (back = 1) AS dow_last, "
        f"{HRS('min(BaseDateTime)', 'max(BaseDateTime)')} AS time_span_hours, max(dt) FILTER (back = 1) AS since, max(VesselType) FILTER (k = 0) AS vessel_type FROM moves GROUP BY MMSI, segment_id) WHERE points >= 2"
    )


PARTS |= {
    "hourpings": "SELECT * REPLACE (date_trunc('hour', BaseDateTime) AS BaseDateTime) FROM pings",
    "hoursteps": "SELECT *, lag(BaseDateTime) OVER (PARTITION BY MMSI ORDER BY BaseDateTime) AS pt FROM hourpings",
    "hournumbered": f"SELECT *, CAST(sum(CASE WHEN {HRS('pt', 'BaseDateTime')} > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY MMSI ORDER BY BaseDateTime ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM hoursteps",
    "hoursegs": f"SELECT MMSI, segment_id, min(BaseDateTime) t0, max(BaseDateTime) t1 FROM hournumbered GROUP BY ALL HAVING count(*) >= 2 AND {HRS('min(BaseDateTime)', 'max(BaseDateTime)')} >= 1",
    "hourgrid": "SELECT MMSI, segment_id, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS t FROM hoursegs",
    "hourpoints": "SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY n.MMSI, n.segment_id, n.BaseDateTime ORDER BY LAT, LON, SOG, COG, Heading, VesselName, VesselType) r FROM hournumbered n) WHERE r = 1",
}


def _exact_grid() -> str:
    def at(c: str) -> str:
        return R(
            f"CASE WHEN b.BaseDateTime IS NULL OR a.BaseDateTime = b.BaseDateTime THEN a.{c} ELSE a.{c} + (b.{c} - a.{c}) * {HRS('a.BaseDateTime', 'g.t')} / {HRS('a.BaseDateTime', 'b.BaseDateTime')} END",
            c,
        )

    return (
        f"SELECT g.MMSI, g.segment_id, {TS('g.t', 'BaseDateTime')}, {', '.join(at(c) for c in ('LAT', 'LON', 'SOG', 'COG'))}, a.VesselType AS VesselType FROM hourgrid g "
        "ASOF LEFT JOIN hourpoints a ON a.MMSI = g.MMSI AND a.segment_id = g.segment_id AND g.t >= a.BaseDateTime "
        "ASOF LEFT JOIN hourpoints b ON b.MMSI = g.MMSI AND b.segment_id = g.segment_id AND g.t <= b.BaseDateTime"
    )


def _linear_grid() -> str:
    def at(c: str) -> str:
        return R(
            f"CASE WHEN b.BaseDateTime IS NULL OR a.BaseDateTime = b.BaseDateTime THEN a.{c} ELSE a.{c} + (b.{c} - a.{c}) * {HRS('a.BaseDateTime', 'g.t')} / {HRS('a.BaseDateTime', 'b.BaseDateTime')} END",
            c,
        )

    return (
        "SELECT g.MMSI, g.segment_id, " + TS("g.t", "BaseDateTime") + f", {', '.join(at(c) for c in ('LAT', 'LON', 'SOG', 'COG'))}, a.VesselName AS VesselName "
        "FROM (SELECT MMSI, segment_id, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS t FROM segs WHERE points >= 2 AND span >= 1) g "
        "ASOF LEFT JOIN tracks a ON a.MMSI = g.MMSI AND a.segment_id = g.segment_id AND g.t >= a.BaseDateTime "
        "ASOF LEFT JOIN tracks b ON b.MMSI = g.MMSI AND b.segment_id = g.segment_id AND g.t <= b.BaseDateTime"
    )


def _paths(keys: str) -> str:
    order = "ORDER BY BaseDateTime, LAT, LON"
    return (
        f"SELECT {keys.replace('file_date', DT('file_date'))}, count(*) AS points, max(VesselName) FILTER (a = 1) AS VesselName, max(VesselType) FILTER (a = 1) AS VesselType, "
        f"{TS('min(BaseDateTime)', 'start')}, {R('max(LAT) FILTER (a = 1)', 'start_lat')}, {R('max(LON) FILTER (a = 1)', 'start_lon')}, "
        f"{TS('max(BaseDateTime)', 'end')}, {R('max(LAT) FILTER (z = 1)', 'end_lat')}, {R('max(LON) FILTER (z = 1)', 'end_lon')} FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY {keys} {order}) a, row_number() OVER (PARTITION BY {keys} ORDER BY BaseDateTime DESC, LAT DESC, LON DESC) z FROM pings) GROUP BY {keys}"
    )


_EMPTY_MULTI = NAMES(ANOMALY_REPORT_NAMES, "AnomalyType", "AnomalyType")

BODIES: dict[str, str] = {
    # detectors
    "beacon_on": f"SELECT {P()}, {STAMP('AIS_Beacon_On', False, True, False, 'Day')}, true AS BeaconAnomaly, {R('gap', 'BeaconGapMinutes')} FROM d_on",
    "beacon_off": f"SELECT {P()}, {STAMP('AIS_Beacon_Off', False, True, False, 'Day')}, true AS BeaconAnomaly, {R('gap', 'BeaconGapMinutes')} FROM d_off",
    "speed_jump": f"SELECT {P()}, {STAMP('Speed', True, False, False, 'Day')}, {R('nm', 'Distance')}, {R('mins', 'TimeDiff')}, {R('nm / (mins / 60)', 'ImpliedSpeed')} FROM d_speed",
    "course_heading": f"SELECT {P()}, {STAMP('Course', False, False, True, 'Day')}, {R('turn', 'CourseHeadingDiff')} FROM d_course",
    "loitering": f"SELECT {P()}, {STAMP('Loitering', False, True, False, 'Day')}, {R('far', 'LoiteringRadiusNM')}, {R('span', 'LoiteringDurationHours')}, n AS LoiteringRecordCount FROM d_loiter",
    "rendezvous": f"SELECT {P()}, {STAMP('Rendezvous', False, True, False, 'Day')}, h AS TimeWindow, other AS RendezvousMMSI2, {R('nm', 'RendezvousDistanceNM')}, {R('la', 'RendezvousLat')}, {R('lo', 'RendezvousLon')} FROM d_meet_n",
    "identity_spoofing": f"SELECT {P()}, {STAMP('Identity_Spoofing', False, False, False, 'Day')}, 'multiple_vessel_names' AS SpoofingIssue, n AS NameCount, l AS VesselNames FROM d_names",
    "zone_violations": f"SELECT {P()}, {STAMP('Zone_Violation', False, True, False, 'Day')}, ZoneName, {R('a', 'ZoneLatMin')}, {R('b', 'ZoneLatMax')}, {R('c', 'ZoneLonMin')}, {R('d', 'ZoneLonMax')} FROM d_zone JOIN {_zone_rows()} ON zn = ZoneName",
    "union_anomalies": f"SELECT {A_OUT}, {R('gap', 'BeaconGapMinutes')}, {R('knots', 'ImpliedSpeed')}, {R('turn', 'CourseHeadingDiff')}, coalesce(NameCount, -1) AS NameCount, {R('radius', 'LoiteringRadiusNM')}, {R('spell', 'LoiteringDurationHours')}, coalesce(records, -1) AS LoiteringRecordCount, "
    f"{R('apart', 'RendezvousDistanceNM')}, {R('south', 'ZoneLatMin')}, {R('east', 'ZoneLonMax')} FROM anom",
    "detect_anomalies": f"SELECT {A_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY MMSI ORDER BY Day, kr, BaseDateTime, LAT, LON, RendezvousMMSI2, ZoneName) rn FROM anom "
    "WHERE LAT BETWEEN 24.2 AND 32.6 AND (hour(BaseDateTime) >= 22 OR hour(BaseDateTime) < 18)) WHERE rn <= 3",
    "detect_anomalies_default_types": f"SELECT {A_OUT} FROM anom_t",
    # sources
    "scan_days": f"SELECT {P()}, {DT('file_date')}, {R('CAST(CASE WHEN MMSI % 2 = 1 THEN MMSI % 100 END AS DOUBLE)', 'Length')} FROM pings WHERE file_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
    "file_report": f"SELECT {DT('file_date')}, 'csv' AS format, 9 - (MMSI % 3 = 1)::INT + (MMSI % 3 = 2)::INT AS columns, CASE WHEN MMSI % 3 = 1 THEN 'SOG' ELSE '' END AS lacking, "
    "1 AS files, 0 AS broken FROM pings WHERE file_date BETWEEN DATE '2024-01-04' AND DATE '2024-01-25' GROUP BY file_date, MMSI % 3",
    "read_pings": f"SELECT MMSI, VesselName, CASE WHEN VesselType <> 52 THEN VesselType ELSE -1 END AS VesselType, {R('LAT')}, {R('LON')}, {R('CASE WHEN SOG <> 150 THEN SOG END', 'SOG')}, {R('COG')}, "
    f"{R('CASE WHEN Heading <> 90 THEN Heading END', 'Heading')}, {TS('CASE WHEN MMSI % 7 <> 0 THEN BaseDateTime END', 'BaseDateTime')}, {DT('file_date')} FROM raw",
    "ingest_daily_csv": f"SELECT {P()}, {DT('file_date')} FROM pings",
    "ingest_stream": f"SELECT {P()}, {DT('file_date')} FROM pings",
    # The watermark ends one hour behind the newest ping; a silence is noticed, and a track closes, six hours after its last ping.
    "stream_gap_alerts": f"SELECT MMSI, kind, {TS('t', 'last_time')}, {R('LAT')}, {R('LON')}, {TS('alert', 'alert_time')}, {R(HRS('t', 'alert'), 'silence_hours')} FROM ("
    "SELECT *, unnest([struct_pack(kind := 'silent', alert := t + INTERVAL 6 HOUR), struct_pack(kind := 'back', alert := nt)], recursive := true) FROM ("
    "SELECT MMSI, LAT, LON, BaseDateTime AS t, lead(BaseDateTime) OVER (PARTITION BY MMSI ORDER BY BaseDateTime, LAT, LON) AS nt, max(BaseDateTime) OVER () AS newest FROM pings) "
    "WHERE coalesce(nt, newest - INTERVAL 1 HOUR) > t + INTERVAL 6 HOUR) WHERE alert IS NOT NULL",
    "stream_tracks": f"SELECT MMSI, {TS('t0', 'start')}, {TS('t1', 'end')}, points, {R('span', 'span_hours')} FROM segs WHERE points >= 2 AND span >= 1 "
    "AND t1 + INTERVAL 6 HOUR < (SELECT max(BaseDateTime) - INTERVAL 1 HOUR FROM pings)",
    "read_history": f"SELECT {P()}, {DT('file_date')} FROM pings WHERE file_date >= DATE '2024-01-10'",
    "load_cached_range": f"SELECT {P()} FROM pings WHERE BaseDateTime >= TIMESTAMP '2024-01-03' AND BaseDateTime < TIMESTAMP '2024-01-13' AND VesselType IN (30, 52, 70)",
    "load_full_range": f"SELECT {P()} FROM pings WHERE BaseDateTime >= TIMESTAMP '2024-01-02' AND BaseDateTime < TIMESTAMP '2024-01-10'",
    "write_day_cache": f"SELECT {P()}, {DT('file_date')} FROM raw WHERE LAT BETWEEN -90 AND 90 AND LON BETWEEN -180 AND 180 AND SOG <= 102",
    "history_cache": f"SELECT {P().replace('coalesce(VesselType, -1)', 'coalesce(VesselType, 0)')}, {DT('file_date')}, {R('coalesce(Length, 0)', 'Length')} FROM raw WHERE BaseDateTime IS NOT NULL AND LAT BETWEEN -90 AND 90 AND NOT (LAT = 0 AND LON = 0) AND (SOG IS NULL OR SOG <= 100) AND COG <= 360 AND file_date > DATE '2024-01-10'",
    "cache_inventory": "SELECT count(DISTINCT file_date) AS files, true AS megabytes_right FROM pings",
    "append_consolidated": f"SELECT {P()} FROM (SELECT * FROM pings WHERE event_id % 3 = 0 UNION ALL SELECT * REPLACE (SOG + 1 AS SOG) FROM pings WHERE event_id % 2 = 0 AND event_id % 3 <> 0)",
    "append_indexed": f"SELECT {P()} FROM (SELECT * FROM pings WHERE event_id % 3 = 0 UNION ALL SELECT * REPLACE (SOG + 1 AS SOG) FROM pings WHERE event_id % 2 = 0 AND event_id % 3 <> 0)",
    "possible_repeats": f"SELECT {DT('file_date')}, count(*) AS asked, count(*) FILTER (EXISTS (SELECT 1 FROM pings o WHERE o.event_id % 3 = 0 AND o.MMSI = n.MMSI AND o.BaseDateTime = n.BaseDateTime)) AS repeats, "
    "0 AS missed FROM (SELECT DISTINCT file_date, MMSI, BaseDateTime FROM pings WHERE event_id % 2 = 0) n GROUP BY file_date",
    "vessel_set_totals": f"SELECT {DT('d.file_date', 'file_date')}, count(*) AS records, count(DISTINCT p.MMSI) AS vessels FROM (SELECT DISTINCT file_date FROM pings) d "
    "JOIN pings p ON p.file_date BETWEEN d.file_date - INTERVAL 6 DAY AND d.file_date GROUP BY d.file_date",
    "vessel_set_range": "SELECT count(DISTINCT file_date) AS days, count(*) AS records, count(DISTINCT MMSI) AS vessels FROM pings WHERE file_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-12'",
    "vessel_set_changes": f"SELECT {DT('d', 'file_date')}, count(*) FILTER (c AND NOT b) AS new_vessels, count(*) FILTER (b AND NOT c) AS lost_vessels, count(*) FILTER (b AND c) AS common_vessels FROM ("
    "SELECT d, MMSI, bool_or(f = d) AS c, bool_or(f < d) AS b FROM (SELECT file_date AS d, lag(file_date) OVER (ORDER BY file_date) AS l FROM (SELECT DISTINCT file_date FROM pings)) t "
    "JOIN (SELECT DISTINCT file_date AS f, MMSI FROM pings) p ON p.f IN (t.d, t.l) WHERE l IS NOT NULL GROUP BY d, MMSI) GROUP BY d",
    "consolidate": f"SELECT {P()} FROM (SELECT * FROM pings WHERE event_id % 3 = 0 UNION ALL SELECT * REPLACE (SOG + 1 AS SOG) FROM pings WHERE event_id % 2 = 0 AND event_id % 3 <> 0)",
    "write_anomalies": f"SELECT {A_OUT} FROM anom",
    "load_anomalies": f"SELECT {A_OUT} FROM anom",
    "export_dataset": f"SELECT {P()}, {DT('file_date')} FROM pings",
    "write_statistics": f"SELECT {DT('Day', 'day')}, a.MMSI, a.AnomalyType, {R('a.LAT', 'LAT')}, {R('a.LON', 'LON')}, {R('a.SOG', 'SOG')}, c.n AS Count FROM anom a JOIN (SELECT AnomalyType, count(*) AS n FROM anom GROUP BY AnomalyType) c ON c.AnomalyType = a.AnomalyType",
    "save_sequences": f"SELECT {_SEQ} FROM seqs",
    # filters
    "clean_positions": f"SELECT {P()} FROM raw WHERE LAT BETWEEN -90 AND 90 AND LON BETWEEN -180 AND 180 AND SOG <= 102",
    "filter_vessel_types": f"SELECT {P()}, VesselType // 10 * 10 AS MainVesselType FROM raw WHERE VesselType // 10 * 10 IN (70, 80)",
    "filter_vessel_types_exact": f"SELECT {P()} FROM raw WHERE VesselType IN (31, 71)",
    "filter_vessel_types_cached": f"SELECT {P()} FROM pings WHERE VesselType // 10 * 10 = 60",
    "filter_anomaly_types": f"SELECT {A_OUT} FROM anom WHERE AnomalyType IN ('Speed', 'Course')",
    "filter_geo_box": f"SELECT {A_OUT} FROM anom WHERE LAT BETWEEN 24.0 AND 24.6 AND LON BETWEEN -83.0 AND -82.4",
    "filter_hours": f"SELECT {A_OUT} FROM anom WHERE hour(BaseDateTime) >= 22 OR hour(BaseDateTime) < 4",
    "filter_mmsi": f"SELECT {A_OUT} FROM anom WHERE MMSI IN (366000001, 366000005, 366000007)",
    "cap_per_vessel": f"SELECT {A_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY MMSI ORDER BY Day, kr, BaseDateTime, LAT, LON, RendezvousMMSI2, ZoneName) rn FROM anom) WHERE rn <= 5",
    "clean_history": f"SELECT {P().replace('coalesce(VesselType, -1)', 'coalesce(VesselType, 0)')}, {R('coalesce(Length, 0)', 'Length')} FROM raw WHERE BaseDateTime IS NOT NULL AND LAT BETWEEN -90 AND 90 "
    "AND NOT (LAT = 0 AND LON = 0) AND (SOG IS NULL OR SOG BETWEEN 0 AND 100) AND (COG IS NULL OR COG BETWEEN 0 AND 360)",
    "drop_unknown_types": f"SELECT {P()} FROM raw WHERE VesselType <> 0",
    "select_training": f"SELECT {P()} FROM pings WHERE (VesselType = 30 OR VesselType BETWEEN 70 AND 79) AND MMSI < 366000060",
    "recent_window": f"SELECT {P()} FROM recent",
    "filter_outliers": f"SELECT {P()} FROM raw WHERE SOG IS NULL OR SOG <= 100",
    "filter_outliers_implied": f"SELECT MMSI, {R('LAT')}, {R('LON')}, {TS('BaseDateTime')} FROM (SELECT *, {H('lag(LAT) OVER w', 'lag(LON) OVER w', 'LAT', 'LON', 3440.065)} AS nm, {HRS('lag(BaseDateTime) OVER w', 'BaseDateTime')} AS hrs "
    "FROM pings WINDOW w AS (PARTITION BY MMSI ORDER BY BaseDateTime, LAT, LON)) WHERE hrs IS NULL OR hrs = 0 OR nm / hrs <= 100",
    "distinct_types": "SELECT DISTINCT VesselType FROM raw WHERE VesselType IS NOT NULL",
    "distinct_anomaly_types": "SELECT DISTINCT AnomalyType FROM anom",
    "label_vessel_type": f"SELECT coalesce(t, -1) AS VesselType, {TYPE_NAME('t')} AS VesselTypeName, count(*) AS count FROM (SELECT CASE WHEN VesselType = 90 THEN 95 ELSE VesselType END AS t FROM raw) GROUP BY ALL",
    "label_anomaly": f"SELECT AnomalyType, {NAMES(ANOMALY_LABELS, 'AnomalyType', 'AnomalyType')} AS DisplayName, {_EMPTY_MULTI} AS ReportName, AnomalyType AS Code, count(*) AS count FROM anom GROUP BY ALL",
    "vessel_category": f"SELECT coalesce(VesselType, -1) AS VesselType, {CATEGORY('VesselType')} AS Category, count(*) AS count FROM raw GROUP BY ALL",
    "validate_mmsi": "SELECT m AS MMSI, m BETWEEN 100000000 AND 999999999 AS MMSIValid, count(*) AS count FROM (SELECT CASE WHEN MMSI % 5 = 0 THEN MMSI % 1000 ELSE MMSI END AS m FROM pings) GROUP BY ALL",
    "filter_map_scope": "SELECT MMSI, count(*) AS n, 'pings' AS part FROM pings WHERE VesselType IN (30, 52, 71) AND MMSI IN (SELECT MMSI FROM anom WHERE AnomalyType IN ('Course', 'Speed')) GROUP BY MMSI "
    "UNION ALL SELECT MMSI, count(*), 'anomalies' FROM anom WHERE AnomalyType IN ('Course', 'Speed') AND MMSI IN (SELECT MMSI FROM pings WHERE VesselType IN (30, 52, 71)) GROUP BY MMSI",
    "anomalous_vessels_split": "SELECT MMSI, count(*) AS count, CASE WHEN MMSI IN (SELECT MMSI FROM anom WHERE AnomalyType = 'Speed') THEN 'with' ELSE 'without' END AS part FROM pings GROUP BY MMSI",
    # joins
    "type_anomaly_crosstab": "SELECT p.VesselType, " + ", ".join(f"count(*) FILTER (a.AnomalyType = '{t}') AS {t}" for t in ANOMALY_LABELS)
    + " FROM anom a JOIN (SELECT DISTINCT MMSI, VesselType FROM pings) p ON p.MMSI = a.MMSI GROUP BY p.VesselType",
    "vessel_semijoin": f"SELECT {A_OUT} FROM anom WHERE AnomalyType IN ('Course', 'Loitering') AND MMSI IN (SELECT MMSI FROM pings WHERE VesselType IN (30, 71))",
    "nearest_ping": f"SELECT MMSI, {TS('BaseDateTime')}, AnomalyType, {TS('mt', 'match_time')}, {R('mlat', 'match_lat')}, {R('msog', 'match_sog')} FROM matched",
    "anomaly_pins": f"SELECT MMSI, {R('LAT')}, {R('LON')}, {TS('BaseDateTime')}, AnomalyType, VesselName, concat(VesselType, ' (', {TYPE_NAME('VesselType')}, ')') AS VesselType, "
    f"{R('coalesce(SOG, msog)', 'SOG')}, {R('COG')}, {R('coalesce(Heading, mhead)', 'Heading')} FROM matched",
    "vessel_info_lookup": "SELECT * FROM minfo",
    "vessel_changes": f"SELECT f.MMSI, {DT('f.file_date', 'Date')}, CASE WHEN EXISTS (SELECT 1 FROM fp x WHERE x.MMSI = f.MMSI AND x.file_date = p.file_date) THEN 'common' ELSE 'new' END AS Change "
    "FROM fp f JOIN days d ON d.file_date = f.file_date JOIN days p ON p.di = d.di - 1 AND p.has "
    f"UNION ALL SELECT f.MMSI, {DT('n.file_date')}, 'lost' FROM fp f JOIN days d ON d.file_date = f.file_date JOIN days n ON n.di = d.di + 1 AND n.has "
    "WHERE NOT EXISTS (SELECT 1 FROM fp x WHERE x.MMSI = f.MMSI AND x.file_date = n.file_date)",
    # aggregates
    "run_statistics": "SELECT count(DISTINCT file_date) AS days_analyzed, count(*) AS records_analyzed, count(DISTINCT MMSI) AS unique_mmsi FROM pings",
    "nulls_by_column": f"UNPIVOT (SELECT {_null_counts(set())} FROM raw) ON COLUMNS(*) INTO NAME \"Column\" VALUE Total_Null_Values",
    "nulls_by_vessel": f"SELECT MMSI, {_null_counts({'MMSI'})} FROM raw GROUP BY MMSI",
    "nulls_by_vessel_day": f"SELECT {DT('file_date')}, MMSI, {_null_counts({'MMSI', 'file_date'})} FROM raw GROUP BY file_date, MMSI",
    "count_by_type": "SELECT AnomalyType, count(*) AS Count FROM anom GROUP BY AnomalyType",
    "count_by_date": f"SELECT {DT('Day', 'Date')}, count(*) AS Count FROM anom GROUP BY Day",
    "date_type_pivot": f"SELECT {DT('Day', 'Date')}, {COUNTS} FROM anom GROUP BY Day",
    "date_type_series": f"SELECT {DT('d.Day', 'Date')}, t.AnomalyType, count(a.MMSI) AS Count FROM (SELECT DISTINCT Day FROM anom) d CROSS JOIN (VALUES {', '.join(f'''('{t}')''' for t in TYPES)}) t(AnomalyType) "
    "LEFT JOIN anom a ON a.Day = d.Day AND a.AnomalyType = t.AnomalyType GROUP BY d.Day, t.AnomalyType",
    "vessel_stats": _vstats(),
    "vessel_stats_anomaly_only": "SELECT MMSI, count(*) AS Anomaly_Count, " + ", ".join(f"count(*) FILTER (AnomalyType = '{t}') AS Anomaly_{t}" for t in ANOMALY_LABELS)
    + ", coalesce(arg_min(VesselName, BaseDateTime) FILTER (VesselName IS NOT NULL), 'Unknown') AS VesselName FROM anom GROUP BY MMSI",
    "vessel_stats_summary": "SELECT count(DISTINCT MMSI) AS Total_Vessels, (SELECT count(DISTINCT MMSI) FROM anom) AS Vessels_With_Anomalies, (SELECT count(*) FROM anom) AS Total_Anomalies, count(*) AS Total_Records FROM pings",
    "summary_overview": f"SELECT Total_Records, Vessels, Vessel_Types, Named_Vessels, t AS Most_Common_Type, trim(split_part({TYPE_NAME('t')}, ',', 1)) AS Most_Common_Type_Name FROM "
    "(SELECT count(*) AS Total_Records, count(DISTINCT MMSI) AS Vessels, count(DISTINCT VesselType) AS Vessel_Types, count(DISTINCT MMSI) FILTER (VesselName IS NOT NULL) AS Named_Vessels FROM pings), "
    "(SELECT VesselType AS t FROM pings GROUP BY VesselType ORDER BY count(*) DESC, VesselType LIMIT 1)",
    "anomaly_overview": "SELECT 'Total Anomalies' AS Measure, count(*) AS Value FROM anom UNION ALL SELECT 'Vessels with Anomalies', count(DISTINCT MMSI) FROM anom UNION ALL SELECT AnomalyType, count(*) FROM anom GROUP BY AnomalyType",
    "multi_anomaly_vessels": "SELECT c.MMSI, coalesce(n.VesselName, InfoName, 'Unknown') AS VesselName, "
    f"concat(coalesce(t.VesselType, InfoType), ' (', {TYPE_NAME('coalesce(t.VesselType, InfoType)')}, ')') AS VesselType, AnomalyCounts, CAST(Total AS BIGINT) AS Total FROM "
    f"(SELECT MMSI, sum(n) AS Total, string_agg(label || ': ' || n, ', ' ORDER BY n DESC, AnomalyType) AS AnomalyCounts FROM (SELECT MMSI, AnomalyType, {_EMPTY_MULTI} AS label, count(*) AS n FROM anom GROUP BY ALL) GROUP BY MMSI HAVING sum(n) > 1) c "
    "JOIN minfo m ON m.MMSI = c.MMSI "
    "LEFT JOIN (SELECT MMSI, VesselName FROM (SELECT MMSI, VesselName, row_number() OVER (PARTITION BY MMSI ORDER BY count(*) DESC, VesselName) r FROM anom GROUP BY MMSI, VesselName) WHERE r = 1) n ON n.MMSI = c.MMSI "
    "LEFT JOIN (SELECT MMSI, VesselType FROM (SELECT MMSI, VesselType, row_number() OVER (PARTITION BY MMSI ORDER BY count(*) DESC, VesselType) r FROM anom GROUP BY MMSI, VesselType) WHERE r = 1) t ON t.MMSI = c.MMSI",
    "anomaly_timeline": f"SELECT {DT('Day')}, AnomalyType, count(*) AS Count FROM anom GROUP BY Day, AnomalyType",
    "hourly_distribution": "SELECT hour(BaseDateTime) AS Hour, count(*) AS Count FROM anom GROUP BY 1",
    "daily_distribution": f"SELECT {DT('CAST(BaseDateTime AS DATE)', 'Day')}, count(*) AS Count FROM anom GROUP BY 1",
    "weekday_distribution": "SELECT CAST(i AS BIGINT) AS DayNumber, d AS DayOfWeek, count(a.MMSI) AS Count FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) w(i, d) "
    "LEFT JOIN anom a ON dayname(a.BaseDateTime) = w.d GROUP BY ALL",
    "hour_type_crosstab": f"SELECT hour(BaseDateTime) AS Hour, {COUNTS} FROM anom GROUP BY 1",
    "anomaly_frequency": f"SELECT AnomalyType, count(*) AS Count, {R('count(*) * 100.0 / (SELECT count(*) FROM anom)', 'Percentage')} FROM anom GROUP BY AnomalyType",
    "vessel_type_counts": "SELECT VesselType, count(*) AS Count FROM pings WHERE VesselType IN (30, 60, 80) GROUP BY VesselType",
    "chart_aggregate": f"SELECT VesselType, {R('avg(SOG)', 'SOG')} FROM pings GROUP BY VesselType",
    "chart_value_counts": "SELECT VesselName, count(*) AS Count FROM raw WHERE VesselName IS NOT NULL GROUP BY VesselName",
    "chart_timeline": f"SELECT {DT('CAST(BaseDateTime AS DATE)', 'Day')}, AnomalyType, count(*) AS Count FROM anom GROUP BY 1, 2",
    "chart_histogram": "SELECT floor(SOG / 2.5) * 2.5 AS Bucket, VesselType, count(*) AS Count FROM pings GROUP BY ALL",
    "chart_box": f"SELECT VesselType, {R('min(SOG)', 'Min')}, {_quant(0.25, 'SOG', 'Q1')}, {_quant(0.5, 'SOG', 'Median')}, {_quant(0.75, 'SOG', 'Q3')}, {R('max(SOG)', 'Max')} FROM pings GROUP BY VesselType",
    "cluster_features": f"SELECT p.MMSI, {R('avg(SOG)', 'avg_speed')}, {R('max(SOG)', 'max_speed')}, count(*) AS total_records, {R('max(LAT) - min(LAT)', 'lat_range')}, {R('max(LON) - min(LON)', 'lon_range')}, max(InfoType) AS vessel_type "
    "FROM pings p JOIN minfo m ON m.MMSI = p.MMSI GROUP BY p.MMSI",
    "cluster_vessels": f"SELECT p.MMSI, {R('avg(SOG)', 'avg_speed')}, {R('max(SOG)', 'max_speed')}, count(*) AS total_records, {R('max(LAT) - min(LAT)', 'lat_range')}, {R('max(LON) - min(LON)', 'lon_range')}, max(InfoType) AS vessel_type, "
    "true AS few_clusters, true AS complete, true AS nearest FROM pings p JOIN minfo m ON m.MMSI = p.MMSI GROUP BY p.MMSI",
    "category_summary": f"SELECT Category, Records, Vessels, {R('Records * 100.0 / r', 'RecordsPct')}, {R('Vessels * 100.0 / v', 'VesselsPct')} FROM (SELECT {CATEGORY('VesselType')} AS Category, count(*) AS Records, "
    f"count(DISTINCT MMSI) FILTER ({CATEGORY('VesselType')} <> 'Unknown') AS Vessels FROM hist GROUP BY 1), (SELECT count(*) r, count(DISTINCT MMSI) v FROM hist)",
    "data_summary": f"SELECT count(*) AS total_records, count(DISTINCT MMSI) AS unique_vessels, {TS('min(BaseDateTime)', 'start')}, {TS('max(BaseDateTime)', 'end')}, "
    + ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in ("MMSI", "VesselName", "VesselType", "LAT", "LON", "SOG", "COG", "Heading", "BaseDateTime"))
    + ", bool_or(SOG IS NOT NULL) AS has_sog, bool_or(COG IS NOT NULL) AS has_cog, bool_or(Heading IS NOT NULL) AS has_heading, bool_or(VesselType <> 0) AS has_vessel_type FROM hist",
    "first_type_codes": "SELECT VesselType, count(*) AS Records, count(DISTINCT MMSI) AS Vessels FROM pings GROUP BY VesselType ORDER BY VesselType LIMIT 10",
    "movement_patterns": f"SELECT {CATEGORY('VesselType')} AS Category, {R('avg(SOG)', 'speed_mean')}, {R('stddev_samp(SOG)', 'speed_std')}, {R('max(SOG)', 'speed_max')}, {_quant(0.5, 'SOG', 'speed_median')}, "
    f"{R('sqrt(pow(avg(sin(radians(COG))), 2) + pow(avg(cos(radians(COG))), 2))', 'course_consistency')}, {R('stddev_samp(LAT)', 'geographic_spread_lat')}, {R('stddev_samp(LON)', 'geographic_spread_lon')}, "
    f"{R('count(*) * 1.0 / count(DISTINCT MMSI)', 'records_per_vessel')} FROM pings GROUP BY 1 HAVING {CATEGORY('min(VesselType)')} <> 'Unknown'",
    "leading_categories": f"SELECT first(c ORDER BY s DESC, c) AS fastest, first(c ORDER BY k DESC, c) AS most_consistent, first(c ORDER BY n DESC, c) AS most_active FROM (SELECT {CATEGORY('VesselType')} AS c, avg(SOG) s, "
    "sqrt(pow(avg(sin(radians(COG))), 2) + pow(avg(cos(radians(COG))), 2)) k, count(*) * 1.0 / count(DISTINCT MMSI) n FROM pings GROUP BY 1)",
    "vessel_density": f"SELECT MMSI, points, {R('span', 'span_hours')}, {R('points / greatest(span, 0.01)', 'points_per_hour')} FROM dens",
    "vessel_density_summary": "SELECT count(*) AS vessels, count(*) FILTER (points >= 3) AS enough_points, count(*) FILTER (span >= 24) AS long_span, count(*) FILTER (points >= 3 AND span >= 24) AS both, "
    f"min(points) AS min_points, max(points) AS max_points, {R('avg(points)', 'mean_points')}, {R('min(span)', 'min_span_hours')}, {R('max(span)', 'max_span_hours')}, {R('avg(span)', 'mean_span_hours')}, "
    + ", ".join(_quant(q, c, f"{n}_{k}") for c, k in (("points", "points"), ("span", "span_hours")) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)))
    + " FROM dens",
    "bounds": f"SELECT {R('a', 'min_lat')}, {R('b', 'max_lat')}, {R('c', 'min_lon')}, {R('d', 'max_lon')}, {R('(a + b) / 2', 'center_lat')}, {R('(c + d) / 2', 'center_lon')} FROM (SELECT min(LAT) - 5 a, max(LAT) + 5 b, min(LON) - 5 c, max(LON) + 5 d FROM pings)",
    "centroid": f"SELECT {R('avg(LAT)', 'lat')}, {R('avg(LON)', 'lon')} FROM pings WHERE VesselType = 70",
    "extended_period": f"SELECT MMSI, count(*) FILTER (k = 1) AS Original_Period_Records, count(*) FILTER (k = 2) AS Extended_Period_Records, count(*) AS Total_Records, {TS('min(BaseDateTime)', 'First_Seen')}, {TS('max(BaseDateTime)', 'Last_Seen')}, "
    "CAST(floor((epoch_us(max(BaseDateTime)) - epoch_us(min(BaseDateTime))) / 86400000000.0) AS BIGINT) + 1 AS Total_Days FROM (SELECT 1 AS k, * FROM pings WHERE file_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-10' "
    "UNION ALL SELECT 2, * FROM pings WHERE file_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-20') GROUP BY MMSI",
    # windows and top-k
    "day_index": f"SELECT {DT('file_date')}, di AS day_index FROM days",
    "first_last_ping": f"SELECT f.MMSI, {DT('f.file_date', 'file_date')}, c.n, {TS('f.BaseDateTime', 'first_time')}, {R('f.LAT', 'first_lat')}, {TS('l.BaseDateTime', 'last_time')}, {R('l.LAT', 'last_lat')} "
    "FROM fp f JOIN lp l ON l.MMSI = f.MMSI AND l.file_date = f.file_date JOIN (SELECT MMSI, file_date, count(*) n FROM clean GROUP BY ALL) c ON c.MMSI = f.MMSI AND c.file_date = f.file_date",
    "top_vessels": "SELECT MMSI, count(*) AS Count FROM anom WHERE AnomalyType = 'Course' GROUP BY MMSI ORDER BY 2 DESC, 1 LIMIT 15",
    "top20_vessels": "SELECT MMSI, count(*) AS Count FROM anom GROUP BY MMSI ORDER BY 2 DESC, 1 LIMIT 20",
    "top10_vessels": "SELECT MMSI, count(*) AS Count FROM anom GROUP BY MMSI ORDER BY 2 DESC, 1 LIMIT 10",
    "top10_per_type": "SELECT * FROM (SELECT AnomalyType, MMSI, count(*) AS Count, row_number() OVER (PARTITION BY AnomalyType ORDER BY count(*) DESC, MMSI) AS Rank FROM anom GROUP BY AnomalyType, MMSI) WHERE Rank <= 10",
    "top10_vessel_types": "SELECT VesselType, count(*) AS Count FROM pings GROUP BY VesselType ORDER BY 2 DESC, 1 LIMIT 10",
    "dedup_pings": f"SELECT {P()} FROM (SELECT *, row_number() OVER (PARTITION BY MMSI, BaseDateTime ORDER BY LAT NULLS FIRST, LON NULLS FIRST, VesselName NULLS FIRST, VesselType NULLS FIRST, SOG NULLS FIRST, COG NULLS FIRST, Heading NULLS FIRST) rn FROM raw) WHERE rn = 1",
    "union_days": f"SELECT {P().replace('round(Heading ', '''round(CASE WHEN file_date >= DATE '2024-01-10' THEN Heading END ''')} FROM pings",
    # tracks
    "segment_tracks": f"SELECT {_T} FROM tracks",
    "track_segments": f"SELECT MMSI, segment_id, points, {TS('t0', 'start')}, {TS('t1', 'end')}, {R('span', 'span_hours')} FROM segs WHERE points >= 2 AND span >= 1",
    "segment_rejections": "SELECT MMSI, count(*) AS candidates, count(*) FILTER (points < 2) AS too_few_points, count(*) FILTER (points >= 2 AND span < 1) AS too_short, count(*) FILTER (ok) AS kept, "
    f"min(points) FILTER (ok) AS min_points, max(points) FILTER (ok) AS max_points, {R('avg(points) FILTER (ok)', 'mean_points')}, {R('min(span) FILTER (ok)', 'min_span_hours')}, {R('max(span) FILTER (ok)', 'max_span_hours')}, {R('avg(span) FILTER (ok)', 'mean_span_hours')} "
    "FROM (SELECT *, points >= 2 AND span >= 1 AS ok FROM segs) GROUP BY MMSI",
    "detect_gaps": f"SELECT MMSI, {TS('pt', 'start_time')}, {TS('BaseDateTime', 'end_time')}, {R(HRS('pt', 'BaseDateTime'), 'duration_hours')}, pos - 1 AS start_index, pos AS end_index FROM steps WHERE {HRS('pt', 'BaseDateTime')} > 6",
    "motion_deltas": f"SELECT {_T}, {R('dt', 'dt_hours')}, {R('dv / dt', 'acceleration')}, {R('dc', 'cog_diff')}, {R('dc / dt', 'rate_of_turn')} FROM moves",
    "step_distance": f"SELECT {_T}, {R('nm', 'distance_nm')} FROM moves",
    "last_two_gap": f"SELECT MMSI, {R(HRS('pt', 'BaseDateTime'), 'gap_hours')} FROM (SELECT *, row_number() OVER (PARTITION BY MMSI ORDER BY pos DESC) r FROM steps) WHERE r = 1 AND pt IS NOT NULL",
    "latest_segment": f"SELECT {_T} FROM tracks t WHERE segment_id = (SELECT max(segment_id) FROM tracks x WHERE x.MMSI = t.MMSI)",
    "interpolate_tracks": _exact_grid(),
    "interpolate_tracks_linear": _linear_grid(),
    "linear_trend": f"SELECT MMSI, segment_id, {R('regr_slope(SOG, k)', 'sog_trend')} FROM moves GROUP BY MMSI, segment_id",
    "track_features": _features(),
    "path_points": f"SELECT MMSI, {TS('BaseDateTime')}, {R('LAT')}, {R('LON')}, pos AS seq FROM steps",
    "path_points_daily": f"SELECT MMSI, {DT('file_date')}, {TS('BaseDateTime')}, {R('LAT')}, {R('LON')}, row_number() OVER ({PART} ORDER BY BaseDateTime, LAT, LON) - 1 AS seq FROM pings",
    "vessel_paths": _paths("MMSI"),
    "vessel_paths_daily": _paths("MMSI, file_date"),
    "heat_points": f"SELECT {DT('Day', 'Date')}, AnomalyType, {R('LAT')}, {R('LON')}, 1.0 AS weight FROM anom",
    "heat_grid": f"SELECT VesselType, {R('CAST(a AS DOUBLE)', 'LAT')}, {R('CAST(o AS DOUBLE)', 'LON')}, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT VesselType, round(CAST(LAT AS DECIMAL(12, 6)), 2) AS a, round(CAST(LON AS DECIMAL(12, 6)), 2) AS o FROM pings) GROUP BY VesselType, a, o",
    # sequences
    "window_starts": f"SELECT MMSI, segment_id, {R('span', 'span_hours')}, slide AS slide_hours, wins AS windows FROM plan",
    "window_points": f"SELECT {_T}, window_no FROM wpoints",
    "training_sequences": f"SELECT s.*, w.lat_sum, w.points, w.points - 1 AS last_position FROM (SELECT {_SEQ} FROM seqs) s JOIN (SELECT MMSI, segment_id, window_no, {R('sum(LAT)', 'lat_sum')}, count(*) AS points FROM wpoints GROUP BY MMSI, segment_id, window_no) w "
    "ON w.MMSI = s.MMSI AND w.segment_id = s.segment_id AND w.window_no = s.window_no",
    "sequence_target": f"SELECT MMSI, segment_id, {DT('day')}, {TS('last_known_time')}, {R('tla', 'target_lat')}, {R('tlo', 'target_lon')}, {R('ts', 'target_sog')}, {R('tc', 'target_cog')}, {TS('tt', 'prediction_time')} FROM "
    "(SELECT e.*, t.LAT tla, t.LON tlo, t.SOG ts, t.COG tc, t.BaseDateTime tt, row_number() OVER (PARTITION BY e.MMSI, e.segment_id, e.day ORDER BY abs(epoch_us(t.BaseDateTime) - epoch_us(e.last_known_time) - 18000000000), t.BaseDateTime) rn "
    "FROM (SELECT MMSI, segment_id, file_date AS day, max(BaseDateTime) AS last_known_time FROM tracks GROUP BY ALL) e JOIN tracks t ON t.MMSI = e.MMSI AND t.segment_id = e.segment_id AND t.BaseDateTime > e.last_known_time) WHERE rn = 1",
    "sequence_matrix": f"SELECT MMSI, segment_id, window_no, i, {R('LAT', 'lat')}, {R('SOG', 'sog')}, {R('COG', 'cog')}, {R('LON', 'lon')}, {R('Heading', 'heading')}, 'lat,lon,sog,cog,heading' AS columns FROM spoints",
    "typed_vessel_semijoin": f"SELECT {_SEQ} FROM seqs WHERE MMSI IN (SELECT MMSI FROM dense WHERE MMSI % 3 <> 0 AND VesselType BETWEEN 20 AND 99)",
    "sequences_by_category": f"SELECT {CATEGORY('t')} AS Category, count(*) AS Sequences FROM seqs s JOIN (SELECT MMSI, arg_min(VesselType, BaseDateTime) AS t FROM dense GROUP BY MMSI) v ON v.MMSI = s.MMSI GROUP BY 1",
    "length_batches": "SELECT MMSI, segment_id, window_no, length, bin, batch FROM batches",
    "length_batches_shuffled": "SELECT MMSI, segment_id, window_no, length, bin, true AS fits FROM batched",
    "pad_sequence": f"SELECT MMSI, segment_id, window_no, position, padded_length, {', '.join(R(c) for c in ('lat', 'lon', 'sog', 'cog', 'heading'))} FROM ("
    "SELECT s.MMSI, s.segment_id, s.window_no, s.i AS position, b.padded_length, s.LAT AS lat, s.LON AS lon, s.SOG AS sog, s.COG AS cog, s.Heading AS heading FROM spoints s JOIN sized b "
    "ON b.MMSI = s.MMSI AND b.segment_id = s.segment_id AND b.window_no = s.window_no UNION ALL "
    "SELECT MMSI, segment_id, window_no, unnest(range(length, padded_length)), padded_length, 0, 0, 0, 0, 0 FROM sized)",
    "split_sequences": "SELECT split, count(*) AS count, count(*) AS stable, count(*) AS members FROM (SELECT CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM (SELECT row_number() OVER () AS i, count(*) OVER () AS n FROM seqs)) GROUP BY split",
    "sequence_length_stats": f"SELECT count(*) AS sequences, min(length) AS min_length, max(length) AS max_length, {R('avg(length)', 'mean_length')}, {R('stddev_pop(length)', 'std_length')}, count(*) FILTER (length < 2) AS below_2, count(*) FILTER (length BETWEEN 2 AND 4) AS from_2_to_4, "
    f"count(*) FILTER (length BETWEEN 5 AND 8) AS from_5_to_8, count(*) FILTER (length BETWEEN 9 AND 50) AS from_9_to_50, count(*) FILTER (length > 50) AS above_50, {_quant(0.5, 'length', 'median_length')} FROM seqs",
    "sequence_checks": "SELECT * FROM (SELECT unnest(['inconsistent_feature_dims', 'long_sequences', 'short_sequences', 'unexpected_long_sequences', 'inconsistent_target_shapes']) AS issue, "
    "unnest([CASE WHEN w THEN 2 ELSE 0 END, a, b, c, CASE WHEN t THEN 2 ELSE 0 END]) AS count, m AS max_length FROM (SELECT count(*) FILTER (n > 100) a, count(*) FILTER (n < 2) b, count(*) FILTER (n > 8) c, max(n) m, "
    "bool_or(k = 3) AS w, bool_or(k = 2) AND bool_or(k <> 2) AS t FROM "
    "(SELECT MMSI % 10 AS k, CASE WHEN MMSI % 10 = 0 THEN length + 107 WHEN MMSI % 10 = 1 THEN 1 ELSE length END AS n FROM seqs))) WHERE count > 0",
    "sequence_quality": f"SELECT count(*) AS sequences, {R('avg(length)', 'mean_points')}, min(length) AS min_points, max(length) AS max_points, {R('avg(h)', 'mean_horizon')}, {R('min(h)', 'min_horizon')}, {R('max(h)', 'max_horizon')}, "
    f"{R('avg(CASE WHEN target_sog IS NOT NULL THEN 100.0 ELSE 0 END)', 'pct_sog')}, {R('avg(CASE WHEN target_cog IS NOT NULL THEN 100.0 ELSE 0 END)', 'pct_cog')}, avg(length) < 3 AS low_points, avg(h) < 24 AS low_horizon, "
    f"avg(CASE WHEN target_sog IS NOT NULL THEN 100.0 ELSE 0 END) < 50 AS low_sog FROM (SELECT *, {HRS('last_known_time', 'prediction_time')} AS h FROM seqs)",
    # prediction
    "predict_tracks": f"SELECT MMSI, step, {', '.join(R(c) for c in ('lat', 'lon', 'std_lat', 'std_lon', 'speed', 'course'))} FROM guess",
    "prediction_intervals": f"SELECT MMSI, step, {', '.join(R(c) for c in ('lat', 'lon', 'std_lat', 'std_lon', 'speed', 'course'))}, {R('lat - 1.645 * std_lat', 'lower_lat')}, {R('lat + 1.645 * std_lat', 'upper_lat')}, {R('lon - 1.645 * std_lon', 'lower_lon')}, {R('lon + 1.645 * std_lon', 'upper_lon')} FROM guess",
    "sample_positions": "SELECT MMSI, step, 100 AS samples, true AS centred, true AS spread FROM guess",
    "predict_tracks_custom": f"SELECT MMSI, step, {R('lats[-1]', 'lat')}, {R('lons[-1]', 'lon')}, {R('0.1', 'std_lat')}, {R('0.1', 'std_lon')}, {R('8.0', 'speed')}, {R('CAST(NULL AS DOUBLE)', 'course')} FROM drifted WHERE step > 0",
    "prediction_cone": f"SELECT MMSI, step, {R('lat')}, {R('lon')}, {R('course')}, {R('spread', 'angular_offset')}, {R('dist', 'distance_nm')}, {R('pla', 'port_lat')}, {R('plo', 'port_lon')}, {R('sla', 'starboard_lat')}, {R('slo', 'starboard_lon')} FROM cone",
    "uncertainty_radius": f"SELECT MMSI, step, {R('lat')}, {R('lon')}, {R('greatest(100, least(r, 50000))', 'radius_m')}, {R('r / ((111000 + 111000 * cos(radians(lat))) / 2)', 'radius_deg')}, {R('CASE WHEN step = 8 THEN r * 20 END', 'diameter_m')}, {R('CASE WHEN step = 8 THEN r * 20 / 1852 END', 'diameter_nm')} "
    f"FROM (SELECT *, CASE WHEN apart >= 1 THEN apart ELSE {H('lat + 1 / 60.0 * cos(radians(course - spread))', 'lon + 1 / (60.0 * cos(radians(lat))) * sin(radians(course - spread))', 'lat + 1 / 60.0 * cos(radians(course + spread))', 'lon + 1 / (60.0 * cos(radians(lat))) * sin(radians(course + spread))', 6371000.0)} END / 2 * step / 8 AS r FROM "
    f"(SELECT *, {H('pla', 'plo', 'sla', 'slo', 6371000.0)} AS apart FROM cone))",
    "prediction_metrics": f"SELECT {R('avg(e)', 'mae_nm')}, {R('sqrt(avg(e * e))', 'rmse_nm')}, {R('avg(CASE WHEN e <= s THEN 1.0 ELSE 0 END)', 'coverage_1sigma')}, {R('avg(CASE WHEN e <= 2 * s THEN 1.0 ELSE 0 END)', 'coverage_2sigma')}, {R('avg(abs(lat - target_lat))', 'mae_lat_deg')}, {R('avg(abs(lon - target_lon))', 'mae_lon_deg')}, "
    f"{R('avg(std_lat)', 'mean_uncertainty_lat_deg')}, {R('avg(std_lon)', 'mean_uncertainty_lon_deg')}, {R('avg(s)', 'mean_uncertainty_nm')}, {_quant(0.5, 'e', 'median_error_nm')}, {_quant(0.9, 'e', 'p90_error_nm')}, {_quant(0.95, 'e', 'p95_error_nm')} "
    f"FROM (SELECT *, {H('lat', 'lon', 'target_lat', 'target_lon', 3440.0)} AS e, (std_lat + std_lon) / 2 * 60 AS s FROM scored)",
    "prediction_losses": _losses(),
    # scalar functions
    "haversine_nm": f"SELECT MMSI, {TS('BaseDateTime')}, {R(H('LAT', 'LON', '24.6', '-82.9'), 'nm')}, {R(H('LAT', 'LON', '-40.0', '170.0'), 'far')} FROM pings",
    "other_radii": f"SELECT MMSI, {TS('BaseDateTime')}, {R(H('LAT', 'LON', '25.0', '-82.0', 3440.065), 'track', 4)}, {R(H('LAT', 'LON', '25.0', '-82.0', 3440.0), 'score', 4)}, {R(H('LAT', 'LON', '25.0', '-82.0', 6371000.0), 'meters', 4)} FROM pings",
    "initial_bearing": f"SELECT MMSI, {TS('BaseDateTime')}, {R('(degrees(' + BEARING('LAT', 'LON', '25.0', '-82.5') + ') + 360) % 360', 'bearing')} FROM pings",
    "wrap_180": f"SELECT MMSI, {TS('BaseDateTime')}, {R(WRAP('COG * 3 - 540'), 'turn')} FROM pings",
    "offset_by_bearing": f"SELECT MMSI, {TS('BaseDateTime')}, {R('LAT + SOG * 6 / 60 * cos(radians(COG))', 'lat')}, {R('LON + SOG * 6 / (60 * cos(radians(LAT))) * sin(radians(COG))', 'lon')} FROM pings",
    "in_zone": f"SELECT MMSI, {TS('BaseDateTime')}, z AS ZoneName FROM (SELECT *, unnest([CASE WHEN {IN_BOX} THEN 'Box' END, CASE WHEN {IN_CIRCLE} THEN 'Ring' END, CASE WHEN {IN_RING(WEDGE)} THEN 'Wedge' END, CASE WHEN {LINE_M(CABLE)} <= 150 THEN 'Cable' END]) AS z FROM pings) WHERE z IS NOT NULL",
    "zone_shapes": f"SELECT MMSI, {TS('BaseDateTime')}, {IN_BOX} AS in_rectangle, {IN_CIRCLE} AS in_circle, {IN_RING(WEDGE)} AS in_polygon, {R(LINE_M(CABLE), 'line_m', 3)} FROM pings",
    "zone_bounds": f"SELECT CAST(MMSI AS VARCHAR) AS name, {R('la - 5000 / 111000.0', 'ZoneLatMin')}, {R('la + 5000 / 111000.0', 'ZoneLatMax')}, {R('lo - 5000 / (111000 * cos(radians(la)))', 'ZoneLonMin')}, {R('lo + 5000 / (111000 * cos(radians(la)))', 'ZoneLonMax')} FROM (SELECT MMSI, avg(LAT) la, avg(LON) lo FROM pings GROUP BY MMSI)",
    "circular_stats": f"SELECT MMSI, {_circular('heading', '1')} FROM (SELECT MMSI, avg(sin(radians(Heading))) s1, avg(cos(radians(Heading))) c1 FROM pings GROUP BY MMSI) WHERE sqrt(s1 * s1 + c1 * c1) > 1e-6",
    "confidence_interval": f"SELECT MMSI, {TS('BaseDateTime')}, {R('LAT - z * 0.1', 'lower')}, {R('LAT + z * 0.1', 'upper')} FROM (SELECT *, CASE MMSI % 5 WHEN 0 THEN 1 WHEN 1 THEN 1.645 WHEN 2 THEN 2 WHEN 3 THEN 2.576 ELSE 1 + (0.8 - 0.68) / (0.95 - 0.68) END AS z FROM pings)",
    "date_parts": f"SELECT MMSI, {TS('BaseDateTime')}, hour(BaseDateTime) AS hour, dayname(BaseDateTime) AS weekday, {DT('BaseDateTime', 'day')}, isodow(BaseDateTime) - 1 AS monday_zero FROM pings",
    "whole_days_plus_one": "SELECT MMSI, CAST(floor((epoch_us(max(BaseDateTime)) - epoch_us(min(BaseDateTime))) / 86400000000.0) AS BIGINT) + 1 AS days FROM pings GROUP BY MMSI",
    "date_from_name": "SELECT DISTINCT CASE MMSI % 3 WHEN 0 THEN strftime(file_date, '/x/ais-%Y-%m-%d.csv') WHEN 1 THEN strftime(file_date, '/x/AIS_%Y_%m_%d.csv') ELSE strftime(file_date, '/x/notes-%Y-%m-%d.txt') END AS name, "
    "CASE WHEN MMSI % 3 < 2 THEN strftime(file_date, '%Y-%m-%d') END AS day FROM pings",
    "zone_json": f"SELECT MMSI, {TS('BaseDateTime')}, CASE WHEN MMSI % 2 = 0 THEN 2 ELSE 1 END AS n, {R('LAT', 'lat')}, {R('LON', 'lon')} FROM pings",
    "parse_int_list": f"SELECT MMSI, {TS('BaseDateTime')}, 2 AS n, VesselType AS second FROM pings",
    "chaikin_smooth": f"SELECT MMSI, {DT('file_date')}, i - 1 AS i, {R('la[i]', 'lat')}, {R('lo[i]', 'lon')} FROM (SELECT MMSI, file_date, {_CUT('la')} AS la, {_CUT('lo')} AS lo FROM "
    f"(SELECT MMSI, file_date, {_CUT('la')} AS la, {_CUT('lo')} AS lo FROM (SELECT MMSI, file_date, list(LAT ORDER BY BaseDateTime, LAT, LON) AS la, list(LON ORDER BY BaseDateTime, LAT, LON) AS lo FROM pings GROUP BY ALL))) q, unnest(range(1, len(la) + 1)) t(i)",
    "narrow_types": f"SELECT VesselType, count(*) AS n, {R('CAST(CAST(min(LAT) AS FLOAT) AS DOUBLE)', 'low')} FROM pings GROUP BY VesselType",
    "nulls_by_column_customer": "UNPIVOT (SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in CUSTOMER) + " FROM customer) ON COLUMNS(*) INTO NAME \"Column\" VALUE Total_Null_Values",
    "chart_aggregate_lines": f"SELECT l_returnflag, {R('CAST(max(l_quantity) AS DOUBLE)', 'l_quantity')} FROM lineitem GROUP BY l_returnflag",
}

for _name, _test in {
    "in_rectangle": IN_BOX,
    "in_circle": IN_CIRCLE,
    "in_polygon": IN_RING(WEDGE),
    "near_polyline": f"{LINE_M(CABLE)} <= 150",
}.items():
    BODIES[_name] = f"SELECT MMSI, {TS('BaseDateTime')} FROM pings WHERE {_test}"

for _kind in ("new", "lost", "common"):
    BODIES[f"{_kind}_vessels"] = f"SELECT MMSI, Date FROM ({BODIES['vessel_changes']}) WHERE Change = '{_kind}'"

PARTS["hist"] = (
    "SELECT * REPLACE (coalesce(VesselType, 0) AS VesselType) FROM raw WHERE BaseDateTime IS NOT NULL AND LAT BETWEEN -90 AND 90 AND NOT (LAT = 0 AND LON = 0) "
    "AND (SOG IS NULL OR SOG <= 100) AND (COG IS NULL OR COG <= 360)"
)
PARTS["dens"] = f"SELECT MMSI, count(*) AS points, {HRS('min(BaseDateTime)', 'max(BaseDateTime)')} AS span FROM pings GROUP BY MMSI"

ORACLE = {name: compose(body) for name, body in BODIES.items()}
