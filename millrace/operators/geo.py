"""Distances, coordinates, cells and joins on the sphere and the plane. A geometry is an array of rings, a ring an array of struct<x, y>."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import finite, num
from millrace.plans.lineage import computed, origin
from millrace.plans.registry import operator
from millrace.scratch import settle

EARTH = 6_371_000.0
# The WGS84 ellipsoid.
A, FLAT = 6_378_137.0, 1 / 298.257223563
B = A * (1 - FLAT)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


@operator(lineage=computed("outputColumn", "lat1Column", "lon1Column", "lat2Column", "lon2Column", transform="distance"))
def geo_distance(df: DataFrame, lat1Column: str, lon1Column: str, lat2Column: str, lon2Column: str, outputColumn: str = "distance_m") -> DataFrame:
    """Great-circle metres, NULL if a coordinate is."""
    return df.withColumn(outputColumn, haversine(num(lat1Column), num(lon1Column), num(lat2Column), num(lon2Column)))


@operator()
def vincenty_distance(df: DataFrame, lat1Column: str, lon1Column: str, lat2Column: str, lon2Column: str, outputColumn: str = "distance_m", outputBearing: bool = False) -> DataFrame:
    """Geodesic metres on WGS84 by Vincenty's inverse formula, vectorised; NULL where it does not converge; bearing 0 to 360."""

    @F.pandas_udf("distance double, bearing double")
    def solve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        import numpy as np

        with np.errstate(all="ignore"):
            p1, l1, p2, l2 = (np.radians(x.to_numpy(float)) for x in (a, b, c, d))
            u1, u2, dl = np.arctan((1 - FLAT) * np.tan(p1)), np.arctan((1 - FLAT) * np.tan(p2)), l2 - l1
            lam, gap = dl.copy(), np.full(len(dl), np.inf)
            for _ in range(100):
                s, k = np.sin(lam), np.cos(lam)
                ss = np.hypot(np.cos(u2) * s, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * k)
                cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * k
                sig = np.arctan2(ss, cs)
                sa = np.where(ss == 0, 0, np.cos(u1) * np.cos(u2) * s / ss)
                c2 = 1 - sa**2
                cm = np.where(c2 == 0, 0, cs - 2 * np.sin(u1) * np.sin(u2) / c2)
                cc = FLAT / 16 * c2 * (4 + FLAT * (4 - 3 * c2))
                new = dl + (1 - cc) * FLAT * sa * (sig + cc * ss * (cm + cc * cs * (-1 + 2 * cm**2)))
                gap, lam = np.abs(new - lam), new
                if np.all((gap < 1e-12) | np.isnan(gap)):
                    break
            us = c2 * (A**2 - B**2) / B**2
            aa = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
            bb = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
            ds = bb * ss * (cm + bb / 4 * (cs * (-1 + 2 * cm**2) - bb / 6 * cm * (-3 + 4 * ss**2) * (-3 + 4 * cm**2)))
            dist = np.where(gap < 1e-9, B * aa * (sig - ds), np.nan)
            az = np.degrees(np.arctan2(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))) % 360
        return pd.DataFrame({"distance": dist, "bearing": az})

    out = df.withColumn("__v", solve(num(lat1Column), num(lon1Column), num(lat2Column), num(lon2Column))).withColumn(outputColumn, finite(F.col("__v.distance")))
    return (out.withColumn(f"{outputColumn}_bearing", finite(F.col("__v.bearing"))) if outputBearing else out).drop("__v")


@operator()
def convert_coordinates(df: DataFrame, fromType: str, toType: str, sourceColumns: list[str], outputPrefix: str = "coord_") -> DataFrame:
    """cartesian2d, cartesian3d, polar2d (r, theta), polar3d (r, theta from z, phi) and geographic (lat, lon; earth-centred metres at height 0)."""
    c = [num(x) for x in sourceColumns]
    if fromType == "geographic":
        lat, lon = F.radians(c[0]), F.radians(c[1])
        e2 = FLAT * (2 - FLAT)
        n = A / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
        xyz = [n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - e2) * F.sin(lat)]
    elif fromType == "polar2d":
        xyz = [c[0] * F.cos(c[1]), c[0] * F.sin(c[1]), F.lit(0.0)]
    elif fromType == "polar3d":
        xyz = [c[0] * F.sin(c[1]) * F.cos(c[2]), c[0] * F.sin(c[1]) * F.sin(c[2]), c[0] * F.cos(c[1])]
    else:
        xyz = [*c, F.lit(0.0)][:3]
    x, y, z = xyz
    r3 = F.sqrt(x * x + y * y + z * z)
    if toType == "geographic":
        p, e2, ep2 = F.sqrt(x * x + y * y), FLAT * (2 - FLAT), (A**2 - B**2) / B**2
        th = F.atan2(z * A, p * B)
        out = {"lat": F.degrees(F.atan2(z + ep2 * B * F.pow(F.sin(th), 3), p - e2 * A * F.pow(F.cos(th), 3))), "lon": F.degrees(F.atan2(y, x))}
    else:
        out = {"cartesian2d": {"x": x, "y": y}, "cartesian3d": {"x": x, "y": y, "z": z}, "polar2d": {"r": F.sqrt(x * x + y * y), "theta": F.atan2(y, x)}, "polar3d": {"r": r3, "theta": F.acos(F.try_divide(z, r3)), "phi": F.atan2(y, x)}}[toType]
    return df.withColumns({outputPrefix + k: finite(v) for k, v in out.items()})


@operator()
def geohash_cell(df: DataFrame, latColumn: str, lonColumn: str, precision: int = 7, outputColumn: str = "cell") -> DataFrame:
    """Geohash of 1 to 12 characters by bit arithmetic."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    cell = lambda c, lo, hi, n: F.least(F.lit((1 << n) - 1), F.greatest(F.lit(0), F.floor((c - lo) / (hi - lo) * float(1 << n)))).cast("long")
    out = df.withColumn("__x", cell(num(lonColumn), -180.0, 180.0, lon_bits)).withColumn("__y", cell(num(latColumn), -90.0, 90.0, lat_bits))

    def bit(k: int) -> Column:
        even = k % 2 == 0
        own, n = ("__x", lon_bits) if even else ("__y", lat_bits)
        return F.shiftright(own, n - 1 - k // 2).bitwiseAND(F.lit(1))

    letters = "0123456789bcdefghjkmnpqrstuvwxyz"
    chars = [F.substr(F.lit(letters), sum((bit(5 * i + j) * (1 << (4 - j)) for j in range(5)), F.lit(0)).cast("int") + 1, F.lit(1)) for i in range(precision)]
    return out.withColumn(outputColumn, F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull(), F.concat(*chars))).drop("__x", "__y")


@operator()
def crs_transform(df: DataFrame, xColumn: str, yColumn: str, sourceCrs: str = "EPSG:4326", targetCrs: str = "EPSG:3857", outputXColumn: str = "x_proj", outputYColumn: str = "y_proj") -> DataFrame:
    """Between longitude and latitude (4326) and Web Mercator (3857), and from 4326 to UTM zones (326xx, 327xx); other systems are an error."""
    x, y = num(xColumn), num(yColumn)
    s, t = sourceCrs.upper().removeprefix("EPSG:"), targetCrs.upper().removeprefix("EPSG:")
    if (s, t) == ("4326", "3857"):
        new = (F.radians(x) * A, A * F.ln(F.tan(math.pi / 4 + F.radians(y) / 2)))
    elif (s, t) == ("3857", "4326"):
        new = (F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2))
    elif s == "4326" and t[:3] in ("326", "327") and t[3:].isdigit() and 1 <= int(t[3:]) <= 60:
        n = FLAT / (2 - FLAT)
        big = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        a1, a2, a3 = n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240
        e = 2 * math.sqrt(n) / (1 + n)
        phi, lam = F.radians(y), F.radians(x - (int(t[3:]) * 6 - 183))
        tt = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
        xi, eta = F.atan2(tt, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + tt * tt))
        new = (500_000 + 0.9996 * big * (eta + sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in ((1, a1), (2, a2), (3, a3))), F.lit(0.0))), (10_000_000.0 if t[:3] == "327" else 0.0) + 0.9996 * big * (xi + sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in ((1, a1), (2, a2), (3, a3))), F.lit(0.0))))
    else:
        raise ValueError(f"no transform from {sourceCrs} to {targetCrs}")
    return df.withColumns({outputXColumn: finite(new[0]), outputYColumn: finite(new[1])})


_RINGS = "array<array<struct<x:double,y:double>>>"


def parse_wkt(text: Column) -> Column:
    """POINT, LINESTRING and POLYGON text as rings; NULL for others."""
    body = F.regexp_extract(text, r"(?is)^\s*(?:POINT|LINESTRING|POLYGON)\s*(?:Z\s*)?\((.*)\)\s*$", 1)
    rings = F.split(F.regexp_replace(body, r"^\s*\(|\)\s*$", ""), r"\)\s*,\s*\(")
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.when(body != "", F.transform(rings, lambda r: F.transform(F.split(r, ","), lambda p: F.struct(F.get(pair(p), F.lit(0)).try_cast("double").alias("x"), F.get(pair(p), F.lit(1)).try_cast("double").alias("y")))))


@operator(columns=("sourceColumn",))
def parse_geometry(df: DataFrame, sourceColumn: str, outputPrefix: str = "") -> DataFrame:
    """geometry, geometry_type and is_valid from WKT or GeoJSON points, lines and polygons."""
    text = F.col(sourceColumn)
    kind = F.upper(F.coalesce(F.get_json_object(text, "$.type"), F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1)))
    raw = F.get_json_object(text, "$.coordinates")
    ring = lambda ps: F.transform(ps, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    one = lambda v: F.when(v.isNotNull(), F.array(v))
    geo = F.when(kind == "POINT", one(ring(one(F.from_json(raw, "array<double>"))))).when(kind == "LINESTRING", one(ring(F.from_json(raw, "array<array<double>>")))).when(kind == "POLYGON", F.transform(F.from_json(raw, "array<array<array<double>>>"), ring))
    out = df.withColumn(f"{outputPrefix}geometry", F.when(raw.isNotNull(), geo).otherwise(parse_wkt(text)).cast(_RINGS)).withColumn(f"{outputPrefix}geometry_type", F.when(kind != "", kind))
    g = F.col(f"{outputPrefix}geometry")
    whole = F.forall(g, lambda r: F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    closed = F.forall(g, lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)))
    return out.withColumn(f"{outputPrefix}is_valid", F.coalesce(whole & F.when(kind == "POLYGON", closed).otherwise(True), F.lit(False)))


def bounds(g: Column) -> dict[str, Column]:
    pts = F.flatten(g)
    return {"x0": F.array_min(F.transform(pts, lambda p: p["x"])), "x1": F.array_max(F.transform(pts, lambda p: p["x"])), "y0": F.array_min(F.transform(pts, lambda p: p["y"])), "y1": F.array_max(F.transform(pts, lambda p: p["y"]))}


def point_in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Ray casting over all rings, so holes are outside."""

    def crossings(r: Column) -> Column:
        edges = F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r) - 1).alias("b"))
        cross = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
        return F.size(F.filter(edges, cross))

    return F.aggregate(rings, F.lit(0), lambda s, r: s + crossings(r)) % 2 == 1


@operator(ports=("left", "right"), lineage=lambda inputs, p, outputs: {c + p["rightSuffix"] if c in inputs["left"].columns else c: origin("right", c, "join") for c in inputs["right"].columns})
def spatial_join(left: DataFrame, right: DataFrame, leftGeometry: str, rightGeometry: str, predicate: str = "within", joinType: str = "inner", rightSuffix: str = "_r", cell: float = 1.0) -> DataFrame:
    """within (left points in right polygons), contains (the reverse), and intersects by bounding boxes, through an equality join on grid cells."""
    if predicate == "contains":
        return spatial_join(right, left, rightGeometry, leftGeometry, "within", "inner", rightSuffix, cell)
    if predicate not in ("within", "covered_by", "intersects"):
        raise ValueError(f"predicate {predicate} is not offered")

    def celled(df: DataFrame, g: str, tag: str) -> DataFrame:
        b = bounds(F.col(g))
        out = df.withColumns({f"__{tag}{k}": v for k, v in b.items()})
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
        return out.withColumn("__cx", F.explode_outer(span(f"__{tag}x0", f"__{tag}x1"))).withColumn("__cy", F.explode_outer(span(f"__{tag}y0", f"__{tag}y1")))

    a = celled(left.withColumn("__id", F.monotonically_increasing_id()), leftGeometry, "l")
    names = {c: c + rightSuffix if c in left.columns else c for c in right.columns}
    b = celled(right, rightGeometry, "r").withColumnsRenamed(names)
    g = names[rightGeometry]
    boxes = (F.col("__lx0") <= F.col("__rx1")) & (F.col("__lx1") >= F.col("__rx0")) & (F.col("__ly0") <= F.col("__ry1")) & (F.col("__ly1") >= F.col("__ry0"))
    # of the cells that two boxes share, one speaks for the pair
    once = (F.col("__cx") == F.floor(F.greatest("__lx0", "__rx0") / cell)) & (F.col("__cy") == F.floor(F.greatest("__ly0", "__ry0") / cell))
    found = a.join(b, ["__cx", "__cy"]).where(boxes & once)
    if predicate != "intersects":
        p = F.get(F.get(F.col(leftGeometry), F.lit(0)), F.lit(0))
        found = found.where(point_in_rings(p["x"], p["y"], F.col(g)))
    cols = [*left.columns, *names.values()]
    if joinType != "left_outer":
        return found.select(*cols)
    base = left.withColumn("__id", F.monotonically_increasing_id())
    return base.join(found.select("__id", *names.values()), "__id", "left").select(*cols)


@operator(ports=("df", "reference"))
def map_match(df: DataFrame, reference: DataFrame, key: str, latColumn: str, lonColumn: str, refLatColumn: str, refLonColumn: str, refIdColumn: str, matchedIdColumn: str = "matched_id", matchedDistanceColumn: str = "matched_distance_m", max_reference: int = 100_000) -> DataFrame:
    """The nearest reference point and its great-circle metres. The reference is broadcast and searched in numpy blocks; beyond max_reference rows, by an equality join on widening grid cells around the point, whose answer counts only if nothing outside the cells can be nearer."""
    points = reference.select(F.col(refIdColumn).alias("__rid"), num(refLatColumn).alias("__rlat"), num(refLonColumn).alias("__rlon")).dropna()
    own = df.select(F.col(key).alias("__k"), num(latColumn).alias("__lat"), num(lonColumn).alias("__lon")).dropna()
    if points.limit(max_reference + 1).count() <= max_reference:
        near = own.join(F.broadcast(points.agg(F.collect_list(F.struct("__rid", "__rlat", "__rlon")).alias("__all"))), how="cross")
        kind = dict(points.dtypes)["__rid"]

        def best(frames):
            import numpy as np

            ref = None
            for pdf in frames:
                if ref is None and len(pdf):
                    rows = pdf["__all"].iloc[0]
                    ref = ([r["__rid"] for r in rows], np.radians([[r["__rlat"], r["__rlon"]] for r in rows]))
                if not len(pdf) or not ref[0]:
                    continue
                ids, r = ref
                p = np.radians(pdf[["__lat", "__lon"]].to_numpy(float))
                unit = lambda q: np.stack([np.cos(q[:, 0]) * np.cos(q[:, 1]), np.cos(q[:, 0]) * np.sin(q[:, 1]), np.sin(q[:, 0])], 1)
                ur = unit(r)
                for at in range(0, len(p), 1024):
                    q = p[at : at + 1024]
                    j = np.argmax(unit(q) @ ur.T, axis=1)
                    h = np.sin((r[j, 0] - q[:, 0]) / 2) ** 2 + np.cos(q[:, 0]) * np.cos(r[j, 0]) * np.sin((r[j, 1] - q[:, 1]) / 2) ** 2
                    yield pd.DataFrame({"__k": pdf["__k"].iloc[at : at + 1024].to_numpy(), matchedIdColumn: [ids[i] for i in j], matchedDistanceColumn: 2 * EARTH * np.arcsin(np.minimum(1, np.sqrt(h)))})

        found = near.mapInPandas(best, f"__k {dict(own.dtypes)['__k']}, {matchedIdColumn} {kind}, {matchedDistanceColumn} double")
        return df.join(found, df[key] == F.col("__k"), "left").drop("__k")
    left, done = own, None
    turned = lambda c: F.pmod(F.col(c) + 180, F.lit(360.0))
    for size in (0.1, 1.0, 10.0, 30.0, 90.0, 360.0):
        across = round(360 / size)
        around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in ((-1, 0, 1) if across > 2 else (0,)))))
        a = left.withColumn("o", around).withColumn("cy", F.floor(F.col("__lat") / size) + F.col("o.i")).withColumn("cx", F.pmod(F.floor(turned("__lon") / size) + F.col("o.j"), F.lit(across)))
        b = points.withColumn("cy", F.floor(F.col("__rlat") / size)).withColumn("cx", F.pmod(F.floor(turned("__rlon") / size), F.lit(across)))
        d = haversine(F.col("__lat"), F.col("__lon"), F.col("__rlat"), F.col("__rlon"))
        got = a.join(b, ["cy", "cx"]).groupBy("__k").agg(F.min_by("__rid", F.struct(d, "__rid")).alias(matchedIdColumn), F.min(d).alias(matchedDistanceColumn), F.max(F.abs("__lat")).alias("__far"))
        if across > 1:  # a point outside the block is at least one cell away, along the meridian or across it
            side = F.asin(F.cos(F.radians("__far")) * math.sin(math.radians(min(size, 90.0))))
            got = got.where(F.col(matchedDistanceColumn) <= 0.999 * EARTH * F.least(side, F.lit(math.radians(size))))
        got = settle(got.drop("__far"), "map-match")
        done = got if done is None else done.unionByName(got)
        left = left.join(got.select("__k"), "__k", "left_anti")
    return df.join(done, df[key] == F.col("__k"), "left").drop("__k")


@operator(ports=("df", "places"))
def reverse_geocode(df: DataFrame, places: DataFrame, key: str, latColumn: str, lonColumn: str, level: str = "country") -> DataFrame:
    """Country, and with level state also the state, of the nearest row of places(id, lat, lon, country, state)."""
    out = map_match(df, places, key, latColumn, lonColumn, "lat", "lon", "id", "__place", "__metres")
    cols = ["country", "state"] if level == "state" else ["country"]
    table = places.select(F.col("id").alias("__place"), *cols)
    return out.join(table, "__place", "left").select(*df.columns, *cols)


@operator(ports=("df", "boundaries"))
def boundary_lookup(df: DataFrame, boundaries: DataFrame, input_mode: str = "auto", input_column: str | None = None, lat_column: str | None = None, lon_column: str | None = None, output_column: str = "geometry", keys: list[str] | None = None, text_rule: str | None = None) -> DataFrame:
    """Boundaries (countries, states, ZIP areas, places) by code or name, or by a point inside: boundaries(keys..., geometry) is the user's table.

    text_rule 'zip' keeps five digits. auto takes the point where both coordinates are given, else the text.
    """
    keys = keys or [c for c in boundaries.columns if c != "geometry"][:1]
    if input_mode == "point" or input_mode == "auto" and lat_column and lon_column:
        p = df.withColumn("__p", F.when(F.col(lat_column).isNotNull() & F.col(lon_column).isNotNull(), F.array(F.array(F.struct(num(lon_column).alias("x"), num(lat_column).alias("y"))))))
        out = spatial_join(p, boundaries, "__p", "geometry", "within", "left_outer").drop("__p")
        return out.withColumnRenamed("geometry" if "geometry" not in df.columns else "geometry_r", output_column)
    from millrace.operators.joins import lookup_join

    if text_rule == "zip":
        df = df.withColumn("__z", F.lpad(F.regexp_extract(F.col(input_column).cast("string"), r"^\s*(\d{3,5})", 1), 5, "0"))
        return lookup_join(df, boundaries, "__z", keys, ["geometry"]).withColumnRenamed("geometry", output_column).drop("__z")
    return lookup_join(df, boundaries, input_column, keys, ["geometry"]).withColumnRenamed("geometry", output_column)


