"""C4: a stored spatial index of points, and exact nearest neighbours from it.

Points on the unit sphere stand in nested cubic cells: level 0 cells are about
6 m wide, each level doubles the width, and the one cell of level 21 holds the
globe.  A cell's code packs its three coordinates into one number.

The index is a table of points, partitioned by region (the cells of one level,
at most ``MAX_REGIONS``) and clustered along a Morton curve inside, and a
manifest of cells with their counts, adaptive: a cell is listed if the cell
around it holds more than ``SPLIT`` points.  A search reads only the regions
it needs.

A request's own cell with at least k points bounds the distance to its k-th
neighbour.  The ball of that radius meets at most eight cells of about its
size.  Where these hold many points, as for a request far from all others,
they are split along the manifest and dropped by their least distance, with
the radius tightened by counts.  Only then are points joined, by cell.

That is for few requests.  Where they are many, next to the points, the
manifest's cells of at most ``BLOCK`` points are blocks: requests and points
are dealt to blocks, one row each, and measured there.  A request whose
neighbours may lie beyond its block's sides is then measured in the blocks
around, within the distance found; what is left (few points around, blocks of
one spot, very uneven surroundings) goes the way of few requests.

An index consists of segments, each complete in itself; a search takes the
best of all segments, so points are added by publishing a new segment, and
nothing that is there is read or written again.
"""
from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.functions.geo import chord_for_km, haversine_km, neighbour_offsets, unit_xyz
from roadpulse.operators import blocks as in_block
from roadpulse.session import materialize
from roadpulse.sources.manifest import Manifest

ROOT = 21
#: a cell with more points is split in the manifest
SPLIT = 16
#: regions of a segment, and the points of a region that are aimed at
MAX_REGIONS, REGION_POINTS = 16_384, 250_000
#: of points with equal keys and coordinates so many stay, those with the smallest ids
KEEP = 64
#: candidate points of a request, per neighbour, above which its cells are split further
CROWD = 2000
#: levels taken in one step when cells are split
STEP = 3
#: points of a block (at least ``SPLIT``), and requests that one task measures against them
BLOCK, SHARE = 2048, 8192
#: points per request above which requests are few, and read only the regions they need
FEW_ASKED = 64
#: blocks around a block up to which its requests are measured in them
AROUND = 256
#: blocks, as counted, up to which their list goes to every task
LISTED = 200_000
_EPS = 1e-12


def _right(c: Column, bits) -> Column:
    return F.call_function("shiftright", c, bits.cast("int") if isinstance(bits, Column) else F.lit(bits))


def _packed(ix: Column, iy: Column, iz: Column) -> Column:
    return F.shiftleft(ix, 2 * ROOT).bitwiseOR(F.shiftleft(iy, ROOT)).bitwiseOR(iz)


def _unpacked(code: Column) -> tuple[Column, Column, Column]:
    low = F.lit((1 << ROOT) - 1)
    return F.shiftright(code, 2 * ROOT), F.shiftright(code, ROOT).bitwiseAND(low), code.bitwiseAND(low)


def _around(code: Column, levels) -> Column:
    """Code of the cell so many levels up that holds a cell."""
    return _packed(*[_right(v, levels) for v in _unpacked(code)])


def _curve(code: Column) -> Column:
    """Place of a level 0 cell on the Morton curve: its coordinates' bits by turns."""
    def bits(taken, i):
        turn = [F.call_function("shiftleft", _right(v, i).bitwiseAND(F.lit(1).cast("long")), (i * 3 + n).cast("int"))
                for n, v in enumerate(_unpacked(code))]
        return taken.bitwiseOR(turn[0]).bitwiseOR(turn[1]).bitwiseOR(turn[2])
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROOT - 1)), F.lit(0).cast("long"), bits)


def _place(v: Column, level: Column | None = None) -> Column:
    """Cell coordinate of a unit-sphere coordinate at a level (default 0)."""
    width = F.lit(2.0 ** (ROOT - 1)) if level is None else F.pow(F.lit(2.0), F.lit(ROOT - 1) - level)
    last = F.lit((1 << ROOT) - 1) if level is None else (F.pow(F.lit(2.0), F.lit(ROOT) - level) - 1).cast("long")
    return F.least(F.greatest(F.floor((v + 1) * width).cast("long"), F.lit(0).cast("long")), last)


def cell_code(x: Column, y: Column, z: Column) -> Column:
    """Code of the level 0 cell of a point on the unit sphere."""
    return _packed(_place(x), _place(y), _place(z))


def _box(code: Column, level: Column) -> list[tuple[Column, Column]]:
    """Lower and upper bounds of a cell on each axis."""
    width = F.pow(F.lit(2.0), level - (ROOT - 1))
    return [(at * width - 1, (at + 1) * width - 1)
            for at in _unpacked(code)]


def _farthest(code: Column, level: Column) -> Column:
    """Largest chord from (_x, _y, _z) to a point of the cell."""
    return F.sqrt(sum(F.pow(F.greatest(F.abs(F.col(v) - lo), F.abs(F.col(v) - hi)), 2)
                      for v, (lo, hi) in zip(("_x", "_y", "_z"), _box(code, level)))) + _EPS


def _closest(code: Column, level: Column) -> Column:
    """Least chord from (_x, _y, _z) to a point of the cell."""
    zero = F.lit(0.0)
    return F.sqrt(sum(F.pow(F.greatest(lo - F.col(v), F.col(v) - hi, zero), 2)
                      for v, (lo, hi) in zip(("_x", "_y", "_z"), _box(code, level)))) - _EPS


def _reachable() -> Column:
    """Whether what a request reaches beyond its block lies in the cells next to it."""
    return F.col("_ub") <= F.pow(F.lit(2.0), F.col("_blevel") - (ROOT - 1))


class PointIndex:
    """A stored index of the rows of a table that have coordinates.

    ``keys`` are the columns by which a search may be restricted to points
    with equal values; a search uses all of them or none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifest")
        self.version, self.content = self.manifest.read()

    @classmethod
    def build(cls, df: DataFrame, path: str, *, id: str = "id", lat: str = "latitude", lon: str = "longitude",
              keys: Sequence[str] = ()) -> "PointIndex":
        """An index at ``path`` with ``df`` as its first segment."""
        index = cls(df.sparkSession, path)
        if index.version:
            raise ValueError(f"there is an index at {path}")
        index.content = {"id": id, "lat": lat, "lon": lon, "keys": list(keys), "segments": [], "schema": df.schema.json()}
        index.add(df)
        return index

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.content["schema"]))

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def add(self, df: DataFrame, **marks) -> None:
        """Add rows as a new segment, published together with ``marks`` when it
        is whole.  Rows whose id is there should be left out by the caller."""
        made = self._segment(df)

        def step(content: dict) -> dict:
            content = content or self.content
            return {**content, **marks, "segments": content["segments"] + ([made] if made else [])}

        self.content = self.manifest.change(step)
        self.version, _ = self.manifest.read()

    def compact(self, most: int = 8) -> None:
        """Put the segments after the first into one, when there are more than ``most``."""
        added = self.content["segments"][1:]
        if len(added) <= most:
            return
        made = self._segment(self.rows(added))
        names = {s["name"] for s in added}

        def step(content: dict) -> dict:
            kept = [s for s in content["segments"] if s["name"] not in names]
            return {**content, "segments": kept[:1] + [made] + kept[1:]}

        self.content = self.manifest.change(step)
        self.version, _ = self.manifest.read()

    def rows(self, segments: list[dict] | None = None) -> DataFrame:
        """All rows of the index (of equal points, those that it keeps)."""
        out = None
        for s in self.content["segments"] if segments is None else segments:
            rows = self._points(s).select(*self.columns)
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], self.schema)

    # ------------------------------------------------------------- writing
    def _segment(self, df: DataFrame) -> dict | None:
        c = self.content
        x, y, z = unit_xyz(c["lat"], c["lon"])
        placed = df.where(F.col(c["lat"]).isNotNull() & F.col(c["lon"]).isNotNull()).withColumns({"_px": x, "_py": y, "_pz": z})
        placed = placed.withColumn("_code", cell_code(F.col("_px"), F.col("_py"), F.col("_pz")))
        same = [*c["keys"], c["lat"], c["lon"]]
        placed = materialize(placed, "index_points")
        heavy = materialize(placed.groupBy(*same).count().where(F.col("count") > KEEP).drop("count"), "index_heavy")
        if not heavy.isEmpty():
            # ranks are cut at KEEP before they are shuffled, so a place may hold any number of points
            rank = F.row_number().over(Window.partitionBy(*same).orderBy(c["id"]))
            placed = materialize(placed.withColumn("_rank", rank).where(F.col("_rank") <= KEEP).drop("_rank"), "index_points")
        name = uuid.uuid4().hex[:16]
        folder = f"{self.path}/segments/{name}"
        counts = placed.groupBy(*c["keys"], "_code").agg(F.count(F.lit(1)).alias("n"))
        cells = []
        for keys in ([], c["keys"]) if c["keys"] else ([],):
            per = counts.select(*keys, "n", "_code", F.explode(F.sequence(F.lit(0), F.lit(ROOT))).alias("level"))
            per = per.groupBy(*keys, "level", _around(F.col("_code"), F.col("level")).alias("code")).agg(F.sum("n").alias("n"))
            per = materialize(per, "index_cells")
            around = per.where(F.col("n") > SPLIT).select(
                *[F.col(k).alias(f"_{k}") for k in keys], (F.col("level") - 1).alias("_level"), F.col("code").alias("_around"))
            inside = (F.col("level") == F.col("_level")) & (_around(F.col("code"), 1) == F.col("_around"))
            for k in keys:
                inside = inside & F.col(k).eqNullSafe(F.col(f"_{k}"))
            listed = per.join(around, inside, "left_semi").unionByName(per.where(F.col("level") == ROOT))
            cells.append((keys, per, listed))
        per = cells[0][1]
        sizes = {r["level"]: (r["cells"], r["n"]) for r in per.groupBy("level").agg(
            F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n")).collect()}  # one row a level
        if not sizes:
            return None
        total = sizes[ROOT][1]
        # the finest level whose cells are about as many as the regions wanted
        wanted = min(MAX_REGIONS, math.ceil(total / REGION_POINTS) * 4)
        region = min(level for level, (n, _) in sizes.items() if n <= wanted)
        placed.withColumn("_region", _around(F.col("_code"), region)).withColumn("_curve", _curve(F.col("_code")))\
            .repartitionByRange("_region", "_curve", c["id"]).sortWithinPartitions("_region", "_curve").drop("_curve").withColumn("_spot", F.monotonically_increasing_id())\
            .write.partitionBy("_region").parquet(f"{folder}/points")
        per.where(F.col("level") == region).select(F.col("code").alias("_region")).coalesce(1).write.parquet(f"{folder}/regions")
        for n, (keys, _, listed) in enumerate(cells):
            # cells as large as a region or larger stand apart: at most a few for each region
            at = F.when(F.col("level") >= region, F.lit(-1)).otherwise(_around(F.col("code"), F.lit(region) - F.col("level")))
            listed.select(*keys, "level", "code", "n", at.cast("long").alias("_region")).repartitionByRange("_region", "level", "code")\
                .write.partitionBy("_region").parquet(f"{folder}/cells_{n}")
        self._extras(df, folder)
        return {"name": name, "region": region, "points": total}

    def _extras(self, df: DataFrame, folder: str) -> None:
        """What else a segment holds of its rows."""

    def key_counts(self) -> DataFrame:
        """Points by the index's keys (at most ``KEEP`` of equal coordinates)."""
        out = None
        for s in self.content["segments"]:
            part = self.spark.read.parquet(f"{self.path}/segments/{s['name']}/cells_1").where(
                (F.col("_region") == -1) & (F.col("level") == ROOT)).select(*self.content["keys"], "n")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.rows().groupBy(*self.content["keys"]).agg(F.count(F.lit(1)).alias("n"))
        return out.groupBy(*self.content["keys"]).agg(F.sum("n").alias("n"))

    # ------------------------------------------------------------- reading
    def _points(self, segment: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment['name']}/points")

    def _regions(self, segment: dict) -> DataFrame:
        """(level, code, region): the cells from region size up, at most
        ``ROOT`` times ``MAX_REGIONS``, that hold a region."""
        region = segment["region"]
        return self.spark.read.parquet(f"{self.path}/segments/{segment['name']}/regions").select(
            F.explode(F.sequence(F.lit(region), F.lit(ROOT))).alias("level"), "_region").select(
            "level", _around(F.col("_region"), F.col("level") - region).alias("code"), "_region")

    def knn(self, left: DataFrame, k: int, *, left_id: str = "request_id", left_lat: str = "lat", left_lon: str = "lon",
            by_keys: bool = False, max_km: float | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """For each left row the k nearest points (with ``by_keys`` among those
        with equal keys; with ``max_km`` within that radius), ties by id:
        ``left_id``, the points' ``columns`` (default all), ``distance_km`` and
        ``nn_rank`` (from 1).  Rows without coordinates, or with a NULL key in
        a search by keys, have no neighbours; ``left_id`` should be unique."""
        if k > KEEP:
            raise ValueError(f"at most {KEEP} neighbours")
        c = self.content
        keys = list(c["keys"]) if by_keys else []
        columns = list(columns) if columns is not None else [n for n in self.columns]
        x, y, z = unit_xyz(left_lat, left_lon)
        asked = left.where(F.col(left_lat).isNotNull() & F.col(left_lon).isNotNull()).select(
            F.col(left_id).alias("_lid"), F.col(left_lat).alias("_llat"), F.col(left_lon).alias("_llon"), *keys,
            x.alias("_x"), y.alias("_y"), z.alias("_z"))
        asked = asked.withColumn("_own", cell_code(F.col("_x"), F.col("_y"), F.col("_z")))
        found = None
        for segment in c["segments"]:
            part = self._search(segment, asked, k, keys, max_km, columns)
            if len(c["segments"]) > 1:
                # written, so that the driver plans and compiles one segment's search at a time, not all of them at once
                part = materialize(part, "index_found")
            found = part if found is None else found.unionByName(part)
        if found is None:
            empty = self.rows().select(*columns)
            schema = T.StructType([left.schema[left_id], *empty.schema.fields, T.StructField("distance_km", T.DoubleType()),
                                   T.StructField("nn_rank", T.IntegerType())])
            return self.spark.createDataFrame([], schema)
        if len(c["segments"]) > 1:
            order = Window.partitionBy("_lid").orderBy("distance_km", "_pid")
            found = found.withColumn("nn_rank", F.row_number().over(order)).where(F.col("nn_rank") <= k)
        return found.select(F.col("_lid").alias(left_id), *columns, "distance_km", "nn_rank")

    def _search(self, segment: dict, asked: DataFrame, k: int, keys: list[str], max_km: float | None, columns) -> DataFrame:
        if asked.count() * FEW_ASKED < segment["points"]:
            return self._by_cells(segment, asked.withColumn("_known", F.lit(None).cast("double")), k, keys, max_km, columns)
        return self._by_blocks(segment, asked, k, keys, max_km, columns)

    # ------------------------------------------------- many requests: by blocks
    def _blocks(self, segment: dict, keys: list[str]) -> DataFrame:
        """(keys, level, code, n, _block): cells that together hold every point
        once, with at most ``BLOCK`` points unless they can't be split."""
        cells = self.spark.read.parquet(f"{self.path}/segments/{segment['name']}/cells_{1 if keys else 0}").select(*keys, "level", "code", "n")
        full = cells.where((F.col("n") > BLOCK) & (F.col("level") > 0)).select(
            *keys, (F.col("level") - 1).alias("level"), F.col("code").alias("_out"))
        parts = cells.withColumn("_out", _around(F.col("code"), 1)).join(full, [*keys, "level", "_out"], "left_semi").drop("_out")
        leaves = parts.where((F.col("n") <= BLOCK) | (F.col("level") == 0)).unionByName(
            cells.where((F.col("level") == ROOT) & (F.col("n") <= BLOCK)))
        return materialize(leaves.withColumn("_block", F.monotonically_increasing_id()), "index_blocks")

    def _within(self, segment: dict, rows: DataFrame, blocks: DataFrame, held, k: int, keys: list[str], columns, home: bool) -> DataFrame | None:
        """Requests measured against the points of their ``_block``, within their ``_ub``."""
        sizes = rows.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).cast("int").alias("_shares"))
        used = materialize(blocks.join(sizes, "_block").select(
            *keys, "level", "code", "_block", "_shares"), "index_used")
        levels = [r[0] for r in used.select("level").distinct().collect()]  # at most ROOT + 1
        if not levels:
            return None
        c = self.content
        fields = {"_pid": c["id"], "_plat": c["lat"], "_plon": c["lon"], **{f"_col{i}": n for i, n in enumerate(columns)}}
        points = self._points(segment).select(
            *keys, "_code", "_px", "_py", "_pz", *[F.col(n).alias(f) for f, n in fields.items()],
            F.explode(F.array(*[F.lit(n) for n in levels])).alias("level")).withColumn("code", _around(F.col("_code"), F.col("level")))
        points = points.join(held(used), [*keys, "level", "code"]).select(
            "_block", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"), "_px", "_py", "_pz", *fields)
        carry = ["_row", "_lid", "_llat", "_llon", *keys, "_x", "_y", "_z", "_own", "_block", "_blevel", "_bcode"]
        dealt = rows.join(held(used.select("_block", "_shares")), "_block").select(
            *carry, "_ub", F.pmod(F.xxhash64("_row"), F.col("_shares")).cast("int").alias("_share"))
        point = T.StructType([T.StructField(f, points.schema[f].dataType) for f in fields])
        schema = T.StructType([*[T.StructField(n, dealt.schema[n].dataType) for n in carry], T.StructField("_ub", T.DoubleType()),
                               T.StructField("_done", T.BooleanType()), T.StructField("_found", T.ArrayType(point))])
        return dealt.groupBy("_block", "_share").cogroup(points.groupBy("_block", "_share")).applyInArrow(
            in_block.finder(carry, list(fields), k, ROOT, home), schema)

    def _by_blocks(self, segment: dict, asked: DataFrame, k: int, keys: list[str], max_km: float | None, columns) -> DataFrame:
        blocks = self._blocks(segment, keys)
        listed = blocks.count() <= LISTED

        def held(df: DataFrame) -> DataFrame:
            return F.broadcast(df) if listed else df

        levels = sorted(r[0] for r in blocks.select("level").distinct().collect())
        homed = asked.withColumn("_row", F.monotonically_increasing_id())
        for level in levels:
            at = blocks.where(F.col("level") == level).select(*keys, F.col("code").alias("_at"), F.struct(
                "_block", F.col("level").alias("_blevel"), F.col("code").alias("_bcode"), F.col("n").alias("_bn")).alias(f"_in{level}"))
            homed = homed.withColumn("_at", _around(F.col("_own"), level)).join(held(at), [*keys, "_at"], "left").drop("_at")
        homed = homed.withColumn("_in", F.coalesce(*[F.col(f"_in{n}") for n in levels])).drop(*[f"_in{n}" for n in levels])
        homed = materialize(homed.select("*", "_in.*").drop("_in"), "index_homed")
        measured = F.coalesce((F.col("_bn") >= k) & (F.col("_bn") <= BLOCK), F.lit(False))
        limit = 2.0 if max_km is None else chord_for_km(max_km)
        first = self._within(segment, homed.where(measured).withColumn("_ub", F.lit(limit + 1e-9)), blocks, held, k, keys, columns, True)
        asking = asked.columns
        rest = homed.where(~measured).select(*asking, F.lit(None).cast("double").alias("_known"))
        found = []
        if first is not None:
            first = materialize(first, "index_first")
            found.append(first.where(F.col("_done")))
            beyond = first.where(~F.col("_done")).drop("_done", "_found")
            near, around, uneven = self._around_homes(beyond, blocks, levels, held, keys)
            far = beyond.join(held(uneven), F.col("_block") == F.col("_home"), "left").where(
                F.col("_home").isNotNull() | ~_reachable()).drop("_home")
            rest = rest.unionByName(far.select(*asking, F.col("_ub").alias("_known")))
            met = near.withColumnRenamed("_block", "_home").drop("_blevel", "_bcode").join(around, ["_home", *keys]).where(
                _closest(F.col("_bcode"), F.col("_blevel")) <= F.col("_ub")).drop("_home")
            second = self._within(segment, materialize(met, "index_beyond"), blocks, held, k, keys, columns, False)
            if second is not None:
                found.append(second.groupBy("_row").agg(*[F.first(n).alias(n) for n in ("_lid", "_llat", "_llon")],
                                                        F.flatten(F.collect_list("_found")).alias("_found")))
        out = None
        for part in found:
            part = self._best(part, k, max_km, columns)
            out = part if out is None else out.unionByName(part)
        rest = materialize(rest, "index_rest")
        if out is None or not rest.isEmpty():
            part = self._by_cells(segment, rest, k, keys, max_km, columns)
            out = part if out is None else out.unionByName(part.select(*out.columns))
        if not homed.groupBy("_lid").count().where(F.col("count") > 1).isEmpty():
            # rows of one id are ranked together
            order = Window.partitionBy("_lid").orderBy("distance_km", "_pid")
            out = out.withColumn("nn_rank", F.row_number().over(order)).where(F.col("nn_rank") <= k)
        return out

    def _best(self, found: DataFrame, k: int, max_km: float | None, columns) -> DataFrame:
        """The k nearest of the points found for each request."""
        near = F.transform("_found", lambda p: F.struct(
            haversine_km("_llat", "_llon", p["_plat"], p["_plon"]).alias("distance_km"), p["_pid"].alias("_pid"), p.alias("_point")))
        if max_km is not None:
            near = F.filter(near, lambda p: p["distance_km"] <= F.lit(max_km))
        best = found.select("_lid", F.posexplode(F.slice(F.sort_array(near), 1, k)).alias("_at", "_best"))
        return best.select("_lid", F.col("_best._pid").alias("_pid"), F.col("_best.distance_km").alias("distance_km"),
                           (F.col("_at") + 1).alias("nn_rank"),
                           *[F.col(f"_best._point._col{i}").alias(n) for i, n in enumerate(columns)])

    def _around_homes(self, beyond: DataFrame, blocks: DataFrame, levels, held, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of requests that reach beyond their blocks: those that are measured
        in the blocks around; the blocks around each home (_home, keys, _block,
        _blevel, _bcode); the homes with too many, or unsplit ones, around."""
        reach = beyond.where(_reachable())
        homes = blocks.join(reach.select("_block").distinct(), "_block", "left_semi")
        cells = homes.select(F.col("_block").alias("_home"), *keys, "level", *[v.alias(f"_i{a}") for a, v in zip("xyz", _unpacked(F.col("code")))],
                             F.explode(neighbour_offsets()).alias("_o"))
        at = [F.col(f"_i{a}") + F.col(f"_o.d{a}") for a in "xyz"]
        last = F.shiftleft(F.lit(1).cast("long"), ROOT) - 1
        inside = [(v >= 0) & (v <= F.call_function("shiftright", last, F.col("level"))) for v in at]
        cells = cells.where(inside[0] & inside[1] & inside[2]).select("_home", *keys, "level", _packed(*at).alias("code"))
        every = F.array(*[F.lit(n) for n in levels])
        block = ["_block", F.col("level").alias("_blevel"), F.col("code").alias("_bcode"), "n"]

        def lifted(df: DataFrame, above, *also) -> DataFrame:
            return df.select(*also, *keys, "level", "code", F.explode(F.filter(every, above)).alias("_up")).select(
                *also, *keys, F.col("_up").alias("level"), _around(F.col("code"), F.col("_up") - F.col("level")).alias("code"))

        hold = lifted(cells, lambda n: n >= F.col("level"), "_home").join(
            blocks.select(*keys, "level", "code", *block), [*keys, "level", "code"])
        lie = lifted(blocks.select("*", *block[1:3]), lambda n: n > F.col("level"), "_block", "_blevel", "_bcode", "n").join(
            cells, [*keys, "level", "code"])
        names = ["_home", *keys, "_block", "_blevel", "_bcode", "n"]
        around = materialize(hold.select(*names).unionByName(lie.select(*names)).distinct(), "index_around")
        uneven = materialize(around.groupBy("_home").agg(F.count(F.lit(1)).alias("_many"), F.max("n").alias("_most")).where(
            (F.col("_many") > AROUND) | (F.col("_most") > BLOCK)).select("_home"), "index_uneven")
        near = reach.join(held(uneven), F.col("_block") == F.col("_home"), "left_anti")
        return near, around.drop("n"), uneven

    # ----------------------------------------------------- few requests: by cells
    def _by_cells(self, segment: dict, asked: DataFrame, k: int, keys: list[str], max_km: float | None, columns) -> DataFrame:
        """A search that reads only the regions it needs; ``_known`` is a chord
        that a request's k nearest are known to lie within, or NULL."""
        c, folder = self.content, f"{self.path}/segments/{segment['name']}"
        region = segment["region"]
        regions = self._regions(segment)
        if segment["points"] > REGION_POINTS:
            # only the regions of the requests' own cells, and the large cells
            own = [r[0] for r in asked.select(_around(F.col("_own"), region).alias("r")).distinct().join(
                F.broadcast(regions.where(F.col("level") == region)), F.col("r") == F.col("code")).select("r").collect()]
            cells = self.spark.read.parquet(f"{folder}/cells_{1 if keys else 0}").where(F.col("_region").isin([-1, *own]))
        else:
            cells = self.spark.read.parquet(f"{folder}/cells_{1 if keys else 0}")
        cells = cells.select(*keys, "level", "code", "n")
        # the smallest cell around a request that holds k points, if any does
        enough = cells.where(F.col("n") >= k)
        up = asked.where(F.col("_known").isNull()).select("_lid", *keys, "_own", F.explode(F.sequence(F.lit(0), F.lit(ROOT))).alias("level")).select(
            "_lid", *keys, "level", _around(F.col("_own"), F.col("level")).alias("code"))
        smallest = up.join(enough, [*keys, "level", "code"]).groupBy("_lid").agg(F.min("level").alias("_level"))
        balls = asked.join(smallest, "_lid", "left").withColumn("_level", F.coalesce("_level", F.lit(ROOT)))
        reach = _farthest(_around(F.col("_own"), F.col("_level")), F.col("_level"))
        if max_km is not None:
            reach = F.least(reach, F.lit(chord_for_km(max_km) + 1e-9))
        balls = balls.withColumn("_ub", F.least(reach, F.col("_known"), F.lit(2.0))).drop("_known")
        # cells at least as wide as the ball: two on an axis at most
        level = F.least(F.greatest(F.ceil(F.log2("_ub")) + ROOT, F.lit(0)), F.lit(ROOT)).cast("int")
        balls = balls.withColumn("level", level)
        for axis in "xyz":
            v = F.col(f"_{axis}")
            balls = balls.withColumn(f"_i{axis}", F.explode(F.sequence(
                _place(v - F.col("_ub"), F.col("level")), _place(v + F.col("_ub"), F.col("level")))))
        met = balls.withColumn("code", _packed(F.col("_ix"), F.col("_iy"), F.col("_iz"))).drop("_ix", "_iy", "_iz", "_level", "_own")
        met = met.where(_closest(F.col("code"), F.col("level")) <= F.col("_ub"))
        met = materialize(met, "index_met")
        crowd = self._crowded(met, cells if segment["points"] <= REGION_POINTS else self._cells_near(segment, met, keys, regions), k, keys)
        # points of the candidate cells, by cell, from the regions that hold them
        levels = [r[0] for r in crowd.select("level").distinct().collect()]
        points = self._points(segment)
        if segment["points"] > REGION_POINTS:
            near = self._near(segment, crowd, regions)
            points = points.where(F.col("_region").isin(near))
        if not levels:
            levels = [ROOT]
        held = points.select(F.col(c["id"]).alias("_pid"), *keys, "_spot", "_px", "_py", "_pz", F.col(c["lat"]).alias("_plat"),
                             F.col(c["lon"]).alias("_plon"), "_code", F.explode(F.array(*[F.lit(n) for n in levels])).alias("level")).select(
            "_pid", *keys, "_spot", "_px", "_py", "_pz", "_plat", "_plon", "level", _around(F.col("_code"), F.col("level")).alias("code"))
        away = sum(F.pow(F.col(f"_{a}") - F.col(f"_p{a}"), 2) for a in "xyz")
        pairs = crowd.join(held, [*keys, "level", "code"]).where(away <= F.pow(F.col("_ub") + 1e-9, 2))
        pairs = pairs.select("_lid", "_pid", "_spot", haversine_km("_llat", "_llon", "_plat", "_plon").alias("distance_km"))
        if max_km is not None:
            pairs = pairs.where(F.col("distance_km") <= F.lit(max_km))
        rank = F.row_number().over(Window.partitionBy("_lid").orderBy("distance_km", "_pid"))
        best = pairs.withColumn("nn_rank", rank).where(F.col("nn_rank") <= k)
        return best.join(points.select("_spot", *columns), "_spot").drop("_spot")

    def _near(self, segment: dict, met: DataFrame, regions: DataFrame) -> list[int]:
        """The regions (at most ``MAX_REGIONS``) that candidate cells lie in or hold."""
        region = segment["region"]
        large = met.select(F.greatest("level", F.lit(region)).alias("level"), "_x", "_y", "_z", "_ub",
                           _around(F.col("code"), F.greatest(F.lit(region) - F.col("level"), F.lit(0))).alias("code"))
        reached = _closest(F.col("_region"), F.lit(region)) <= F.col("_ub")
        return [r[0] for r in large.join(F.broadcast(regions), ["level", "code"]).where(reached)
                .select("_region").distinct().collect()]

    def _cells_near(self, segment: dict, met: DataFrame, keys: list[str], regions: DataFrame) -> DataFrame:
        near = self._near(segment, met, regions)
        return self.spark.read.parquet(f"{self.path}/segments/{segment['name']}/cells_{1 if keys else 0}").where(
            F.col("_region").isin([-1, *near])).select(*keys, "level", "code", "n")

    def _crowded(self, met: DataFrame, cells: DataFrame, k: int, keys: list[str]) -> DataFrame:
        """Candidate cells, with those of crowded requests split until few
        points are left: cells too far by the counts of nearer ones go."""
        limit = CROWD * k
        known = cells.select(*keys, "level", "code", "n")
        counted = met.join(known, [*keys, "level", "code"], "left")
        load = F.sum(F.coalesce("n", F.lit(SPLIT))).over(Window.partitionBy("_lid"))
        counted = materialize(counted.withColumn("_load", load), "index_counted")
        done = counted.where(F.col("_load") <= limit).drop("n", "_load")
        busy = counted.where(F.col("_load") > limit).drop("_load")
        # a cell's parts: those STEP levels below, and larger ones that are not split
        parts = None
        for step in range(1, STEP + 1):
            p = known.select(*keys, (F.col("level") + step).alias("level"), _around(F.col("code"), step).alias("code"),
                             F.col("level").alias("_part_level"), F.col("code").alias("_part"), F.col("n").alias("_part_n"))
            p = p if step == STEP else p.where((F.col("_part_n") <= SPLIT) | (F.col("_part_level") == 0))
            parts = p if parts is None else parts.unionByName(p)
        for _ in range(ROOT):
            if busy.isEmpty():
                break
            # cells that the manifest doesn't list, or that hold few points, stay as they are
            whole = busy.where(F.col("n").isNull() | (F.col("n") <= SPLIT) | (F.col("level") == 0))
            split = busy.where((F.col("n") > SPLIT) & (F.col("level") > 0)).drop("n").join(parts, [*keys, "level", "code"])
            split = split.drop("level", "code").withColumnsRenamed({"_part_level": "level", "_part": "code", "_part_n": "n"})
            both = whole.withColumn("_new", F.lit(0)).unionByName(split.withColumn("_new", F.lit(1)))
            far = _farthest(F.col("code"), F.col("level"))
            up_to = Window.partitionBy("_lid").orderBy("_far", "level", "code").rowsBetween(Window.unboundedPreceding, 0)
            one = Window.partitionBy("_lid")
            both = both.withColumn("_far", far).withColumn("_sum", F.sum(F.coalesce("n", F.lit(0))).over(up_to))
            both = both.withColumn("_kth", F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(one))
            both = both.withColumn("_ub", F.least("_ub", F.coalesce("_kth", F.lit(2.0))))
            both = both.where(_closest(F.col("code"), F.col("level")) <= F.col("_ub"))
            both = both.withColumns({"_load": F.sum(F.coalesce("n", F.lit(SPLIT))).over(one), "_moved": F.max("_new").over(one)})
            both = materialize(both.drop("_far", "_sum", "_kth", "_new"), "index_split")
            over = (F.col("_load") > limit) & (F.col("_moved") == 1)
            done = done.unionByName(both.where(~over).drop("n", "_load", "_moved"))
            busy = both.where(over).drop("_load", "_moved")
        return done

