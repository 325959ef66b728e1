"""An inverted-file index for nearest neighbours by cosine distance: cells around centroids, for each register and axis.

Centroids are fitted on a bounded sample; every row that has a vector is stored in the cell of its nearest centroid, as Parquet
partitioned by register, axis and cell. A search reads the cells whose centroids are nearest to the seed. A cell's reach, the largest angle between its centroid and a
member, bounds from below how near its members can be, so a search can also go on until no unread cell can hold a nearer row: then it is exact,
and still reads only some of the cells. Inserts append to their cells.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylespark.functions.vectors import dot
from stylespark.runtime import settled, ship

#: Sampled rows a cell, and in all, that centroids are fitted on; cells of a register and axis; passes of the fit.
SAMPLE_A_CELL, SAMPLE, MOST_CELLS, PASSES = 64, 65_536, 1024, 12
#: Cells that a search reads if not told otherwise; angles are compared with so much room for rounding.
PROBES, ROOM = 8, 1e-6
CENTROIDS = "register string, axis string, cell int, centroid array<double>"
REACH = "register string, axis string, cell int, reach double, many long"


def spherical_means(x: np.ndarray, cells: int, passes: int = PASSES) -> np.ndarray:
    """Unit centroids of unit rows: first rows that are far from those before, then means in turn. No more than there are distinct rows; rows of no length don't count."""
    x = np.unique(x[np.linalg.norm(x, axis=1) > 0.5], axis=0)
    cells = min(cells, len(x))
    if not cells:
        return np.zeros((1, x.shape[1]))
    chosen, near = [0], x @ x[0]
    while len(chosen) < cells:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centre = x[chosen]
    for _ in range(passes):
        own = (x @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centre)
    return centre


def _unit(vectors: list, dim: int) -> np.ndarray:
    x = np.array(vectors, float).reshape(len(vectors), dim)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class VectorIndex:
    """Cells below one folder. Axes are the exemplars' vector columns."""

    def __init__(self, spark: SparkSession, path: str, axes: tuple[str, ...] = ("style_embedding", "content_embedding")) -> None:
        self.spark, self.path, self.axes = ship(spark), path.rstrip("/"), axes

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def _members(self) -> str:
        return f"{self._key_type()}, vector array<double>, register string, axis string, cell int"

    def _key_type(self) -> str:
        meta = self.spark.read.text(f"{self.path}/key").first()[0]
        return f"id {json.loads(meta)}"

    def members(self) -> DataFrame:
        """id, vector (of length 1), register, axis, cell: a row for every indexed vector."""
        return self._table("members", self._members)

    def centroids(self) -> DataFrame:
        return self._table("centroids", CENTROIDS)

    def cells(self) -> DataFrame:
        """register, axis, cell, centroid, reach, many. One row a cell: small."""
        reach = self._table("reach", REACH).groupBy("register", "axis", "cell").agg(F.max("reach").alias("reach"), F.sum("many").alias("many"))
        return self.centroids().join(reach, ["register", "axis", "cell"])

    def _long(self, rows: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("array<double>").alias("vector")) for a in self.axes])).alias("e")
        return rows.select("id", "register", each).select("id", "register", "e.axis", "e.vector").where("vector is not null and register is not null")

    def build(self, rows: DataFrame, cells: int | None = None) -> VectorIndex:
        """Fit and store. rows: id, register, and the axes (null: not indexed). cells: of each register and axis, about the root of its rows if not given.

        At most SAMPLE_A_CELL rows a cell and SAMPLE rows of a register and axis are drawn, by a hash of id, and fitted on the driver."""
        kind = rows.schema["id"].dataType.simpleString()
        self.spark.createDataFrame([(json.dumps(kind),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/key")
        long = self._long(rows)
        counts = {(r.register, r.axis): r["count"] for r in long.groupBy("register", "axis").count().collect()}  # registers by axes
        many = {k: cells or max(1, min(MOST_CELLS, math.isqrt(n))) for k, n in counts.items()}
        wanted = {k: min(SAMPLE, SAMPLE_A_CELL * many[k]) for k in counts}
        rate = self.spark.createDataFrame([(*k, min(1.0, wanted[k] / n)) for k, n in counts.items()], "register string, axis string, rate double")
        place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
        sample = long.join(F.broadcast(rate), ["register", "axis"]).where(place < F.col("rate")).select("register", "axis", "vector")
        drawn: dict[tuple, list] = {}
        for r in sample.toLocalIterator():
            drawn.setdefault((r.register, r.axis), []).append(r.vector)
        out = []
        for (register, axis), n in many.items():
            vectors = drawn.get((register, axis)) or [long.where((F.col("register") == register) & (F.col("axis") == axis)).first().vector]
            out += [(register, axis, k, c.tolist()) for k, c in enumerate(spherical_means(_unit(sorted(vectors), len(vectors[0])), n))]
        self.spark.createDataFrame(out, CENTROIDS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        self._store(long, "overwrite")
        return self

    def insert(self, rows: DataFrame) -> VectorIndex:
        """Append rows to the cells of the centroids as they are. A register or axis that the index was built without needs a build."""
        self._store(self._long(rows), "append")
        return self

    def _store(self, long: DataFrame, mode: str) -> None:
        centres: dict[tuple, list] = {}
        for r in self.centroids().orderBy("register", "axis", "cell").collect():  # at most MOST_CELLS a register and axis
            centres.setdefault((r.register, r.axis), []).append(r.centroid)
        shared = self.spark.sparkContext.broadcast({k: np.array(v) for k, v in centres.items()})
        schema = T.StructType([long.schema["id"], *T.StructType.fromDDL("register string, axis string, vector array<double>, cell int, angle double").fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
                vectors, cell, angle = batch.column(3).to_pylist(), np.zeros(len(keys), int), np.zeros(len(keys))
                unit: list = [None] * len(keys)
                for key in set(keys):
                    if key not in shared.value:
                        raise ValueError(f"the index wasn't built with {key}")
                    own = [i for i, k in enumerate(keys) if k == key]
                    x = _unit([vectors[i] for i in own], shared.value[key].shape[1])
                    near = x @ shared.value[key].T
                    cell[own], angle[own] = near.argmax(1), np.arccos(np.clip(near.max(1), -1, 1))
                    for i, v in zip(own, x.tolist(), strict=True):
                        unit[i] = v
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(unit, pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(angle)], names=[f.name for f in schema])

        placed = long.mapInArrow(run, schema)
        path = f"{self.path}/members"
        # Rows of a cell are dealt to a few files each, so that a hot cell isn't one task.
        placed.drop("angle").repartition("register", "axis", "cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode(mode).partitionBy("register", "axis", "cell").parquet(path)
        reach = placed.groupBy("register", "axis", "cell").agg(F.max("angle").alias("reach"), F.count("*").alias("many"))
        reach.coalesce(1).write.mode(mode).parquet(f"{self.path}/reach")

    def _ordered_cells(self, register: str, axis: str, seed: np.ndarray) -> list[tuple[float, int]]:
        """(least angle that a member can have, cell) of every cell, the one of the nearest centroid first."""
        rows = self.cells().where((F.col("register") == register) & (F.col("axis") == axis)).collect()  # at most MOST_CELLS
        angles = [(math.acos(max(-1.0, min(1.0, float(np.dot(seed, r.centroid))))), r) for r in rows]
        return [(max(0.0, a - r.reach - ROOM), r.cell) for a, r in sorted(angles, key=lambda x: (x[0], x[1].cell))]

    def _distances(self, register: str, axis: str, cells: list[int], seed: np.ndarray) -> DataFrame:
        """id and distance in the given cells; their folders alone are read."""
        own = self.members().where((F.col("register") == register) & (F.col("axis") == axis) & F.col("cell").isin(cells))
        return own.select("id", _distance(F.col("vector"), F.array(*map(F.lit, seed.tolist()))).alias("distance"))

    def nearest(self, register: str, axis: str, seed: list[float], k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """id, distance of the k rows nearest to the seed, ties by id. By the `probes` nearest cells, and more while these hold fewer than k rows;
        or exact: then until no other cell can hold a row as near as the k-th."""
        point = _unit([seed], len(seed))[0]
        cells = self._ordered_cells(register, axis, point)
        at = probes
        got = self._distances(register, axis, [c for _, c in cells[:at]], point).orderBy("distance", "id").limit(k)
        while at < len(cells):
            rows = got.collect()  # k rows
            short = len(rows) < k
            if not short and not exact:
                break
            limit = math.inf if short else math.acos(max(-1.0, min(1.0, 1 - rows[-1].distance))) + ROOM
            more = [c for low, c in cells[at:] if low <= limit] if exact else [c for _, c in cells[at : 2 * at]]
            if not more:
                break
            at = len(cells) if exact else 2 * at
            read = [c for _, c in cells[:probes]] + more if exact else [c for _, c in cells[:at]]
            got = self._distances(register, axis, read, point).orderBy("distance", "id").limit(k)
        return got

    def search(self, queries: DataFrame, axis: str, k: int, probes: int = PROBES) -> DataFrame:
        """query, id, distance, place: the k nearest rows of each query's register, exact, ties by id. queries: query (unique), register, vector.

        First by the `probes` nearest cells of each query, then by those that can still hold a row as near as its k-th one. Queries and members
        meet by cell, in joins that Spark splits where a cell is hot; no query meets a cell that can't matter. Queries may be any number: what is
        broadcast are the cells, at most MOST_CELLS a register."""
        cells = self.cells().where(F.col("axis") == axis).groupBy("register").agg(F.collect_list(F.struct("cell", "centroid", "reach")).alias("cells"))
        asked = settled(queries.where("vector is not null").select("query", "register", _unit_column(F.col("vector").cast("array<double>")).alias("point")), "queries")

        def seen(c: Column) -> Column:
            angle = _angle(dot(F.col("point"), c["centroid"]))
            return F.struct(angle.alias("angle"), c["cell"].alias("cell"), F.greatest(F.lit(0.0), angle - c["reach"] - ROOM).alias("low"))

        near = asked.join(F.broadcast(cells), "register").select("query", "register", "point", F.sort_array(F.transform("cells", seen)).alias("near"))
        first = settled(self._met(near.select("query", "register", "point", F.explode(F.transform(F.slice("near", 1, probes), lambda c: c["cell"])).alias("cell")), axis, k), "first-cells")
        limit = first.groupBy("query").agg(F.when(F.count("*") >= k, _angle(1 - F.max("distance")) + ROOM).alias("limit"))
        left = F.filter(F.slice("near", F.lit(probes + 1), F.greatest(F.lit(0), F.size("near") - probes)), lambda c: F.col("limit").isNull() | (c["low"] <= F.col("limit")))
        rest = near.join(limit, "query", "left").select("query", "register", "point", F.explode(F.transform(left, lambda c: c["cell"])).alias("cell"))
        both = first.drop("place").unionByName(self._met(rest, axis, k).drop("place"))
        best = Window.partitionBy("query").orderBy("distance", "id")
        return both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query", "id", "distance", "place")

    def _met(self, asked: DataFrame, axis: str, k: int) -> DataFrame:
        members = self.members().where(F.col("axis") == axis).select("id", "vector", "register", "cell")
        pairs = asked.join(members, ["register", "cell"]).select("query", "id", _distance(F.col("vector"), F.col("point")).alias("distance"))
        best = Window.partitionBy("query").orderBy("distance", "id")
        return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _distance(x: Column, y: Column) -> Column:
    """Of vectors of length 1 (or 0, at distance 1 from all)."""
    return F.greatest(F.lit(0.0), 1 - dot(x, y))


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _unit_column(x: Column) -> Column:
    size = F.sqrt(dot(x, x))
    return F.when(size == 0, x).otherwise(F.transform(x, lambda v: v / size))
