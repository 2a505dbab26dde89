"""Search by cells: vectors grouped around K-means centroids, of which a search opens some.

``search`` probes a given number of cells and may miss neighbours. ``search_all`` goes on until none can be missed: every
cell has a radius, the largest angle between its centroid and one of its rows, and angles obey the triangle inequality,
so a cell farther from the query than its radius and the k-th hit so far holds nothing nearer.

Cells are partition folders, so a search opens only the files of probed cells. A cell that holds a
large share of the corpus is written as many files and scored by many tasks, like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import vectors
from tributary.operators import knn
from tributary.session import written_once

MAX_CELLS = 65_536
SLICE_VALUES = 4_000_000  # scores held at once while cells are assigned
ROWS_PER_FILE = 500_000
ROUNDING = 1e-5  # more than what rounding to ``knn.PLACES`` changes in a distance or an angle


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _closest(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` cells nearest to each row, closest first, ties to the smaller number; in slices of bounded size."""
    out = np.zeros((len(rows), n), dtype="int32")
    step = max(1, SLICE_VALUES // len(centroids))
    for start in range(0, len(rows), step):
        away = -np.round(rows[start : start + step] @ centroids.T, 9)
        if n == 1:
            out[start : start + step, 0] = away.argmin(axis=1)
            continue
        kth = np.partition(away, n - 1, axis=1)[:, n - 1 : n]
        row, cell = np.nonzero(away <= kth)
        order = np.lexsort((cell, away[row, cell], row))
        row, cell = row[order], cell[order]
        begins = np.searchsorted(row, np.arange(len(away)))
        out[start : start + step] = cell[begins[:, None] + np.arange(n)[None, :]]
    return out


def _nearest_cells(emb: Column, centroids: np.ndarray, n: int) -> Column:
    """The ``n`` cells whose centroids are nearest, closest first."""

    @F.pandas_udf("array<int>")
    def cells(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        return pd.Series(list(_closest(_unit(np.stack(batch.to_list()).astype("float64")), centroids, n)))

    return cells(emb)


def angles(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Angles between rows of two arrays of unit rows, each with each."""
    return np.arccos(np.clip(rows @ others.T, -1.0, 1.0))


def _home(emb: Column, centroids: np.ndarray) -> Column:
    """The nearest cell and the angle to its centroid; a zero vector has no angle and takes the largest."""

    @F.pandas_udf("cell int, away double")
    def home(batch: pd.Series) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "away": pd.Series([], dtype="float64")})
        unit = _unit(np.stack(batch.to_list()).astype("float64"))
        cell = _closest(unit, centroids, 1)[:, 0]
        away = np.arccos(np.clip((unit * centroids[cell]).sum(axis=1), -1.0, 1.0))
        return pd.DataFrame({"cell": cell, "away": np.where(unit.any(axis=1), away, np.pi)})

    return home(emb)


def _left_to_probe(emb: Column, reach: Column, seen: Column, centroids: np.ndarray, radii: np.ndarray) -> Column:
    """Cells not ``seen`` yet that may hold a row within the distance ``reach`` of the vector."""

    @F.pandas_udf("array<int>")
    def cells(batch: pd.Series, reach: pd.Series, seen: pd.Series) -> pd.Series:
        out = []
        step = max(1, SLICE_VALUES // len(centroids))
        for start in range(0, len(batch), step):
            part = slice(start, start + step)
            unit = _unit(np.stack(batch.iloc[part].to_list()).astype("float64"))
            # Distances are rounded; a query without direction is equally far from all rows.
            most = np.arccos(np.clip(1.0 - reach.iloc[part].to_numpy() - ROUNDING, -1.0, 1.0))
            most = np.where(unit.any(axis=1), most, np.pi) + ROUNDING
            wanted = angles(unit, centroids) - radii <= most[:, None]
            for row, known in zip(wanted, seen.iloc[part]):
                row[np.asarray(known, dtype="int64")] = False
                out.append(np.flatnonzero(row).astype("int32"))
        return pd.Series(out, dtype=object)

    return cells(emb, reach, seen)


@dataclass
class IvfIndex:
    """``rows`` is the corpus with its ``cell`` and ``away``, the angle to its centroid; ``centroids`` is one unit row per cell.

    ``radii`` has the largest angle of each cell; an index that was not stored finds them when it is first asked.
    """

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray | None = None

    @property
    def cells(self) -> int:
        return len(self.centroids)

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """The ``k`` nearest rows among the ``probes`` cells nearest to each query. All cells = exact."""
        probes = min(probes, self.cells)
        probing = queries.withColumn("probe", _nearest_cells(F.col("emb"), self.centroids, probes))
        return knn.nearest(self.rows, probing, k, cells=self.cells)

    def search_all(self, queries: DataFrame, k: int, first: int = 1) -> DataFrame:
        """The ``k`` nearest rows, none missed: ``first`` cells are probed, then those that may still hold a nearer row."""
        return self.opened(queries, k, first)[0]

    def opened(self, queries: DataFrame, k: int, first: int = 1) -> tuple[DataFrame, DataFrame]:
        """What ``search_all`` finds, and ``(query_id, cells)`` with the cells that were opened for it."""
        radii = self._radii()
        probing = written_once(queries.select("query_id", "emb", _nearest_cells(F.col("emb"), self.centroids, min(first, self.cells)).alias("probe")))
        near = written_once(knn.nearest(self.rows, probing, k, cells=self.cells))
        kth = near.groupBy("query_id").agg(F.max("dist").alias("dist"), F.count(F.lit(1)).alias("n"))
        reach = F.when(F.col("n") >= k, F.col("dist")).otherwise(F.lit(2.0))  # 2 is the largest distance
        asked = probing.join(kth, "query_id", "left").select(
            "query_id", "emb", F.col("probe").alias("seen"), F.coalesce(reach, F.lit(2.0)).alias("reach")
        )
        more = _left_to_probe(F.col("emb"), F.col("reach"), F.col("seen"), self.centroids, radii)
        asked = written_once(asked.select("query_id", "emb", "seen", more.alias("probe")))
        rest = knn.nearest(self.rows, asked.where(F.size("probe") > 0), k, cells=self.cells)
        found = knn.ranked(near.drop("rank").unionByName(rest.drop("rank")), k)
        return found, asked.select("query_id", F.concat("seen", "probe").alias("cells"))

    def _radii(self) -> np.ndarray:
        if self.radii is None:
            found = {r["cell"]: r["radius"] for r in self.sizes().collect()}  # one row a cell
            self.radii = np.array([found.get(c, 0.0) for c in range(self.cells)])
        return self.radii

    def sizes(self) -> DataFrame:
        return self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"))

    def write(self, path: str) -> None:
        """Write one folder per cell, in files of about ``ROWS_PER_FILE`` rows, and the centroids."""
        files = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).select("cell", F.ceil(F.col("rows") / ROWS_PER_FILE).alias("_files"))
        spread = self.rows.join(F.broadcast(files), "cell").withColumn(
            "_file", F.pmod(F.xxhash64("id"), F.col("_files"))
        )
        (
            spread.repartition("cell", "_file")
            .drop("_files", "_file")
            .write.mode("overwrite")
            .partitionBy("cell")
            .parquet(f"{path}/rows")
        )
        spark = self.rows.sparkSession
        radii = IvfIndex(spark.read.parquet(f"{path}/rows"), self.centroids)._radii()
        table = [(i, [float(x) for x in row], float(radii[i])) for i, row in enumerate(self.centroids)]
        spark.createDataFrame(table, "cell int, centroid array<double>, radius double").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/centroids")


def build(corpus: DataFrame, cells: int, seed: int = 42, iterations: int = 10) -> IvfIndex:
    """Cluster ``corpus(id, emb)``, all of it, and give every row its cell."""
    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"cells must be 1..{MAX_CELLS}")
    unit = vectors.l2_normalise(F.col("emb")).cast("array<double>")
    features = corpus.select(array_to_vector(unit).alias("features")).persist()
    try:
        model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(features)
    finally:
        features.unpersist()
    return around(corpus, np.array([np.asarray(c, dtype="float64") for c in model.clusterCenters()]))


def around(corpus: DataFrame, centroids: np.ndarray) -> IvfIndex:
    """Cells around given centroids, one row each."""
    if not 1 <= len(centroids) <= MAX_CELLS:
        raise ValueError(f"cells must be 1..{MAX_CELLS}")
    unit = _unit(np.asarray(centroids, dtype="float64"))
    placed = corpus.select("id", "emb", _home(F.col("emb"), unit).alias("home"))
    return IvfIndex(placed.select("id", "emb", "home.cell", "home.away"), unit)


def stored(index: IvfIndex, path: str) -> IvfIndex:
    """The index written to ``path`` and read from there: rows are assigned once, searches open probed cells only."""
    index.write(path)
    return load(index.rows.sparkSession, path)


def load(spark: SparkSession, path: str) -> IvfIndex:
    table = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    radii = np.array([row.radius for row in table])
    return IvfIndex(spark.read.parquet(f"{path}/rows"), np.array([row.centroid for row in table]), radii)


class ExactIndex:
    """The exact scan behind the same ``search`` call."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return knn.nearest(self.rows, queries, k)
