"""A stored vector index: deltas of changes over a base that is partitioned by inverted list.

A write adds a delta and commits the next manifest, as the memory store does. compact merges all into a new base, newest
first, with list centres that are kept beside it, so an approximate search reads the folders of its lists only.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, invalid
from ..functions import filters
from ..functions.vectors import block, metric_name
from ..operators import changes, knn
from .files import Commits, Files

BASE = "id BIGINT, embedding ARRAY<FLOAT>, metadata MAP<STRING,ARRAY<STRING>>, list_id INT"
#: Deltas that may gather before they are merged.
COMPACT_AT = 16


def matrix(values: np.ndarray, dims: int) -> np.ndarray:
    """Vectors as rows: a C-contiguous float32 array of one or two dimensions, which is not copied."""
    if not isinstance(values, np.ndarray) or values.dtype != np.float32:
        raise TypeError("vectors must be a float32 array")
    if values.ndim not in (1, 2) or not values.flags.c_contiguous:
        raise ValueError("vectors must be a C-contiguous array of one or two dimensions")
    rows = values.reshape(1, -1) if values.ndim == 1 else values
    if rows.shape[1] != dims:
        raise EngineError("DimensionMismatch", "vectors have other dimensions than the index")
    return rows


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, dims: int, metric: str = "l2"):
        if dims <= 0:
            raise invalid("dims must be positive")
        self.spark, self.path, self.dims, self.metric = spark, path.rstrip("/"), dims, metric_name(metric)
        self.files = Files(spark)
        self.commits = Commits(self.files, self.path)
        m = self.commits.latest()
        if m is None:
            m = self.commits.follow({"dims": dims, "metric": self.metric, "commit": 0, "base": None, "lists": 0, "deltas": [], "next_id": 1})
        if m["dims"] != dims or m["metric"] != self.metric:
            raise invalid("the index was made with another metric or other dimensions")
        self.manifest = m

    # ------------------------------------------------ writing

    def insert(self, values: np.ndarray, metadata: list[dict[str, list[str]] | None] | None = None) -> list[int]:
        """Adds vectors under new ids, which follow the highest id ever used; returns them."""
        rows = matrix(values, self.dims)
        if metadata is not None and len(metadata) != len(rows):
            raise invalid("metadata must be given for each vector")
        ids = np.arange(self.manifest["next_id"], self.manifest["next_id"] + len(rows), dtype=np.int64)
        self._add(self._frame(ids, rows, metadata))
        return ids.tolist()

    def insert_with_ids(self, ids: list[int], values: np.ndarray, metadata: list[dict[str, list[str]] | None] | None = None) -> None:
        """Adds or replaces vectors by id, the last of equal ids; without metadata an id keeps its own."""
        rows = matrix(values, self.dims)
        if len(ids) != len(rows) or (metadata is not None and len(metadata) != len(rows)):
            raise invalid("an id, and metadata if any, must be given for each vector")
        last = {i: k for k, i in enumerate(ids)}
        at = list(last.values())
        self._add(self._frame(np.array(list(last), np.int64), rows[at], None if metadata is None else [metadata[k] for k in at]))

    def load(self, rows: DataFrame) -> None:
        """Adds or replaces the rows of a frame (id, embedding, and metadata if any), one row an id, without passing the driver."""
        ok = F.assert_true((F.size("embedding") == self.dims) & F.col("id").isNotNull(), F.lit("DimensionMismatch")).isNull()
        meta = F.col("metadata") if "metadata" in rows.columns else F.lit(None)
        self._add(rows.where(ok).select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"), meta.cast("map<string,array<string>>").alias("metadata")))

    def delete(self, vec_id: int) -> bool:
        """Deletes a vector; whether it was there. Its id is not used again."""
        found = not self.rows().where(F.col("id") == vec_id).isEmpty()
        if found:
            gone = self.spark.createDataFrame([(vec_id, None, None)], "id long, embedding array<float>, metadata map<string,array<string>>")
            self._add(gone, "delete")
        return found

    def _frame(self, ids: np.ndarray, rows: np.ndarray, metadata: list | None) -> DataFrame:
        flat = pa.array(np.ascontiguousarray(rows).ravel())
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, self.dims, dtype=np.int32)), flat)
        kept = pa.array([None if m is None else list(m.items()) for m in metadata or [None] * len(ids)], pa.map_(pa.string(), pa.list_(pa.string())))
        return self.spark.createDataFrame(pa.table({"id": pa.array(ids), "embedding": vectors, "metadata": kept}))

    def _add(self, rows: DataFrame, op: str = "upsert") -> None:
        m = self.manifest
        name = f"delta-{m['commit'] + 1}-{uuid.uuid4().hex[:12]}"
        out = rows.select(F.lit(m["commit"] + 1).cast("long").alias("seq"), F.lit(op).alias("op"), "id", "embedding", "metadata")
        out.write.parquet(f"{self.path}/{name}")
        top = self.spark.read.schema(changes.CHANGES).parquet(f"{self.path}/{name}").agg(F.max("id")).first()[0]
        self.manifest = self.commits.follow(m | {"deltas": [*m["deltas"], name], "next_id": max(m["next_id"], (top or 0) + 1)})
        if len(self.manifest["deltas"]) >= COMPACT_AT:
            self.compact()

    def compact(self, lists: int | None = None) -> int:
        """Merges base and deltas into a new base with new lists; deleted rows go. Returns the rows it holds.

        Centres come from a bounded sample (knn.centroids); every row is assigned. Older files stay for readers until clean_up."""
        m, live = self.manifest, self.rows()
        n = live.count()
        name = f"base-{m['commit'] + 1}-{uuid.uuid4().hex[:12]}"
        many = min(lists or knn.default_lists(n), max(1, n))
        centres = knn.centroids(live, "embedding", many) if n else np.zeros((0, self.dims))
        if n:
            knn.with_list(live.select("id", "embedding", "metadata"), centres).repartition("list_id").write.partitionBy("list_id").parquet(f"{self.path}/{name}/rows")
        self.files.write_json(f"{self.path}/{name}/centres.json", {"centres": centres.tolist()})
        self.manifest = self.commits.follow(m | {"base": name if n else None, "lists": len(centres), "deltas": []})
        return n

    def drain(self) -> DataFrame:
        """The live rows, after which the index is empty; the frame reads files that stay until clean_up."""
        live = self.rows()
        self.manifest = self.commits.follow(self.manifest | {"base": None, "lists": 0, "deltas": []})
        return live

    def clean_up(self, grace_ms: int = 3_600_000) -> int:
        """Deletes files that the last commit does not name and that are older than a grace period; returns how many."""
        kept = {self.manifest["base"], *self.manifest["deltas"]}
        gone = [n for n in self.files.old_names(self.path, grace_ms) if n.startswith(("base-", "delta-")) and n not in kept]
        for name in gone:
            self.files.delete(f"{self.path}/{name}")
        return len(gone)

    # ------------------------------------------------ reading

    def _base(self) -> DataFrame:
        if self.manifest["base"] is None:
            return self.spark.createDataFrame([], BASE)
        return self.spark.read.schema(BASE).parquet(f"{self.path}/{self.manifest['base']}/rows")

    def _deltas(self) -> DataFrame:
        if not self.manifest["deltas"]:
            return self.spark.createDataFrame([], changes.CHANGES)
        return self.spark.read.schema(changes.CHANGES).parquet(*[f"{self.path}/{n}" for n in self.manifest["deltas"]])

    def _centres(self) -> np.ndarray:
        kept = self.files.read_json(f"{self.path}/{self.manifest['base']}/centres.json") if self.manifest["base"] else None
        return np.array(kept["centres"] if kept else [], np.float64).reshape(-1, self.dims)

    def _parts(self) -> tuple[DataFrame, DataFrame | None]:
        """Rows of the base that no delta touches, with their lists, and live rows of the deltas."""
        base = self._base()
        if not self.manifest["deltas"]:
            return base, None
        last = changes.settled(self._deltas())
        old = base.select("id", F.col("metadata").alias("had"))
        kept = F.coalesce(F.col("metadata"), F.when(~F.col("fresh"), F.col("had"))).alias("metadata")
        return base.join(last.select("id"), "id", "left_anti"), last.where("op <> 'delete'").join(old, "id", "left").select("id", "embedding", kept)

    def rows(self) -> DataFrame:
        """(id, embedding, metadata) of the live rows; a base without deltas is read without a shuffle."""
        base, news = self._parts()
        base = base.select("id", "embedding", "metadata")
        return base if news is None else base.unionByName(news)

    def search(self, query: list[float], k: int, where: dict | None = None) -> DataFrame:
        """The k nearest live rows by (distance, id), exactly; where is a filter in the wire grammar."""
        return knn.top_k(self.rows(), query, k, self.metric, None if where is None else filters.parse(where))

    def probe(self, query: list[float], k: int, probes: int, where: dict | None = None) -> DataFrame:
        """As search, but of the base only the lists with the nearest centres are read, by folder; deltas are read whole. Where
        fewer than k rows pass, probes double until k do or all lists are read."""
        if len(query) != self.dims:
            raise EngineError("DimensionMismatch", "the query has other dimensions than the index")
        centres, (base, news) = self._centres(), self._parts()
        order = np.argsort(block("l2", np.array([query], np.float64), centres)[0], kind="stable") if len(centres) else np.zeros(0, int)
        keep = None if where is None else filters.parse(where)
        while True:
            rows = base.where(F.col("list_id").isin(order[:probes].tolist())).select("id", "embedding", "metadata")
            found = knn.top_k(rows if news is None else rows.unionByName(news), query, k, self.metric, keep)
            if probes >= len(order) or found.count() >= k:
                return found
            probes *= 2

    def counts(self) -> DataFrame:
        """delta_len (ids that deltas hold live), num_sealed (bases), physical_len (stored rows) and len (live rows)."""
        base, news = self._parts()
        fresh = 0 if news is None else news.count()
        row = fresh, int(self.manifest["base"] is not None), self._base().count() + self._deltas().count(), base.count() + fresh
        return self.spark.createDataFrame([row], "delta_len long, num_sealed long, physical_len long, len long")
