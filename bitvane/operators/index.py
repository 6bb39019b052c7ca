"""A vector index as versioned tables: build, insert, delete, restore, replace, grow.

An index is a folder. Segments are Parquet tables (id, embedding, attributes, w0..), each file in order of id; a
manifest, one JSON file a version, names the segments in order, the deletions, the graph's tiers and the
parameters. A row of a later segment replaces an earlier one of the same id. Every mutation writes new tables
beside the old and then creates the next manifest, which fails if another writer has created it: readers keep the
version they opened, and a mutation happens whole or not at all.

Deletions are bitmaps of 32,768 ids: a mutation writes those that it changes, and the latest of each counts. A scan
tests a bit a row.

An index may have a graph, built by build_graph(): tiers, each a small graph for every shard that its rows
fall into. Inserting and reinserting write a tier of the new rows alone, so that what is written is in
proportion to them; a tier that is no larger than what came after it is merged with that, so there are about
as many as the logarithm of the rows. All tiers are searched. A node that a later tier replaces routes, but
is passed over, as deleted ones are, until a merge drops it; so no links are repaired. The graph is published with the
rows it goes with. Searches by method "auto" let the planner choose between the graph and the exact scan, by the
size of the allow-set, and then shard by shard by the cost of a walk; "graph" and "scan" insist.

Attributes are columns that are stored with the rows, and with the graph's shards as arrays. A predicate, a function of a
struct of them (lambda a: a["label"] == 3), filters a scan as a condition on its rows, and a walk in the shard.

Mutations return how many ids they accepted, by the same rules for each id: insert refuses ids out
of range and ids that exist, deleted ones too; remove refuses absent and deleted ids; restore and
reinsert take deleted ids only; grow refuses a smaller capacity. Rows whose id is null, or whose
embedding is null, of another length or holds a null, are not accepted; rejects() tells which.
Of rows that repeat an id in one call, the least by embedding is taken. NaN and infinities stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import codes as C
from ..plans.planner import U32_MAX, IndexConfig, Pool, clamp_kef
from ..sources.scratch import materialize
from . import filters, graph
from . import search as S

#: Rows of a page of a segment, ranges of ids that a read is narrowed to, and deletions that are kept apart.
PAGE_ROWS, RANGES, MOST_DELETIONS = 1024, 64, 16


@dataclass(frozen=True)
class Manifest:
    version: int
    config: str
    capacity: int
    segments: tuple[str, ...]
    deletions: tuple[str, ...] = ()
    graphs: tuple[str, ...] = ()
    applied: int = -1  # the last batch of a stream of changes
    attributes: str = ""  # further columns, as a schema

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {c: list(getattr(self, c)) for c in ("segments", "deletions", "graphs")})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        found = json.loads(text)
        return cls(**found | {c: tuple(found.get(c, ())) for c in ("segments", "deletions", "graphs")})

    def folders(self) -> set[str]:
        return {*self.segments, *self.graphs, *self.deletions}


def _tier_rows(name: str) -> int:
    return int(name.split("-")[2])


class LostRace(Exception):
    """Another writer published the version first; open the index again and repeat the change."""


def accepted_rows(df: DataFrame, dim: int, attributes: Sequence[StructField] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows that can be stored: id, embedding, attributes, null where df has none; the others with a reason)."""
    more = [(F.col(f"`{a.name}`") if a.name in df.columns else F.lit(None)).cast(a.dataType).alias(a.name) for a in attributes]
    rows = df.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), *more)
    reason = (
        F.when(F.col("id").isNull(), "null id")
        .when(F.col("embedding").isNull(), "null embedding")
        .when(F.size("embedding") != dim, "wrong length")
        .when(F.exists("embedding", lambda x: x.isNull()), "null element")
    )
    marked = rows.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, manifest: Manifest, staged: bool = False):
        self.spark, self.path, self.manifest, self.is_staged = spark, path.rstrip("/"), manifest, staged
        self.config = IndexConfig.from_json(manifest.config)
        self.attributes = list(StructType.fromDDL(manifest.attributes)) if manifest.attributes else []

    # -- files -------------------------------------------------------------------------------

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return jpath, jpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def _publish(cls, spark: SparkSession, path: str, manifest: Manifest) -> VectorIndex:
        jpath, fs = cls._fs(spark, path)
        name = jpath(f"{path}/manifest-{manifest.version:09d}.json")
        try:
            out = fs.create(name, False)  # fails if it is there
        except Py4JJavaError as e:
            if fs.exists(name):
                raise LostRace(f"version {manifest.version} of {path} exists") from e
            raise
        try:
            out.write(bytearray(manifest.to_json().encode()))
        finally:
            out.close()
        return cls(spark, path, manifest)

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: IndexConfig, capacity: int, attributes: str = "") -> VectorIndex:
        if not 0 < capacity <= U32_MAX:
            raise ValueError("capacity must be between 1 and 2**32 - 1")
        return cls._publish(spark, path.rstrip("/"), Manifest(1, config.to_json(), capacity, (), attributes=attributes))

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
        """The latest version, or that one."""
        path = path.rstrip("/")
        jpath, fs = cls._fs(spark, path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(jpath(path)) if s.getPath().getName().startswith("manifest-"))
        name = names[-1] if version is None else f"manifest-{version:09d}.json"
        text = "\n".join(r[0] for r in spark.read.text(f"{path}/{name}").collect())  # one small file
        return cls(spark, path, Manifest.from_json(text))

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _write_rows(self, df: DataFrame, kind: str) -> str:
        """A segment of rows (id, embedding, attributes). Its pages are small and in order of id, so that a read of some ids passes over the others'."""
        name = f"{kind}-{uuid.uuid4().hex}"
        coded = C.with_code(df, self.config.dim).select(*self._columns)
        coded.sortWithinPartitions("id").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/{name}")
        return name

    def staged(self) -> VectorIndex:
        """The index with mutations that write tables but no version, until publish()."""
        return VectorIndex(self.spark, self.path, self.manifest, True)

    def publish(self, **changes) -> VectorIndex:
        """All mutations since staged(), as one version."""
        return VectorIndex(self.spark, self.path, self.manifest)._next(**changes)

    def _next(self, **changes) -> VectorIndex:
        if self.is_staged:
            return VectorIndex(self.spark, self.path, replace(self.manifest, **changes), True)
        return self._publish(self.spark, self.path, replace(self.manifest, version=self.manifest.version + 1, **changes))

    # -- tables ------------------------------------------------------------------------------

    @property
    def _columns(self) -> list[str]:
        return ["id", "embedding", *[a.name for a in self.attributes], *C.word_names(self.config.dim)]

    @property
    def _schema(self) -> str:
        more = [f"`{a.name}` {a.dataType.simpleString()}" for a in self.attributes]
        return ", ".join(["id bigint", "embedding array<float>", *more, *[f"{w} bigint" for w in C.word_names(self.config.dim)]])

    def rows(self, ids: Column | None = None) -> DataFrame:
        """(id, embedding, attributes, w0..) of every inserted id, deleted ones too; ids, a condition on id, is pushed into the scans."""
        out = self.spark.createDataFrame([], self._schema)
        for i, name in enumerate(self.manifest.segments):
            segment = self.spark.read.schema(self._schema).parquet(f"{self.path}/{name}")
            segment = segment if ids is None else segment.where(ids)
            if i == 0:
                out = segment
            else:
                # only segments of replacements overlap earlier ones; the join reads their ids alone
                out = (out.join(segment.select("id"), "id", "left_anti") if name.startswith("replaced") else out).unionByName(segment)
        return out

    def deletions(self) -> DataFrame:
        """(bucket, bits): the bitmaps of deleted ids, one for each 32,768 ids that have had any."""
        kind = "bucket bigint, bits binary"
        parts = [self.spark.read.schema(kind).parquet(f"{self.path}/{name}").withColumn("nth", F.lit(i)) for i, name in enumerate(self.manifest.deletions)]
        if len(parts) < 2:
            return parts[0].drop("nth") if parts else self.spark.createDataFrame([], kind)
        return S._union(parts).groupBy("bucket").agg(F.max_by("bits", "nth").alias("bits"))

    def tombstones(self) -> DataFrame:
        """(id) of deleted ids."""
        return filters.ids_of_bitmaps(self.deletions())

    @property
    def has_graph(self) -> bool:
        return bool(self.manifest.graphs)

    def _tier(self, name: str) -> DataFrame:
        kind = graph.SHARD
        if self.attributes:
            kind += ", attributes array<struct<" + ", ".join(f"`{a.name}`: {a.dataType.simpleString()}" for a in self.attributes) + ">>"
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")

    def shards(self, tiers: Sequence[str] | None = None) -> DataFrame:
        """The rows of the graph's tiers: tier, and stale, the ids of the shard that a later tier replaces, null where there are none."""
        names = self.manifest.graphs if tiers is None else tiers
        out = None
        for i, name in enumerate(names):
            part = self._tier(name).withColumn("tier", F.lit(i))
            later = [self._tier(n).select("shard", "ids") for n in names[i + 1 :] if n.startswith("tier-replaced")]
            if later:  # no more ids than the later tiers have in the shard
                stale = S._union(later).groupBy("shard").agg(F.collect_list("ids").alias("of")).select("shard", graph.ids_array("of").alias("stale"))
                part = part.join(stale, "shard", "left")
            else:
                part = part.withColumn("stale", F.lit(None).cast("array<bigint>"))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], graph.SHARD + ", tier int, stale array<bigint>") if out is None else out

    def _own_shards(self) -> DataFrame:
        """Shards with a number of their own in each tier."""
        return self.shards().withColumn("shard", F.col("tier") * self.config.shards + F.col("shard"))

    def nodes(self) -> DataFrame:
        """(shard, id, level, deleted) of the graph, a shard for each shard of a tier; nodes that are replaced are left out, deleted ones aren't."""
        return graph.nodes_of(self._own_shards(), self.tombstones())

    def edges(self) -> DataFrame:
        """(shard, src, layer, pos, dst) of the graph, between the nodes that nodes() gives."""
        return graph.edges_of(self._own_shards(), self.config)

    def codes(self) -> DataFrame:
        return self.rows().drop("embedding")

    def vectors(self) -> DataFrame:
        return self.rows().select("id", "embedding")

    def live(self) -> DataFrame:
        return filters.not_in_bitmaps(self.rows(), self.deletions())

    def _among(self, ids: DataFrame) -> Column:
        """A condition that holds for all of the ids: up to RANGES ranges of ids, from their least to their greatest."""
        width = max(1, -(-self.manifest.capacity // RANGES))
        found = ids.groupBy((F.col("id") / width).cast("bigint")).agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()  # a row a range
        out = F.lit(False)
        for r in found:
            if r["low"] is not None:
                out = out | F.col("id").between(r["low"], r["high"])
        return out

    def vector(self, ids: DataFrame) -> DataFrame:
        """(id, embedding) of the given ids; what lies outside their ranges isn't read."""
        asked = ids.select(F.col("id").cast("bigint").alias("id"))
        return self.rows(self._among(asked)).select("id", "embedding").join(asked, "id", "left_semi")

    def counts(self) -> DataFrame:
        """One row: size (deleted ones too), deleted_count, live_size, capacity, dim, max_ef."""
        size = self.rows().agg(F.count(F.lit(1)).alias("size"))
        gone = self.deletions().agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("deleted_count"))
        both = size.crossJoin(gone)  # of one row each
        return both.select("size", "deleted_count", (F.col("size") - F.col("deleted_count")).alias("live_size"), F.lit(self.manifest.capacity).cast("bigint").alias("capacity"), F.lit(self.config.dim).alias("dim"), F.lit(self.config.max_ef_search).alias("max_ef"))

    # -- mutations: (accepted, the index at its next version) ----------------------------------

    def _clean(self, df: DataFrame) -> DataFrame:
        good, _ = accepted_rows(df, self.config.dim, self.attributes)
        good = good.where((F.col("id") >= 0) & (F.col("id") < self.manifest.capacity))
        return good.groupBy("id").agg(F.min(F.struct(*[F.col(c) for c in good.columns if c != "id"])).alias("row")).select("id", "row.*")

    def rejects(self, df: DataFrame) -> DataFrame:
        """(id, embedding, reason) of the rows that can't be stored, whatever the index holds."""
        good, bad = accepted_rows(df, self.config.dim)
        far = good.where(~((F.col("id") >= 0) & (F.col("id") < self.manifest.capacity))).withColumn("reason", F.lit("id out of range"))
        return bad.unionByName(far)

    def insert(self, df: DataFrame) -> tuple[int, VectorIndex]:
        """Add vectors (id, embedding, attributes) under new ids."""
        new = self._clean(df).join(self.rows().select("id"), "id", "left_anti")
        name = self._write_rows(new, "added")
        written = self.spark.read.schema(self._schema).parquet(f"{self.path}/{name}")
        n = written.count()
        if not n:
            return 0, self
        changes = {"segments": (*self.manifest.segments, name)}
        if self.has_graph:
            changes["graphs"] = self._with_tier(written, n, "added")
        return n, self._next(**changes)

    def _built(self, rows: DataFrame) -> DataFrame:
        shards = graph.build_shards(rows.select("id", *C.word_names(self.config.dim)), self.config)
        return graph.with_attributes(shards, rows, [a.name for a in self.attributes], self.config.shards)

    def _with_tier(self, rows: DataFrame, n: int, kind: str) -> tuple[str, ...]:
        """The tiers with one of the rows more, and those merged that are no larger than what came after them."""
        tiers, first, total = self.manifest.graphs, len(self.manifest.graphs), n
        while first and _tier_rows(tiers[first - 1]) <= total:
            first -= 1
            total += _tier_rows(tiers[first])
        name = self._write(self._built(rows), f"tier-{kind}-{n:012d}")
        if first == len(tiers):
            return (*tiers, name)
        return (*tiers[:first], self._merged((*tiers[first:], name)))

    def _merged(self, tiers: tuple[str, ...]) -> str:
        """One tier of these, without nodes that one of them replaces. Attributes go with the ids."""
        kind = "replaced" if any(t.startswith("tier-replaced") for t in tiers) else "added"
        shards = self.shards(tiers)
        rows = graph.merge_tiers(shards, self.config)
        if self.attributes:
            names = [a.name for a in self.attributes]
            held = shards.select("stale", F.explode(F.arrays_zip(graph.ids_array(F.array("ids")).alias("id"), F.col("attributes").alias("a"))).alias("x"))
            held = held.where("stale IS NULL OR NOT array_contains(stale, x.id)").select("x.id", *[F.col(f"x.a.{n}").alias(n) for n in names])
            rows = graph.with_attributes(rows, held, names, self.config.shards)
        name = self._write(rows, "tier")
        n = self.spark.read.schema(graph.SHARD).parquet(f"{self.path}/{name}").agg(F.sum("n")).first()[0] or 0
        named = f"tier-{kind}-{n:012d}-{name.removeprefix('tier-')}"
        jpath, fs = self._fs(self.spark, self.path)
        fs.rename(jpath(f"{self.path}/{name}"), jpath(f"{self.path}/{named}"))
        return named

    def build_graph(self) -> VectorIndex:
        """The index with a graph over all its rows, of one tier; one that is there is built anew."""
        rows = self.rows()
        return self._next(graphs=(self._write(self._built(rows), f"tier-added-{rows.count():012d}"),))

    def remove(self, ids: DataFrame) -> tuple[int, VectorIndex]:
        """Delete ids softly: they stay stored, and searches pass over them."""
        asked = ids.select(F.col("id").cast("bigint").alias("id")).where("id IS NOT NULL")
        return self._with_deletions(asked.join(self.rows().select("id"), "id", "left_semi"), True)

    def restore(self, ids: DataFrame) -> tuple[int, VectorIndex]:
        """Take deletions back."""
        n, changed = self._with_deletions(ids.select(F.col("id").cast("bigint").alias("id")).where("id >= 0"), False)
        return n, changed

    def _deletions_with(self, ids: DataFrame, gone: bool) -> tuple[int, tuple[str, ...]]:
        """(bits that change, the deletions with the bitmaps that hold them)."""
        name = self._write(filters.changed_bitmaps(self.deletions(), filters.bitmaps_of(ids), gone), "deleted")
        n = self.spark.read.schema("changed bigint").parquet(f"{self.path}/{name}").agg(F.coalesce(F.sum("changed"), F.lit(0))).first()[0]
        deletions = (*self.manifest.deletions, name) if n else self.manifest.deletions
        if len(deletions) > MOST_DELETIONS:
            whole = VectorIndex(self.spark, self.path, replace(self.manifest, deletions=deletions))
            deletions = (self._write(whole.deletions(), "deleted"),)
        return n, deletions

    def _with_deletions(self, ids: DataFrame, gone: bool) -> tuple[int, VectorIndex]:
        n, deletions = self._deletions_with(ids, gone)
        return n, self._next(deletions=deletions) if n else self

    def reinsert(self, updates: DataFrame) -> tuple[int, VectorIndex]:
        """Put new vectors (id, embedding, attributes) in the place of deleted ids, which live again; others stay as they are."""
        name = self._write_rows(filters.in_bitmaps(self._clean(updates), self.deletions()), "replaced")
        taken = self.spark.read.schema(self._schema).parquet(f"{self.path}/{name}")
        n = taken.count()
        if not n:
            return 0, self
        changes = {"segments": (*self.manifest.segments, name), "deletions": self._deletions_with(taken.select("id"), False)[1]}
        if self.has_graph:
            changes["graphs"] = self._with_tier(taken, n, "replaced")
        return n, self._next(**changes)

    def grow(self, capacity: int) -> tuple[bool, VectorIndex]:
        """Admit ids up to capacity; a smaller one is refused, an equal one changes nothing."""
        if not self.manifest.capacity <= capacity <= U32_MAX:
            return False, self
        return True, self._next(capacity=capacity) if capacity > self.manifest.capacity else self

    def compact(self) -> VectorIndex:
        """Rewrite the segments as one, in order of id, the deletions and the graph's tiers too; answers stay the same."""
        graphs = (self._merged(self.manifest.graphs),) if len(self.manifest.graphs) > 1 else self.manifest.graphs
        name = f"added-{uuid.uuid4().hex}"
        self.rows().repartitionByRange("id").sortWithinPartitions("id").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/{name}")
        deletions = (self._write(self.deletions(), "deleted"),) if len(self.manifest.deletions) > 1 else self.manifest.deletions
        return self._next(segments=(name,), graphs=graphs, deletions=deletions)

    def vacuum(self, keep: int = 1) -> int:
        """Delete what none of the last keep versions names, lost writers' tables too; how many folders went.

        For a time when no writer is at work: a table that is being written is named by no version yet.
        """
        jpath, fs = self._fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(jpath(self.path))]
        versions = sorted(n for n in names if n.startswith("manifest-"))
        old = versions[: max(0, len(versions) - max(1, keep))]
        kept: set[str] = set()
        for name in versions[len(old) :]:
            kept |= self.open(self.spark, self.path, int(name[len("manifest-") : -len(".json")])).manifest.folders()
        for name in old:
            fs.delete(jpath(f"{self.path}/{name}"), False)
        gone = [n for n in names if n.split("-")[0] in ("added", "replaced", "deleted", "tier") and n not in kept]
        for name in gone:
            fs.delete(jpath(f"{self.path}/{name}"), True)
        return len(gone)

    # -- searches over the live rows -----------------------------------------------------------

    def pool(self, queries: DataFrame, ef: int, allow: DataFrame | None = None, method: str = "auto", predicate: graph.Predicate | None = None) -> tuple[Pool, DataFrame]:
        """(the access path, (qid, id, distance, rank)): pools of ef, exact by a scan, approximate by the graph."""
        if method not in ("auto", "graph", "scan"):
            raise ValueError(f"no method {method!r}")
        if method == "graph" and not self.has_graph:
            raise ValueError("the index has no graph; build_graph() makes one")
        if predicate is not None and not self.attributes:
            raise ValueError("the index has no attributes")
        path = {"graph": Pool.GRAPH, "scan": Pool.SCAN}.get(method) or filters.choose_pool(allow, ef, self.manifest.capacity, self.config, self.has_graph)
        if path is Pool.GRAPH:
            gone = self.tombstones() if self.manifest.deletions else None
            return path, graph.search_shards(self.shards(), queries, self.config, ef, allow, gone, predicate, method == "graph")
        rows = self.live() if self.manifest.deletions else self.rows()
        if predicate is not None:
            rows = rows.where(predicate(F.struct(*[F.col(a.name) for a in self.attributes])))
        return path, S.pool(rows.select("id", *C.word_names(self.config.dim)), queries, self.config.dim, ef, allow=allow)

    def search(self, queries: DataFrame, k: int, allow: DataFrame | None = None, ef: int | None = None, method: str = "auto", predicate: graph.Predicate | None = None) -> DataFrame:
        """(qid, rank, id, distance) of the k nearest codes; by the graph, of a pool of ef."""
        k, ef = clamp_kef(k, ef or k, self.config.ef_limit)
        if k < 1:
            return S._empty(queries, S.HITS)
        return self.pool(queries, ef, allow, method, predicate)[1].where(F.col("rank") <= k).select("qid", "rank", "id", "distance")

    def search_reranked(self, queries: DataFrame, k: int, ef: int, allow: DataFrame | None = None, method: str = "auto", predicate: graph.Predicate | None = None) -> DataFrame:
        k, ef = clamp_kef(k, ef, self.config.ef_limit)
        found = self.pool(queries, ef, allow, method, predicate)[1] if k >= 1 else None
        return S.search_reranked(self.codes(), queries, self.config.dim, k, ef, self.config.ef_limit, found=found)

    def search_exact_reranked(
        self, queries: DataFrame, k: int, ef: int, allow: DataFrame | None = None, code_queries: DataFrame | None = None, method: str = "auto", predicate: graph.Predicate | None = None
    ) -> DataFrame:
        """Pools by codes, written; then the floats of the pooled ids' ranges are read and scored."""
        k, ef = clamp_kef(k, ef, self.config.ef_limit)
        if k < 1:
            return S._empty(queries, S.SCORED)
        found = materialize(self.pool(code_queries if code_queries is not None else queries, ef, allow, method, predicate)[1].select("qid", "id"), "pool")
        vectors = self.rows(self._among(found)).select("id", "embedding")
        return S.search_exact_reranked(self.codes(), vectors, queries, self.config.dim, k, ef, ef_limit=self.config.ef_limit, found=found)
