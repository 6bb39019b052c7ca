"""The binary files as Spark sources and sinks.

register(spark) makes the formats "signcodes", "signgraph" and "rotation" known. Paths are local ones, or
URIs of a file system that Arrow knows (file, hdfs, s3, gs), and are read by each task by itself, so
they must be ones that all executors see. Codes are read in record ranges, one partition each;
graphs and rotations are parsed whole, one file a partition.

A signcodes sink writes one file: each task writes its sorted run of records beside it, and the
commit puts header and runs together. Rows must be sorted by id over the partitions, as
repartitionByRange("id") and sortWithinPartitions("id") give them, and ids be 0..n-1.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import codes as C
from ..plans.planner import EngineError, GraphStatus, IndexConfig, RotationStatus, StorageStatus
from . import formats as B

CODES_SCHEMA = "id bigint, code binary"
GRAPH_SCHEMA = "kind string, id bigint, level int, layer int, pos int, dst bigint, deleted boolean"
ROTATION_SCHEMA = "row int, coeffs array<float>"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if ":/" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    return fs.FileSystem.from_uri(f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else path)


def _bytes(path: str, status) -> bytes:
    try:
        where, name = _at(path)
        with where.open_input_file(name) as f:
            return f.read()
    except OSError as e:
        raise EngineError(status, str(e)) from e


def _put(path: str, raw: bytes) -> None:
    """Write a file whole: beside its place, and then there."""
    where, name = _at(path)
    draft = f"{name}.draft-{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as f:
        f.write(raw)
    _replace(where, draft, name)


def _replace(where: fs.FileSystem, draft: str, name: str) -> None:
    if not isinstance(where, fs.LocalFileSystem) and where.get_file_info(name).type != fs.FileType.NotFound:
        where.delete_file(name)  # other file systems don't move onto a file
    where.move(draft, name)


# -- codes -------------------------------------------------------------------------------------


@dataclass
class Records(InputPartition):
    first: int
    last: int


class CodesReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.per_partition = int(options.get("recordsperpartition", 1_000_000))

    def header(self) -> B.CodesHeader:
        try:
            where, name = _at(self.path)
            with where.open_input_file(name) as f:
                head, size = f.read(B.CODES_HEADER), f.size()
        except OSError as e:
            raise EngineError(StorageStatus.IO_ERROR, str(e)) from e
        return B.read_codes_header(head, size)

    def partitions(self):
        n = self.header().count
        return [Records(a, min(a + self.per_partition, n)) for a in range(0, n, self.per_partition)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        head = self.header()
        if partition.last == partition.first:
            return
        where, name = _at(self.path)
        with where.open_input_file(name) as f:
            f.seek(B.CODES_HEADER + partition.first * head.record_bytes)
            for a in range(partition.first, partition.last, 65536):
                b = min(a + 65536, partition.last)
                raw = np.frombuffer(f.read((b - a) * head.record_bytes), np.uint8).reshape(b - a, head.record_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array([x.tobytes() for x in raw], pa.binary())], names=["id", "code"])


class CodesWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.dim, self.overwrite = options["path"], int(options["dim"]), overwrite
        self.drafts = f"{self.path}.drafts-{uuid.uuid4().hex}"
        B.codes_header(self.dim, 0)  # refuses a dimension of 0 before any task runs

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        where, folder = _at(self.drafts)
        where.create_dir(folder)
        name, first, last, n = f"{folder}/{uuid.uuid4().hex}", None, None, 0
        with where.open_output_stream(name) as f:
            for row in rows:
                if last is not None and row["id"] != last + 1:
                    raise EngineError(StorageStatus.CORRUPT_SIZE, f"id {row['id']} after {last}")
                code = bytes(row["code"])
                if len(code) != C.padded_bytes(self.dim):
                    raise EngineError(StorageStatus.CORRUPT_SIZE, f"a code of {len(code)} bytes")
                f.write(code)
                first, last, n = row["id"] if first is None else first, row["id"], n + 1
        return Run(TaskContext.get().partitionId(), name, first, n)

    def commit(self, messages) -> None:
        runs = sorted((m for m in messages if m and m.count), key=lambda m: m.first)
        at = 0
        for run in runs:
            if run.first != at:
                raise EngineError(StorageStatus.CORRUPT_SIZE, f"id {at} is missing or repeated")
            at += run.count
        where, name = _at(self.path)
        try:
            if where.get_file_info(name).type != fs.FileType.NotFound and not self.overwrite:
                raise EngineError(StorageStatus.IO_ERROR, "the file is there; use mode overwrite")
            draft = f"{name}.draft-{uuid.uuid4().hex}"
            with where.open_output_stream(draft) as f:
                f.write(B.codes_header(self.dim, at))
                for run in runs:
                    with where.open_input_stream(run.name) as part:
                        while chunk := part.read(1 << 22):
                            f.write(chunk)
            _replace(where, draft, name)
        except OSError as e:
            raise EngineError(StorageStatus.IO_ERROR, str(e)) from e
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        where, folder = _at(self.drafts)
        if where.get_file_info(folder).type == fs.FileType.Directory:
            where.delete_dir(folder)


@dataclass
class Run(WriterCommitMessage):
    partition: int
    name: str
    first: int | None
    count: int


class SignCodes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signcodes"

    def schema(self) -> str:
        CodesReader(self.options).header()
        return CODES_SCHEMA

    def reader(self, schema) -> CodesReader:
        return CodesReader(self.options)

    def writer(self, schema, overwrite: bool) -> CodesWriter:
        return CodesWriter(self.options, overwrite)


# -- graphs and rotations -----------------------------------------------------------------------


class GraphReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.wanted = {k: int(options[k]) for k in ("dim", "capacity", "m") if k in options}

    def partitions(self) -> list[InputPartition]:
        """The file, or a folder's: one for each shard."""
        where, name = _at(self.path)
        if where.get_file_info(name).type != fs.FileType.Directory:
            return [InputPartition("")]
        return [InputPartition(f.base_name) for f in where.get_file_info(fs.FileSelector(name)) if f.base_name.endswith(".graph")] or [InputPartition(None)]

    def read(self, partition) -> Iterator[tuple]:
        if partition.value is None:  # a graph without nodes
            return
        path, known = self.path, None
        if partition.value:  # the file's ids are places in the list beside it
            path = f"{path}/{partition.value}"
            known = np.frombuffer(_bytes(path.removesuffix(".graph") + ".ids", GraphStatus.IO_ERROR), "<i8").tolist()
        g = B.read_graph(_bytes(path, GraphStatus.IO_ERROR), **self.wanted)
        for i, level in g.levels.items():
            yield ("node", i if known is None else known[i], level, None, None, None, i in g.tombstones)
        for (i, layer), targets in g.links.items():
            for pos, dst in enumerate(targets):
                yield ("edge", i if known is None else known[i], None, layer, pos, dst if known is None else known[dst], None)


class SignGraph(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signgraph"

    def schema(self) -> str:
        return GRAPH_SCHEMA

    def reader(self, schema) -> GraphReader:
        return GraphReader(self.options)


class RotationReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dim = options["path"], int(options["dim"]) if "dim" in options else None

    def read(self, partition) -> Iterator[tuple]:
        for i, row in enumerate(B.read_rotation(_bytes(self.path, RotationStatus.IO_ERROR), self.dim)):
            yield (i, [float(x) for x in row])


class Rotation(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rotation"

    def schema(self) -> str:
        return ROTATION_SCHEMA

    def reader(self, schema) -> RotationReader:
        return RotationReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (SignCodes, SignGraph, Rotation):
        spark.dataSource.register(source)


# -- between files and the engine's tables --------------------------------------------------------


def codes_to_binary(codes: DataFrame, dim: int) -> DataFrame:
    """(id, code BINARY) of (id, w0..): the words in little-endian order."""
    hexed = [F.lpad(F.hex(F.col(w)), 16, "0") for w in C.word_names(dim)]
    turned = [F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]) for h in hexed]
    return codes.select("id", F.unhex(F.concat(*turned)).alias("code"))


def binary_to_codes(df: DataFrame, dim: int) -> DataFrame:
    """(id, w0..) of (id, code BINARY)."""

    def word(i: int):
        h = F.hex(F.substring("code", 8 * i + 1, 8))
        big = F.concat(*[F.substring(h, 15 - 2 * j, 2) for j in range(8)])
        high, low = (F.conv(F.substring(big, at, 8), 16, 10).cast("bigint") for at in (1, 9))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return df.select("id", *[word(i).alias(n) for i, n in enumerate(C.word_names(dim))])


def write_codes(codes: DataFrame, path: str, dim: int, partitions: int | None = None) -> None:
    """Write (id, w0..) with ids 0..n-1 as a signcodes file."""
    rows = codes_to_binary(codes, dim)
    rows = rows.repartitionByRange(partitions, "id") if partitions else rows.repartitionByRange("id")
    rows.sortWithinPartitions("id").write.format("signcodes").option("dim", dim).mode("overwrite").save(path)


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, config: IndexConfig, capacity: int) -> None:
    """Write one shard's graph as a file. The format is one graph a file, which must fit the driver."""
    if nodes.select("shard").distinct().count() > 1:
        raise EngineError(GraphStatus.MISMATCH, "a file holds one shard")
    levels, gone = {}, set()
    for r in nodes.select("id", "level", "deleted").toLocalIterator():
        levels[r["id"]] = r["level"]
        if r["deleted"]:
            gone.add(r["id"])
    links: dict[tuple[int, int], list[int]] = {}
    for r in edges.orderBy("src", "layer", "pos").toLocalIterator():
        links.setdefault((r["src"], r["layer"]), []).append(r["dst"])
    entry = min(levels, key=lambda i: (-levels[i], i), default=None)
    _put(path, B.graph_bytes(B.GraphFile(config.dim, capacity, config.m, entry, levels, links, gone)))


def write_shards(path: str, shards: DataFrame, config: IndexConfig) -> None:
    """Write a graph's shards (operators.graph.SHARD) from the workers, a file for each: its nodes by place, and beside it their ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..operators.graph import ShardGraph

        for batch in batches:
            for row in batch.to_dict("records"):
                g = ShardGraph.from_row(row, config)
                links = {(int(i), layer): own[own >= 0].tolist() for layer, (nodes, near) in enumerate(zip(g.nodes, g.links)) for i, own in zip(nodes, near)}
                name = f"{path}/{row['shard']:06d}"
                where, folder = _at(path)
                where.create_dir(folder, recursive=True)
                _put(f"{name}.ids", g.ids.astype("<i8").tobytes())
                _put(f"{name}.graph", B.graph_bytes(B.GraphFile(config.dim, len(g.ids), config.m, g.entry, dict(enumerate(g.level.tolist())), links, set())))
                yield pd.DataFrame({"n": [len(g.ids)]})

    shards.mapInPandas(run, "n bigint").agg({"n": "sum"}).collect()


def read_graph(spark: SparkSession, path: str, **wanted: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a signgraph file, or of a folder that write_shards() made, as shard 0."""
    reader = spark.read.format("signgraph")
    for name, value in wanted.items():
        reader = reader.option(name, value)
    rows = reader.load(path)
    nodes = rows.where("kind = 'node'").select(F.lit(0).alias("shard"), "id", "level", "deleted")
    return nodes, rows.where("kind = 'edge'").select(F.lit(0).alias("shard"), F.col("id").alias("src"), "layer", "pos", "dst")


def write_rotation(path: str, matrix: np.ndarray) -> None:
    _put(path, B.rotation_bytes(matrix))
