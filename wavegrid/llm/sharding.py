"""Sharding by size-tiered compaction.

Arrivals are written as small immutable Parquet shards, sorted by id. When a tier holds enough shards of similar size, neighbours
are merged into one of the next tier, sorted by id too, until shards have the target size. Merges that would follow on each other are
planned first, from the manifest's sizes alone, and each final shard is then written once, by a task that streams its
parts side by side; no row is shuffled. Names of shards are the same when a task runs again. A manifest version lists the shards that count. It appears by a rename that fails if the version exists, so of
two writers one starts again from the other's version, and readers see whole versions only.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from wavegrid.llm import storage
from wavegrid.llm.common import fresh, limited, shared_dir, trimmed, without


@dataclass(frozen=True)
class Shard:
    name: str
    bytes: int
    rows: int
    number: int  # grows with each shard that is added


_MANIFEST = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("rows", pa.int64()), ("number", pa.int64())])


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def in_order(parts: list[Iterator[pa.RecordBatch]], key: str) -> Iterator[pa.Table]:
    """The rows of sorted parts in the order of key, nulls last; only a batch of each part is held."""
    heads: list[pa.Table | None] = [None] * len(parts)
    while True:
        for i, part in enumerate(parts):
            while part is not None and (heads[i] is None or not heads[i].num_rows):
                batch = next(part, None)
                if batch is None:
                    part = parts[i] = None
                else:
                    heads[i] = pa.Table.from_batches([batch])
        live = [i for i, h in enumerate(heads) if h is not None and h.num_rows]
        if not live:
            return
        # what a part has after its head isn't less than its head's last key
        lasts = [x for i in live if parts[i] is not None and (x := heads[i].column(key)[-1]).is_valid]
        least = min(lasts, key=lambda x: x.as_py(), default=None)
        taken = []
        for i in live:
            column = heads[i].column(key)
            n = heads[i].num_rows if least is None else pc.sum(pc.fill_null(pc.less_equal(column, least), False)).as_py() or 0
            taken.append(heads[i].slice(0, n))
            heads[i] = heads[i].slice(n)
        yield pa.concat_tables(taken).sort_by([(key, "ascending")])


class ShardStore:
    """small, target: bytes of a shard as it arrives, at most, and of a finished one, at least. fan_in: shards of a tier that are merged.

    Rows keep all their columns. Nulls are values like others; rows with a null id stand last in their shard, rows with equal ids in any order, repeated
    rows are all kept. A row of any length is in one shard. Columns shard_number and shard_rows are stored, but read() replaces them.
    """

    def __init__(self, spark: SparkSession, path: str, *, id_col: str = "doc_id", small: int = 4 << 20, target: int = 64 << 20, fan_in: int = 4):
        self.spark, self.path, self.id_col, self.small, self.target, self.fan_in = spark, path.rstrip("/"), id_col, small, target, fan_in

    def versions(self) -> list[int]:
        if not storage.exists(f"{self.path}/manifest"):
            return []
        where, folder = storage.located(f"{self.path}/manifest")
        return sorted(int(f.base_name[1:9]) for f in where.get_file_info(storage.fs.FileSelector(folder)) if f.base_name.startswith("v"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """A version (the last by default) and its shards; 0 and none if there is none."""
        found = self.versions()
        if not found:
            return 0, []
        version = version or found[-1]
        return version, [Shard(**s) for s in storage.read_table(f"{self.path}/manifest/v{version:08d}.arrow").to_pylist()]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Makes the version after base. Raises Conflict if there is one already."""
        version = base + 1
        hidden = f"{self.path}/manifest/_{uuid.uuid4().hex}"
        storage.write_table(hidden, pa.Table.from_pylist([asdict(s) for s in shards], _MANIFEST))
        jvm = self.spark._jvm
        source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (hidden, f"{self.path}/manifest/v{version:08d}.arrow"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExists" in str(e) or storage.exists(f"{self.path}/manifest/v{version:08d}.arrow"):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _committed(self, change) -> int:
        """Commits change(shards), again from the newest version while others come first."""
        while True:
            version, shards = self.manifest()
            new = change(shards)
            if new is None:
                return version
            try:
                return self.commit(version, new)
            except Conflict:
                continue

    def append(self, df: DataFrame) -> int:
        """Adds df's rows as small shards; returns the version. An empty df adds none."""
        path, small, key = f"{self.path}/data/a-{uuid.uuid4().hex}", self.small, self.id_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = number = 0

            def save() -> pa.RecordBatch:
                name, table = f"{path}-{TaskContext.get().partitionId():07d}-{number:05d}.parquet", pa.Table.from_batches(held).sort_by([(key, "ascending")])
                table = table.cast(pa.schema([f.with_nullable(True) for f in table.schema]))
                with storage.creating(name) as out:
                    pq.write_table(table, out, compression="zstd", row_group_size=5000)
                    n = out.tell()
                return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([table.num_rows], pa.int64())], ["name", "bytes", "rows"])

            for batch in batches:
                for begin in range(0, batch.num_rows, 500):
                    piece = batch.slice(begin, 500)
                    held.append(piece)
                    size += piece.nbytes
                    if size >= small:
                        yield save()
                        held, size, number = [], 0, number + 1
            if held:
                yield save()

        added = df.mapInArrow(trimmed(run), "name string, bytes long, rows long").collect()  # a row a shard

        def change(shards: list[Shard]) -> list[Shard] | None:
            first = max([s.number for s in shards], default=-1) + 1
            return [*shards, *(Shard(r.name, r.bytes, r.rows, first + i) for i, r in enumerate(sorted(added, key=lambda r: r.name)))] if added else None

        return self._committed(change)

    def tier(self, size: int) -> int:
        """0 up to small; each next one is fan_in times as large."""
        tier, most = 0, self.small
        while size > most:
            tier, most = tier + 1, most * self.fan_in
        return tier

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups of shards, each to become one. Within a tier the smallest are taken first; a group ends when it reaches the target."""
        tiers: dict[int, list[tuple[int, int, list[Shard]]]] = {}
        for s in shards:
            if s.bytes < self.target:
                heapq.heappush(tiers.setdefault(self.tier(s.bytes), []), (s.bytes, s.number, [s]))
        done: list[list[Shard]] = []
        level = 0
        while level <= max(tiers, default=-1):
            heap = tiers.get(level, [])
            while len(heap) >= self.fan_in:
                size, parts = 0, []
                while heap and len(parts) < self.fan_in and size < self.target:
                    n, _, some = heapq.heappop(heap)
                    size, parts = size + n, [*parts, some]
                merged = [s for some in parts for s in some]
                if size >= self.target:
                    done.append(merged)
                else:
                    heapq.heappush(tiers.setdefault(max(level + 1, self.tier(size)), []), (size, merged[0].number, merged))
            level += 1
        done += [some for heap in tiers.values() for _, _, some in heap if len(some) > 1]
        return done

    def compact(self) -> int:
        """Merges by plan and commits; returns the version. Shards that a merge has replaced stay until vacuum()."""
        while True:
            version, shards = self.manifest()
            groups = self.plan(shards)
            if not groups:
                return version
            path, key = f"{self.path}/data/m-{uuid.uuid4().hex}", self.id_col

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for group, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        name, writer, rows, held = f"{path}-{group:07d}.parquet", None, 0, []
                        with ExitStack() as opened, storage.creating(name) as out:
                            files = [pq.ParquetFile(opened.enter_context(storage.seekable(part))) for part in names]
                            for some in in_order([f.iter_batches(500) for f in files], key):
                                writer = writer or pq.ParquetWriter(out, some.schema, compression="zstd")
                                held.append(some)
                                if sum(t.num_rows for t in held) >= 5000:
                                    writer.write_table(pa.concat_tables(held), row_group_size=5000)
                                    held = []
                                rows += some.num_rows
                            if held:
                                writer.write_table(pa.concat_tables(held), row_group_size=5000)
                            writer.close()
                            n = out.tell()
                        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([rows], pa.int64())], ["g", "name", "bytes", "rows"])

            rows = [(g, [s.name for s in sorted(group, key=lambda s: s.number)]) for g, group in enumerate(groups)]
            work = self.spark.createDataFrame(rows, "g int, names array<string>").repartition(len(rows))
            merged = {r.g: r for r in work.mapInArrow(trimmed(run), "g int, name string, bytes long, rows long").collect()}
            gone = {s.name for group in groups for s in group}
            for g, group in enumerate(groups):
                if merged[g].rows != sum(s.rows for s in group):
                    raise RuntimeError("a merge has lost rows")
            first = max(s.number for s in shards) + 1
            new = [s for s in shards if s.name not in gone] + [Shard(r.name, r.bytes, r.rows, first + g) for g, r in sorted(merged.items())]
            try:
                return self.commit(version, new)
            except Conflict:  # what others have added meanwhile stays; what this call has written isn't listed
                continue

    def vacuum(self) -> int:
        """Deletes shards that the last version doesn't list; older versions can't be read after that. Not to be run beside writers."""
        _, shards = self.manifest()
        kept = {s.name.rpartition("/")[2] for s in shards}
        where, folder = storage.located(f"{self.path}/data")
        old = [f.path for f in where.get_file_info(storage.fs.FileSelector(folder)) if f.base_name not in kept]
        for p in old:
            where.delete_file(p)
        return len(old)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The version's rows with shard_number and shard_rows; columns of these names are replaced."""
        _, shards = self.manifest(version)
        if not shards:
            return without(self.spark.createDataFrame([], schema), ["shard_number", "shard_rows"]).withColumns({"shard_number": F.lit(0).cast("long"), "shard_rows": F.lit(0).cast("long")})
        rows = without(self.spark.read.schema(schema).parquet(*[s.name for s in shards]), ["shard_number", "shard_rows"])
        name = fresh(rows.columns, "wg_shard")
        listed = self.spark.createDataFrame([(s.name.rpartition("/")[2], s.number, s.rows) for s in shards], f"`{name}` string, shard_number long, shard_rows long")
        return rows.withColumn(name, F.substring_index(F.input_file_name(), "/", -1)).join(limited(listed, 1_000_000), name).drop(name)  # a row a shard


def shard_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", arrivals: int = 4, **options) -> ShardStore:
    """docs in arrivals by ranges of ids, each appended and followed by a compaction. Rows with a null id come with the first; without rows there is no shard."""
    store = ShardStore(docs.sparkSession, path, id_col=id_col, **options)
    key = F.col(f"`{id_col}`")
    cuts = docs.agg(F.percentile_approx(key.cast("long"), F.array(*[F.lit(k / arrivals) for k in range(1, arrivals)]), 1000)).first()[0] if arrivals > 1 else []
    cuts = sorted(set(cuts or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        mine = key.isNull() if low is None else key > low
        part = docs.where((mine | (key <= high)) if low is None and high is not None else mine & (key <= high) if high is not None else mine) if cuts else docs
        store.append(part)
        store.compact()
        store.vacuum()
    return store


def op5_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = shard_documents(docs, shared_dir(spark, "shards"))
    return store.read(docs.schema).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "shard_number", "shard_rows")
