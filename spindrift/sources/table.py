"""Vector tables: immutable Parquet snapshots under a manifest, with transactions and savepoints.

A table is a folder: a snapshot is some of its ``v=N`` folders, ``manifest-N.json`` says which, and the manifest of the highest
number is the current one. An insert adds one folder of the new rows; an update or delete writes the snapshot anew. A commit writes the snapshot first and then creates its manifest, which fails if another writer has made
it: so a commit is atomic, and a table has one writer at a time. All files go through the Hadoop file system of the session.

A table of mode ``hnsw`` has an inverted-file index, which knows the snapshot that it covers. A search of another
snapshot (after a change, a rollback, or a new start) first puts the rows of that snapshot into the index's cells, or fits
the cells anew where more than half as many rows have changed as they were fitted on. ``index=N`` and ``index-N.json`` are a
persisted index; the manifest names the last one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from spindrift.functions import vectors as v
from spindrift.operators import knn
from spindrift.operators.ivf import IvfIndex
from spindrift.plans.knn_plan import Predicate
from spindrift.sources import codec
from spindrift.storage import discard, shared_path

MODES = ("hnsw", "exact")
#: Folders of a snapshot at most: an insert into one of so many writes all rows into one.
MAX_FOLDERS = 64
_DECLARED = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}


@dataclass(frozen=True)
class Config:
    name: str
    dim: int
    type: str = "float4"
    metric: str = "l2"
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    mode: str = "hnsw"
    sync_every: int = 1024
    metadata: tuple[tuple[str, str], ...] = ()

    @classmethod
    def parse(cls, name: str, **args) -> Config:
        known = {f for f in cls.__dataclass_fields__ if f != "name"}
        for key in args:
            if key not in known:
                raise ValueError(f"config error: unknown parameter: {key}")
        if "dim" not in args:
            raise ValueError("config error: missing required parameter: dim")
        for key in ("dim", "m", "ef_construction", "ef_search", "sync_every"):
            if key in args:
                try:
                    args[key] = int(args[key])
                except (TypeError, ValueError):
                    raise ValueError(f"config error: invalid {key}: {args[key]}") from None
                if args[key] <= 0:
                    raise ValueError(f"config error: {key} must be positive")
        for key, ok in (("type", v.TYPES), ("metric", v.METRICS), ("mode", MODES)):
            if key in args and args[key] not in ok:
                raise ValueError(f"config error: unknown {'vector ' if key == 'type' else ''}{key}: {args[key]}")
        columns = args.get("metadata", ())
        if isinstance(columns, str):
            columns = [c.split() for c in columns.strip("\"'").split(",") if c.strip()]
        for column in columns:
            if len(column) < 2:
                raise ValueError(f"config error: metadata column without type: {' '.join(column)}")
        args["metadata"] = tuple((c[0], c[1]) for c in columns)
        return cls(name, **args)

    def columns(self) -> list[str]:
        return [c for c, _ in self.metadata]

    def schema(self) -> str:
        own = [f"`{c}` {_DECLARED.get(t.upper(), t)}" for c, t in self.metadata]
        return ", ".join(["id bigint", f"vector array<{v.TYPES[self.type][0]}>", *own])


@dataclass(frozen=True)
class State:
    """What a version of a table is: the folders of its snapshot (none: empty) and counters."""

    snapshot: tuple[int, ...] = ()
    next_id: int = 1
    changes: int = 0
    destructive: bool = False
    total: int = 0
    #: Streams by name, and the last batch of each that was inserted.
    batches: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Covered:
    """The snapshot that an index covers, the table's rows and total of changes when its cells were fitted, and its number if persisted."""

    snapshot: tuple[int, ...]
    rows: int
    total: int
    number: int | None = None


class VectorTable:
    def __init__(self, catalog: Catalog, config: Config, version: int, state: State, saved: int | None = None) -> None:
        self.catalog, self.config, self.version, self.state, self.saved = catalog, config, version, state, saved
        self.stack: list[State] = []
        self.begun: State | None = None
        self.index: IvfIndex | None = None
        self.covered: Covered | None = None

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark

    def rows(self) -> DataFrame:
        """id, vector and the metadata columns."""
        if not self.state.snapshot:
            return self.spark.createDataFrame([], self.config.schema())
        return self.spark.read.schema(self.config.schema()).parquet(*map(self._folder, self.state.snapshot))

    def scan(self) -> DataFrame:
        """The rows with the distance column, which only a search fills."""
        return self.rows().withColumn("distance", F.lit(None).cast("double"))

    def _folder(self, n: int) -> str:
        return f"{self.catalog.root}/{self.config.name}/v={n}"

    def _valid(self, df: DataFrame) -> DataFrame:
        return df.withColumn("vector", F.expr(v.valid("vector", self.config.dim, self.config.type)))

    def _change(self, df: DataFrame, n: int, destructive: bool, next_id: int | None = None, append: bool = False) -> None:
        """A new version, of these rows or with them added: staged inside a transaction, else committed at once."""
        if append and len(self.state.snapshot) >= MAX_FOLDERS:
            df, append = self.rows().unionByName(df), False
        number = self.catalog.next_snapshot(self.config.name)
        df.write.parquet(self._folder(number))
        snapshot = (*self.state.snapshot, number) if append else (number,)
        self.state = replace(self.state, snapshot=snapshot, changes=self.state.changes + n, total=self.state.total + n, destructive=self.state.destructive or destructive, next_id=next_id or self.state.next_id)
        if self.begun is None:
            self._publish()

    def _publish(self) -> None:
        done = self.config.mode == "hnsw" and (self.state.destructive or self.state.changes >= self.config.sync_every)
        if done:
            self._follow(keep=True)
            self.state = replace(self.state, changes=0, destructive=False)
        self._record()

    def _record(self) -> None:
        """A manifest of what is committed: nothing of a transaction that still runs."""
        self.version = self.catalog.publish(self.config, self.version, self.begun or self.state, self.saved)

    def insert(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append rows (vector, and id or metadata as far as there are); ids that are missing continue the highest ever used.

        A vector may come as packed bytes. ``batch`` is a stream's name and the number of its batch, which the commit records: a
        batch that comes again is not inserted again.
        """
        seen_batches = dict(self.state.batches)
        if batch is not None and seen_batches.get(batch[0], -1) >= batch[1]:
            return 0
        have = df.columns
        if isinstance(df.schema["vector"].dataType, BinaryType):
            df = codec.unpack(df, self.config.type, "vector", "vector")
        for c in self.config.columns():
            if c not in have:
                df = df.withColumn(c, F.lit(None))
        declared = dict(self.config.metadata)
        if "id" not in have:
            df = df.withColumn("id", F.lit(None).cast("bigint"))
        df = df.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast(f"array<{'double' if self.config.type in v.FLOATS else v.TYPES[self.config.type][0]}>").alias("vector"), *[F.col(c).cast(_DECLARED.get(t.upper(), t)).alias(c) for c, t in declared.items()])
        # The input is evaluated once, into shared storage; what is counted, numbered and checked is read from there.
        staged = shared_path(self.spark, "staged")
        valid = self._valid(df).withColumn("_at", F.monotonically_increasing_id())
        valid.write.parquet(staged)
        df = self.spark.read.schema(valid.schema).parquet(staged)
        try:
            seen = df.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("given"), F.max("id").alias("high")).first()
            first = max(self.state.next_id, (seen["high"] or 0) + 1)
            rows = df.where("id is not null").drop("_at")
            if seen["n"] > seen["given"]:
                rows = rows.unionByName(_numbered(df.where("id is null").drop("id"), first).select(rows.columns))
            if seen["given"]:
                given = df.where("id is not null").select("id")
                twice = given.groupBy("id").count().where("count > 1").select("id").unionByName(given.join(self.rows().select("id"), "id", "left_semi")).limit(1).collect()
                if twice:
                    raise ValueError(f"UNIQUE constraint failed: {self.config.name}.id = {twice[0]['id']}")
            if batch is not None:
                self.state = replace(self.state, batches=tuple((seen_batches | {batch[0]: batch[1]}).items()))
            self._change(rows, seen["n"], False, first + seen["n"] - seen["given"], append=True)
        finally:
            discard(self.spark, staged)
        return seen["n"]

    def update(self, where: str, **changes: str) -> None:
        """Set columns to SQL expressions where a predicate holds."""
        rows, hit = self.rows(), F.coalesce(F.expr(where), F.lit(False))
        for c, to in changes.items():
            kind = rows.schema[c].dataType
            value = F.expr(v.valid(f"({to})", self.config.dim, self.config.type)) if c == "vector" else F.expr(to)
            changes[c] = F.when(hit, value.cast(kind)).otherwise(F.col(c))
        new = rows.select(*[changes.get(c, F.col(c)).alias(c) for c in rows.columns])
        if "id" in changes and new.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError(f"UNIQUE constraint failed: {self.config.name}.id")
        high = new.agg(F.max("id")).first()[0] or 0
        self._change(new, rows.where(hit).count(), True, max(self.state.next_id, high + 1))

    def delete(self, where: str) -> None:
        rows, hit = self.rows(), F.coalesce(F.expr(where), F.lit(False))
        self._change(rows.where(~hit), rows.where(hit).count(), True)

    def register_sql(self, name: str | None = None) -> str:
        """Make the rows, as they are now, a view of the session, and NAME_knn(query, k) a table function beside it: (id, metadata, distance)."""
        name, c = name or re.sub(r"\W", "_", self.config.name), self.config
        self.rows().createOrReplaceTempView(name)
        kinds = {f.name: f.dataType.simpleString() for f in self.rows().schema}
        columns = ["id", *c.columns()]
        made = v.distance("vector", "query", c.metric, c.type)
        self.spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_knn(query ARRAY<DOUBLE>, k INT) RETURNS TABLE ({', '.join(f'`{x}` {kinds[x]}' for x in columns)}, distance DOUBLE)"
            f" RETURN SELECT {', '.join(f'`{x}`' for x in columns)}, distance FROM (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank_ FROM (SELECT *, {made} AS distance FROM {name})) WHERE rank_ <= {name}_knn.k"
        )
        return name

    def begin(self) -> None:
        self.begun = self.state

    def commit(self) -> None:
        self.begun, self.stack = None, []
        self._publish()

    def rollback(self) -> None:
        if self.begun is not None:
            self.state, self.begun, self.stack = self.begun, None, []

    def savepoint(self) -> int:
        """Remember the state; its number, for release and rollback_to."""
        if self.begun is None:
            self.begin()
        self.stack.append(self.state)
        return len(self.stack) - 1

    def release(self, n: int) -> None:
        del self.stack[n:]

    def rollback_to(self, n: int) -> None:
        self.state = self.stack[n]
        del self.stack[n + 1 :]

    def knn(self, query: Sequence[float], limit: int | None = None, where: Sequence[Predicate] = (), order_by: Sequence[tuple[str, bool]] = (), offset: int = 0) -> DataFrame:
        if len(query) != self.config.dim:
            raise ValueError(f"distance computation on '{self.config.name}' failed: vector dimensions do not match")
        return knn.search(self.rows(), query, self.config.columns(), where, limit, order_by, offset, self.config.metric, kind=self.config.type)

    def select(self, where: Sequence[Predicate] = (), limit: int | None = None, order_by: Sequence[tuple[str, bool]] = (), offset: int = 0) -> DataFrame:
        """Rows by predicates. One may be Predicate("vector", "knn_match", query): then the nearest rows, else all that pass, with a null distance."""
        matches, rest = ([p for p in where if (p.op == "knn_match") == one] for one in (True, False))
        if len(matches) > 1:
            raise ValueError("at most one knn_match constraint is supported per query")
        if matches:
            if matches[0].column != "vector":
                raise ValueError("unable to use function knn_match in the requested context")
            return self.knn(matches[0].value, limit, rest, order_by, offset)
        found = self.scan()
        for p in rest:
            found = found.where(p.sql())
        if order_by:
            found = found.orderBy(*[F.col(c) if up else F.col(c).desc() for c, up in order_by])
        found = found.offset(offset) if offset else found
        return found if limit is None or limit < 0 else found.limit(limit)

    def _indexed(self) -> None:
        if self.config.mode == "exact":
            raise ValueError(f"table '{self.config.name}' uses mode=exact and has no index")

    def _follow(self, refit: bool = False, keep: bool = False) -> IvfIndex | None:
        """The index of the present snapshot, None if it has no rows; ``keep``: persisted in the table's folder."""
        if self.index is None and self.saved is not None and not refit:
            self.index, self.covered = self.catalog.load_index(self.config, self.saved)
        same = self.covered is not None and self.covered.snapshot == self.state.snapshot
        if same and not refit and (self.covered.number is not None or not keep):
            return self.index
        rows, number = self.rows(), self.catalog.next_index(self.config.name) if keep else None
        path = f"{self.catalog.root}/{self.config.name}/index={number}" if keep else shared_path(self.spark, "index")
        if refit or self.index is None or 2 * abs(self.state.total - self.covered.total) > self.covered.rows:
            n = rows.count()
            if not n:
                self.index = self.covered = self.saved = None
                return None
            self.index = IvfIndex.build(rows, max(1, min(self.config.m, n)), self.config.metric, kind=self.config.type, iterations=max(2, self.config.ef_construction // 20), path=path)
            self.covered = Covered(self.state.snapshot, n, self.state.total, number)
        else:
            self.index = self.index.reconcile(rows, path)
            self.covered = replace(self.covered, snapshot=self.state.snapshot, number=number)
        if keep:
            self.catalog.save_index(self.config, self.index, self.covered)
            self.saved = number
        return self.index

    def rebuild_index(self) -> int:
        """Fit the index anew and persist it; the number of rows."""
        self._indexed()
        self._follow(refit=True, keep=True)
        self.state = replace(self.state, changes=0, destructive=False)
        self._record()
        return self.covered.rows if self.covered else 0

    def search_index(self, query: Sequence[float], k: int, nprobe: int | None = None, where: str | None = None) -> DataFrame:
        """Approximate search through the index of the rows as they are now.

        Unless ``nprobe`` is given it probes the cells that the index measured for k, in proportion to ``ef_search`` where that
        is not its default; all cells if there is a predicate.
        """
        self._indexed()
        index = self._follow()
        if index is None:
            return knn.nearest(self.rows(), query, k, self.config.metric, kind=self.config.type)
        probes = index.probes(k, where)
        if where is None:
            probes = -(-probes * self.config.ef_search // Config.ef_search)
        return index.search(query, k, nprobe or probes, where)

    def sync_index(self) -> int:
        """Persist the index of the rows as they are now."""
        self._indexed()
        self._follow(keep=True)
        self.state = replace(self.state, changes=0, destructive=False)
        self._record()
        return 1

    def set_ef_search(self, n: int) -> int:
        if n <= 0:
            raise ValueError("ef_search must be positive")
        self._indexed()
        self.config = replace(self.config, ef_search=n)
        self._record()
        return n

    def index_info(self) -> str:
        c = self.config
        return json.dumps({"rows": self.rows().count(), "dim": c.dim, "type": c.type, "metric": c.metric, "mode": c.mode, "m": c.m, "ef_construction": c.ef_construction, "ef_search": c.ef_search, "sync_every": c.sync_every, "changes_since_persist": self.state.changes})

    def export_arrow(self) -> bytes:
        return codec.vectors_to_ipc(self.rows(), self.config.type)

    def insert_arrow(self, stream: bytes) -> int:
        return self.insert(codec.ipc_to_vectors(self.spark, stream, self.config.type).orderBy("position").select("vector")) if stream else 0


def _numbered(df: DataFrame, first: int) -> DataFrame:
    """Ids from ``first`` on, without gaps, in order of ``_at``: a number inside the partition that made it, plus the rows of those before."""
    from pyspark.sql import Window

    tagged = df.withColumn("_part", F.shiftright("_at", 33))
    counted = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition of the input: that many meet in the unpartitioned window.
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return tagged.join(starts, "_part").withColumn("id", (F.lit(first) + F.col("_before") + within - 1).cast("bigint")).drop("_part", "_at", "_before")


class Catalog:
    """The vector tables under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, VectorTable] = {}

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        path, fs = self._path(f"{self.root}/{name}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def names(self) -> list[str]:
        """The tables that were committed here."""
        return sorted(n for n in self._list("") if any(x.startswith("manifest-") for x in self._list(n)))

    def next_snapshot(self, name: str) -> int:
        return self._next(name, r"v=(\d+)")

    def next_index(self, name: str) -> int:
        return self._next(name, r"index=(\d+)")

    def _next(self, name: str, pattern: str) -> int:
        return 1 + max([int(m[1]) for x in self._list(name) if (m := re.fullmatch(pattern, x))], default=0)

    def _write(self, name: str, content: dict) -> None:
        """A new file; it fails if there is one."""
        path, fs = self._path(name)
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _read(self, name: str) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(name).collect()))

    def publish(self, config: Config, version: int, state: State, saved: int | None = None) -> int:
        self._write(f"{self.root}/{config.name}/manifest-{version + 1:08d}.json", {"config": asdict(config), "snapshot": state.snapshot, "next_id": state.next_id, "changes": state.changes, "total": state.total, "index": saved, "batches": state.batches})
        return version + 1

    def save_index(self, config: Config, index: IvfIndex, covered: Covered) -> None:
        self._write(f"{self.root}/{config.name}/index-{covered.number:08d}.json", {"covered": asdict(covered), "centroids": index.centroids.tolist(), "measured": sorted(index.measured.items())})

    def load_index(self, config: Config, number: int) -> tuple[IvfIndex, Covered]:
        read = self._read(f"{self.root}/{config.name}/index-{number:08d}.json")
        rows = self.spark.read.schema(config.schema() + ", cell int").parquet(f"{self.root}/{config.name}/index={number}")
        return IvfIndex(rows, np.array(read["centroids"]), config.metric, "vector", "id", config.type, dict(map(tuple, read["measured"]))), Covered(**{**read["covered"], "snapshot": tuple(read["covered"]["snapshot"])})

    def create(self, name: str, **args) -> VectorTable:
        config = Config.parse(name, **args)
        if any(x.startswith("manifest-") for x in self._list(name)):
            return self.open(name, **args)
        state = State()
        table = VectorTable(self, config, self.publish(config, 0, state), state)
        self.tables[name] = table
        return table

    def open(self, name: str, **args) -> VectorTable:
        """The table as it was last committed; arguments that are given must agree with what it was made with."""
        found = sorted(x for x in self._list(name) if x.startswith("manifest-"))
        if not found:
            raise KeyError(f"no vector table named {name}")
        read = self._read(f"{self.root}/{name}/{found[-1]}")
        kept = read["config"]
        config = Config(**{**kept, "metadata": tuple(map(tuple, kept["metadata"]))})
        for key in ("dim", "type", "metric", "mode"):
            if key in args and str(args[key]) != str(getattr(config, key)):
                raise ValueError(f"config error: {key} of '{name}' is {getattr(config, key)}, not {args[key]}")
        table = VectorTable(self, config, int(found[-1][9:17]), State(tuple(read["snapshot"]), read["next_id"], read["changes"], total=read["total"], batches=tuple(map(tuple, read["batches"]))), read["index"])
        self.tables[name] = table
        return table

    def get(self, name: str) -> VectorTable:
        """By full name, or by what follows its last dot where that is unique."""
        if name in self.tables:
            return self.tables[name]
        found = [k for k in self.tables if k.rsplit(".", 1)[-1] == name]
        if len(found) > 1:
            raise KeyError(f"ambiguous table name '{name}'; qualify as 'db.{name}'")
        if not found:
            raise KeyError(f"no vector table named {name}")
        return self.tables[found[0]]

    def drop(self, name: str) -> None:
        path, fs = self._path(f"{self.root}/{name}")
        fs.delete(path, True)
        self.tables.pop(name, None)

    def close(self) -> None:
        self.tables.clear()
