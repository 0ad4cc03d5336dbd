"""A store in a folder of any Hadoop file system: runs of Parquet, and a history of edits that says which are live.

A write appends a run and then an edit; both are whole files put in place by renames, so a reader sees a write
or doesn't. An edit's file is named by its number; a writer claims the number first by creating a file that must not be
there, which the file system does atomically (HDFS, local disks, and object stores with conditional puts), so two
writers can't make the same edit: the one that comes second reads the other's, numbers its rows anew and tries again.

Every Options.checkpoint_edits edits the whole state is written as one, from which the next opening starts, so a history
is read in time that doesn't grow with it. Runs are merged in tiers of size once there are Options.level0_runs of them.
"""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import dataclass
from math import log as log_of

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.errors import AlreadyExists, Corruption, InvalidArgument, LockError, NotFound
from kvlake.operators import compact, log, merge, read
from kvlake.sources import wal

logger = logging.getLogger("kvlake")


@dataclass(frozen=True)
class Snapshot:
    sequence: int


@dataclass(frozen=True)
class Options:
    create_if_missing: bool = True
    error_if_exists: bool = False
    comparator: str = "bytewise"
    compression: str = "snappy"
    bloom_filter: bool = True
    rows_per_file: int = 0
    level0_runs: int = 4
    auto_compact: bool = False
    checkpoint_edits: int = 64
    retries: int = 3


class Cursor:
    """A place in the ordered keys of a store at one sequence, before the first at the start; it fetches `page` rows at a time."""

    def __init__(self, store: Store, snapshot: Snapshot | None, page: int):
        self._rows, self._at = [], -1
        self._log, self._page = store.log(), page
        self._seq = (snapshot or Snapshot(store.last_sequence())).sequence

    def _fetch(self, where, forward: bool) -> list:
        found = read.visible(self._log.filter(where), self._seq)
        rows = [(r["k"], r["v"]) for r in found.orderBy("k" if forward else F.desc("k")).limit(self._page).collect()]
        return rows if forward else rows[::-1]

    def valid(self) -> bool:
        return 0 <= self._at < len(self._rows)

    def current(self):
        """The (key, value) here, or None."""
        return self._rows[self._at] if self.valid() else None

    def seek(self, key) -> None:
        """Go to the first key not below key."""
        self._rows, self._at = self._fetch(F.col("k") >= F.lit(key), True), 0

    def seek_to_first(self) -> None:
        self._rows, self._at = self._fetch(F.lit(True), True), 0

    def seek_to_last(self) -> None:
        self._rows = self._fetch(F.lit(True), False)
        self._at = len(self._rows) - 1

    def reset(self) -> None:
        self._rows, self._at = [], -1

    def advance(self) -> bool:
        """Go to the next key; from before the first to the first, from the last out of the valid places."""
        if not self._rows:
            self.seek_to_first()
        elif self.valid():
            self._at += 1
            if self._at == len(self._rows):
                self._rows, self._at = self._fetch(F.col("k") > F.lit(self._rows[-1][0]), True), 0
        return self.valid()

    def prev(self) -> bool:
        """Go to the key before; from the first out of the valid places."""
        if self.valid():
            self._at -= 1
            if self._at < 0:
                self._rows = self._fetch(F.col("k") < F.lit(self._rows[0][0]), False)
                self._at = len(self._rows) - 1
        return self.valid()

    def __iter__(self):
        while self.advance():
            yield self.current()


class Store:
    """open, put, delete, write, get, scan, snapshots, compaction. Keys and values have the types given at creation."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, key_type: str = "string", value_type: str = "string"):
        self.spark, self.path, self.options, self.open = spark, path.rstrip("/"), options or Options(), True
        self.schema = T.StructType.fromDDL(f"k {key_type}, seq long, typ int, v {value_type}")
        self.pinned: dict[int, Snapshot] = {}
        self.refresh()
        if self.edits and self.options.error_if_exists:
            raise AlreadyExists(self.path)
        if not self.edits:
            if not self.options.create_if_missing:
                raise NotFound(f"{self.path} has no history of edits")
            self._edit({"comparator": self.options.comparator, "schema": self.schema.simpleString(), "last_seq": 0, "add": [], "delete": []})
        if self.edits[0]["comparator"] != self.options.comparator:
            raise InvalidArgument(f"the store is ordered by {self.edits[0]['comparator']}")
        if self.edits[0]["schema"] != self.schema.simpleString():
            raise InvalidArgument(f"the store holds {self.edits[0]['schema']}")
        lost = [r for r in self.runs() if not self._exists(f"{self.path}/{r}/_SUCCESS")]
        if lost:
            raise Corruption(f"live runs that are not there: {lost}")

    # Files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def refresh(self) -> None:
        """Read the history from its last checkpoint on; edits are numbered from self.first."""
        self.first, self.edits = 0, []
        if not self._exists(f"{self.path}/edits"):
            return
        fs, p = self._fs(f"{self.path}/edits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        whole = [n for n in names if n.endswith(".whole")]
        if whole:
            self.first = int(whole[-1][:8])
            self.edits.append(json.loads(self._text(f"{self.path}/edits/{whole[-1]}")))
        for n in names:
            if n.endswith(".json") and int(n[:8]) >= self.first + len(whole[-1:]):
                if int(n[:8]) != self.first + len(self.edits):
                    raise Corruption(f"edit {self.first + len(self.edits)} is not there")
                self.edits.append(json.loads(self._text(f"{self.path}/edits/{n}")))

    def _put(self, name: str, edit: dict) -> None:
        """One whole file, or none."""
        fs, tmp = self._fs(f"{self.path}/edits/.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(edit).encode()))
        out.close()
        if self._exists(f"{self.path}/edits/{name}") or not fs.rename(tmp, self._fs(f"{self.path}/edits/{name}")[1]):
            fs.delete(tmp, False)
            raise LockError(f"{name} is there already")

    def _edit(self, edit: dict) -> None:
        """Add an edit, or raise LockError with the history as the other writer left it."""
        number = self.first + len(self.edits)
        fs, claim = self._fs(f"{self.path}/edits/.{number:08d}.claim")
        to = f"{number:08d}.json"
        try:
            if self._exists(f"{self.path}/edits/{to}"):
                raise LockError(f"another writer has made edit {number}")
            fs.create(claim, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception) and "already exists" not in str(e.java_exception):
                raise
            self.refresh()
            if self.first + len(self.edits) == number:  # claimed by a writer that is about to write it, or died
                fs.delete(claim, False)
            raise LockError(f"another writer is making edit {number}") from None
        except LockError:
            self.refresh()
            raise
        try:
            self._put(to, edit)
        finally:
            fs.delete(claim, False)
        self.edits.append(edit)
        logger.info("edit %d: %s", number, edit)
        if len(self.edits) > self.options.checkpoint_edits:
            self.checkpoint()

    def checkpoint(self) -> None:
        """Write the state after all edits as one, under the last one's number; edits before it are not read again."""
        number = self.first + len(self.edits) - 1
        name = f"{number:08d}.whole"
        if number > self.first and not self._exists(f"{self.path}/edits/{name}"):
            state = {"comparator": self.edits[0]["comparator"], "schema": self.edits[0]["schema"], "last_seq": self.last_sequence(), "add": self.runs(), "delete": [], "rows": self.rows(), "streams": self.streams()}
            self._put(name, state)
            self.first, self.edits = number, [state]

    def rows(self) -> dict[str, int]:
        """Rows of each live run."""
        known: dict[str, int] = {}
        for e in self.edits:
            known |= e.get("rows", {})
        return {r: known[r] for r in self.runs() if r in known}

    def streams(self) -> dict[str, int]:
        """The last batch of each stream that the history holds."""
        out: dict[str, int] = {}
        for e in self.edits:
            out |= e.get("streams", {})
        return out

    def runs(self) -> list[str]:
        """Live runs, the oldest first: those added and not deleted since; what runs were merged into stands in their place."""
        live: list[str] = []
        for e in self.edits:
            at = live.index(e["delete"][0]) if e["delete"] and e["delete"][0] in live else len(live)
            live = [r for r in live[:at] if r not in e["delete"]] + e["add"] + [r for r in live[at:] if r not in e["delete"]]
        return live

    def last_sequence(self) -> int:
        return max(e["last_seq"] for e in self.edits)

    def _write_run(self, rows: DataFrame) -> str:
        name = f"runs/{uuid.uuid4().hex}"
        laid = rows.repartitionByRange("k").sortWithinPartitions("k", F.desc("seq"))
        out = laid.write.option("compression", self.options.compression)
        if self.options.bloom_filter:
            out = out.option("parquet.bloom.filter.enabled#k", "true")
        if self.options.rows_per_file:
            out = out.option("maxRecordsPerFile", self.options.rows_per_file)
        out.parquet(f"{self.path}/{name}")
        return name

    # Writes

    def put(self, key, value) -> None:
        self.write(self.spark.createDataFrame([(0, 1, key, value)], self._ops_schema()))

    def delete(self, key) -> None:
        self.write(self.spark.createDataFrame([(0, 0, key, None)], self._ops_schema()))

    def _ops_schema(self) -> T.StructType:
        return T.StructType([T.StructField("pos", T.LongType()), T.StructField("typ", T.IntegerType()), T.StructField("k", self.schema["k"].dataType), T.StructField("v", self.schema["v"].dataType)])

    def write(self, ops: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """Apply ops(pos, typ, k, v) as one batch: all or nothing, in the order of pos. stream: name and number of the batch, which
        is not written again if the history holds it or a later one."""
        self._append(lambda last: log.number(ops, ["pos", "k"], last), stream)

    def write_batches(self, batches: DataFrame) -> None:
        """batches(batch_id, ops) in order, as one commit."""
        self._append(lambda last: log.explode_batches(batches, last))

    def recover(self, path: str, paranoid: bool = True) -> int:
        """Replay the log files that path names: entries after the last sequence come in as they are numbered, as one commit; how many.

        A damaged record is Corruption where paranoid is set, else the rest of its file is passed over.
        """
        found = wal.read_logs(self.spark, path)
        if paranoid and not found.filter("bad").isEmpty():
            raise Corruption(f"damaged records under {path}")
        before = self.last_sequence()
        rows = found.filter(~F.col("bad") & (F.col("seq") > before)).select("k", "seq", "typ", F.when(F.col("typ") == 1, F.col("v")).alias("v"))
        self._append(lambda last: rows.filter(F.col("seq") > last))
        return self.last_sequence() - before

    def _append(self, numbered, stream: tuple[str, int] | None = None) -> None:
        if not self.open:
            raise InvalidArgument("the store is closed")
        for left in range(self.options.retries, -1, -1):
            if stream and self.streams().get(stream[0], -1) >= stream[1]:
                return
            last = self.last_sequence()
            run = self._write_run(numbered(last).select(*[F.col(f.name).cast(f.dataType) for f in self.schema]))
            n, top = self.spark.read.schema(self.schema).parquet(f"{self.path}/{run}").agg(F.count(F.lit(1)), F.coalesce(F.max("seq"), F.lit(last))).first()
            try:
                self._edit({"last_seq": top, "add": [run] if n else [], "delete": [], "rows": {run: n} if n else {}, "streams": dict([stream] if stream else [])})
                break
            except LockError:
                if not left:
                    raise
        if self.options.auto_compact:
            self.maintain()

    def flush(self) -> None:
        """Each write is on disk when it returns."""

    def close(self) -> None:
        self.open = False

    # Reads

    def log(self) -> DataFrame:
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r}" for r in runs])

    def snapshot(self) -> Snapshot:
        snap = Snapshot(self.last_sequence())
        self.pinned[id(snap)] = snap
        return snap

    def release(self, snap: Snapshot) -> None:
        self.pinned.pop(id(snap), None)

    def get(self, key, snapshot: Snapshot | None = None):
        """The value, or None; raises on unreadable files."""
        row = read.get(self.log(), key, snapshot.sequence if snapshot else None).first()
        return None if row is None else row["v"]

    def multi_get(self, probes: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        return read.multi_get(self.log(), probes, snapshot.sequence if snapshot else None)

    def cursor(self, snapshot: Snapshot | None = None, page: int = 1000) -> Cursor:
        return Cursor(self, snapshot, page)

    def scan(self, low=None, high=None, snapshot: Snapshot | None = None, reverse: bool = False) -> DataFrame:
        found = read.scan_range(self.log(), low, high, snapshot.sequence if snapshot else self.last_sequence())
        return found.orderBy(F.desc("k") if reverse else "k")

    # Maintenance

    def _crowded(self) -> list[str]:
        """The newest runs up to a tier of size that has level0_runs of them, if one has; each tier is level0_runs times as large as the one below."""
        runs, rows, most = self.runs(), self.rows(), self.options.level0_runs
        tiers = [int(log_of(max(1, rows.get(r, 1)), max(2, most)) + 1e-9) for r in runs]
        for t in sorted(set(tiers)):
            n = next((i for i, x in enumerate(reversed(tiers)) if x > t), len(runs))
            if tiers[len(runs) - n :].count(t) >= most:
                return runs[len(runs) - n :]
        return []

    def needs_compaction(self) -> bool:
        return bool(self._crowded())

    def maintain(self) -> bool:
        """Merge the newest runs where a tier of size has too many; whether any were. A row is written again once a tier, not at every call."""
        crowded = self._crowded()
        self._merge(crowded, None, None)
        return bool(crowded)

    def compact(self, low=None, high=None) -> None:
        """Drop the versions that neither the oldest pinned snapshot nor later readers see, into one run.

        Every live run takes part, so no older file can hold a deleted key; a failure leaves the history as it was.
        """
        self._merge(self.runs(), low, high)

    def _merge(self, runs: list[str], low, high) -> None:
        bound = min([s.sequence for s in self.pinned.values()], default=self.last_sequence())
        if not runs:
            return
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r}" for r in runs])
        whole = len(runs) == len(self.runs())  # otherwise an older run may hold what a deletion hides
        merged = compact.compact_range(rows, low, high, bound) if whole else compact.compact(rows, bound)
        run = self._write_run(merged)
        n = self.spark.read.parquet(f"{self.path}/{run}").count()
        self._edit({"last_seq": self.last_sequence(), "add": [run], "delete": runs, "rows": {run: n}})

    def delete_obsolete(self) -> list[str]:
        """Remove runs that are not live, and edits before the last checkpoint; open readers of them fail, so this is a call of its own."""
        if not self._exists(f"{self.path}/runs"):
            return []
        fs, p = self._fs(f"{self.path}/runs")
        live = set(self.runs())
        gone = [n for s in fs.listStatus(p) if (n := f"runs/{s.getPath().getName()}") not in live]
        edits, where = self._fs(f"{self.path}/edits")
        for name in [s.getPath().getName() for s in edits.listStatus(where)]:
            if name[:8].isdigit() and int(name[:8]) < self.first:
                edits.delete(self._fs(f"{self.path}/edits/{name}")[1], False)
        for n in gone:
            fs.delete(self._fs(f"{self.path}/{n}")[1], True)
        return gone

    def merge_in(self, other: DataFrame) -> DataFrame:
        """This store's log and another log with the same columns, in internal key order."""
        return merge.merge(self.log(), other)
