"""A catalog in versions: sorted runs of changes that are merged on read, and a manifest for each snapshot.

A batch is written as one run of its own, sorted by id; nothing that is there already is read or written again. A
manifest names the files of a snapshot with their least and greatest id, so that look-ups open few of them. Runs of
like size are merged once there are several, so each row is written anew a logarithmic number of times. Snapshots share
runs: an incremental one begins with the files of the last good one, a full one begins with none, and either can be
read beside the others until ``clean`` takes what nobody needs.

Of the rows of an id the one with the latest datestamp counts, and the one written later if they are equal: a page
that is read late does not bring an older record back.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.model import SnapshotStatus as S
from colophon.operators import snapshots as rules
from colophon.operators.catalog import last_write

CATALOG = "id string, identifier string, datestamp timestamp, original_metadata_hash string, deleted boolean"
SNAPSHOTS = "id long, network_id long, previous_id long, status int, start_time timestamp, end_time timestamp, deleted boolean, size long"

#: Runs that are merged at once, at least; a run is merged with newer ones that together have its size.
FAN_IN = 4
#: Rows of a partition and a file of a run, up to the session's number of partitions.
PART_ROWS = 50_000
_OPEN = [int(s) for s in (S.INITIALIZED, S.HARVESTING, S.RETRYING)]


@dataclass
class File:
    """A file of a run: its place under the catalog, the run's number, and what it holds."""

    path: str
    run: int
    rows: int
    bytes: int
    low: str
    high: str


@dataclass
class Snapshot:
    """What a manifest says. ``batches`` has the last batch of each query, ``step`` counts the manifests written."""

    id: int
    previous_id: int | None
    status: int
    start_time: str
    source: str = ""
    end_time: str | None = None
    deleted: bool = False
    size: int | None = None
    step: int = 0
    next_run: int = 1
    batches: dict[str, int] = field(default_factory=dict)
    files: list[File] = field(default_factory=list)


def _now() -> str:
    return datetime.now(UTC).isoformat()


class Versions:
    """The catalog under a folder that driver and executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, network_id: int = 0):
        self.spark, self.path, self.network_id = spark, path.rstrip("/"), network_id

    # ---- manifests ----

    def _fs(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()), there

    def _names(self, folder: str) -> list[str]:
        fs, there = self._fs(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(there)) if fs.exists(there) else []

    def _manifests(self) -> dict[int, str]:
        """The name of each snapshot's last manifest; names are enough to tell."""
        return {int(n.split("-")[0]): n for n in self._names("manifest") if n[0] != "_"}

    def _load(self, name: str) -> Snapshot:
        fs, there = self._fs(f"{self.path}/manifest/{name}")
        stream = fs.open(there)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(**{**found, "files": [File(**f) for f in found["files"]]})

    def _save(self, snapshot: Snapshot) -> None:
        """Write the next manifest of a snapshot; it appears whole or not at all. The one before stays for its readers, older ones go."""
        before = f"{snapshot.id:012d}-{snapshot.step - 1:08d}.json"
        snapshot.step += 1
        name = f"{snapshot.id:012d}-{snapshot.step:08d}.json"
        fs, part = self._fs(f"{self.path}/manifest/_{name}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(asdict(snapshot)).encode()))
        out.close()
        fs.rename(part, self._fs(f"{self.path}/manifest/{name}")[1])
        fs.delete(self._fs(f"{self.path}/manifest/{before}")[1], False)

    def all(self) -> list[Snapshot]:
        return [self._load(name) for _, name in sorted(self._manifests().items())]

    def snapshots(self) -> DataFrame:
        """The snapshots as a table, for the rules of ``operators.snapshots``."""
        time = lambda t: datetime.fromisoformat(t) if t else None
        rows = [(s.id, self.network_id, s.previous_id, s.status, time(s.start_time), time(s.end_time), s.deleted, s.size) for s in self.all()]
        return self.spark.createDataFrame(rows, SNAPSHOTS)

    def last(self, statuses: list[int] = rules.HARVESTED) -> Snapshot | None:
        """The snapshot that was finished last, with one of the statuses."""
        found = [s for s in self.all() if s.status in statuses and not s.deleted and s.end_time]
        return max(found, key=lambda s: (s.end_time, s.id), default=None)

    # ---- life of a snapshot ----

    def begin(self, full: bool = False, source: str = "") -> Snapshot:
        """A snapshot to write to.

        One of the same source that was not finished, or failed, is gone on with; else a full one begins empty, and
        an incremental one with what the last good one has. Without a good one before it, a snapshot is a full one.
        """
        known = self.all()
        own = [s for s in known if s.source == source]
        if source and own and own[-1].status in (*_OPEN, int(S.HARVESTING_FINISHED_ERROR)):
            snapshot = own[-1]
            snapshot.status, snapshot.end_time = int(S.RETRYING), None
        else:
            parent = None if full else self.last()
            snapshot = Snapshot(max((s.id for s in known), default=0) + 1, parent.id if parent else None, int(S.HARVESTING), _now(), source)
            # A batch is known also where the snapshot that it went to is not inherited from.
            for s in known:
                snapshot.batches |= {q: max(b, snapshot.batches.get(q, b)) for q, b in s.batches.items()}
                snapshot.next_run = max(snapshot.next_run, s.next_run)
            snapshot.files = list(parent.files) if parent else []
        self._save(snapshot)
        return snapshot

    def append(self, snapshot: Snapshot, delta: DataFrame, batch: int, query: str = "") -> None:
        """Add the last row (by ``seq``) of each id as a run; a batch of a query that is there already is left alone."""
        if snapshot.batches.get(query, -1) >= batch:
            return
        delta = delta.persist()
        size = delta.count()
        snapshot.files += self._write(last_write(delta.repartition(self._parts(size), "id")).drop("seq"), snapshot.next_run, size)
        delta.unpersist()
        snapshot.next_run += 1
        snapshot.batches[query] = batch
        self._merge_runs(snapshot)
        self._save(snapshot)

    def finish(self, snapshot: Snapshot, status: int = int(S.HARVESTING_FINISHED_VALID), size: int | None = None) -> None:
        snapshot.status, snapshot.end_time, snapshot.size = int(status), _now(), size
        self._save(snapshot)

    def clean(self) -> list[int]:
        """Remove all snapshots but the last good, the last harvested and open ones, then the runs that none of those left names.

        Failed ones go too; the checkpoint of such a harvest is of no use then, and its pages must be asked for anew.
        """
        gone = {r["id"] for r in rules.to_delete(self.snapshots()).where(~F.col("status").isin(_OPEN)).select("id").collect()}
        for name in self._names("manifest"):
            if name[0] != "_" and int(name.split("-")[0]) in gone:
                fs, there = self._fs(f"{self.path}/manifest/{name}")
                fs.delete(there, False)
        used = {f.path.split("/")[0] for s in self.all() for f in s.files}
        for run in self._names("data"):
            if run not in used:
                fs, there = self._fs(f"{self.path}/data/{run}")
                fs.delete(there, True)
        return sorted(gone)

    # ---- runs ----

    def _parts(self, rows: int) -> int:
        """Partitions and files of a run: the session's number, fewer for few rows, as what is cached or comes from a stream is never coalesced."""
        return max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS)))

    def _write(self, rows: DataFrame, run: int, size: int) -> list[File]:
        """Write rows, one for each id and ``size`` at most, as a sorted run; its files' ranges of ids do not overlap."""
        folder = f"{run:08d}-{uuid.uuid4().hex}"
        rows = rows.select([c.split()[0] for c in CATALOG.split(", ")]).persist()
        rows.repartitionByRange(self._parts(size), "id").sortWithinPartitions("id").write.parquet(f"{self.path}/data/{folder}")
        rows.unpersist()
        written = self.spark.read.schema(CATALOG).parquet(f"{self.path}/data/{folder}")
        file = F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes")
        found = written.groupBy(*file).agg(F.count("*").alias("rows"), F.min("id").alias("low"), F.max("id").alias("high")).collect()
        return [File(f"{folder}/{f['name']}", run, f["rows"], f["bytes"], f["low"], f["high"]) for f in sorted(found, key=lambda f: f["low"])]

    def _merge_runs(self, snapshot: Snapshot) -> None:
        """Merge the newest runs as far as each is no larger than those after it together, if they are several."""
        size: dict[int, int] = {}
        for f in snapshot.files:
            size[f.run] = size.get(f.run, 0) + f.bytes
        some, total = [], 0
        for run in sorted(size, reverse=True):
            if len(some) > 1 and size[run] > total:
                break
            some.append(run)
            total += size[run]
        if len(some) >= FAN_IN:
            old = [f for f in snapshot.files if f.run in some]
            rows = sum(f.rows for f in old)
            merged = self._write(self._merged(old, self._parts(rows)), max(some), rows)
            snapshot.files = [f for f in snapshot.files if f.run not in some] + merged

    def _rows(self, files: list[File]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], CATALOG)
        return self.spark.read.schema(CATALOG).parquet(*[f"{self.path}/data/{f.path}" for f in files])

    def _merged(self, files: list[File], parts: int | None = None) -> DataFrame:
        """One row for each id. The largest run is filtered by the ids of the others, never sorted; ``parts`` deal out what is."""
        runs: dict[int, list[File]] = {}
        for f in files:
            runs.setdefault(f.run, []).append(f)
        if len(runs) < 2:
            return self._rows(files)
        base = max(runs, key=lambda r: sum(f.bytes for f in runs[r]))
        with_order = lambda r: self._rows(runs[r]).withColumn("seq", F.struct("datestamp", F.lit(r).alias("run")))
        newer = None
        for r in sorted(runs):
            if r != base:
                newer = with_order(r) if newer is None else newer.unionByName(with_order(r))
        ids = newer.select("id").distinct()
        met = with_order(base).join(ids, "id", "left_semi").unionByName(newer)
        met = met.repartition(parts, "id") if parts else met
        return self._rows(runs[base]).join(ids, "id", "left_anti").unionByName(last_write(met).drop("seq"))

    def rows(self, snapshot: Snapshot | None, keys: list[str] | None = None) -> DataFrame:
        """The rows of a snapshot; with ``keys`` only those, from the files whose range has one of them."""
        files = snapshot.files if snapshot else []
        if keys is None:
            return self._merged(files)
        return self._merged([f for f in files if any(f.low <= k <= f.high for k in keys)]).where(F.col("id").isin(keys))

    def read(self, snapshot_id: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """The catalog as a snapshot has it, by default the one harvested last."""
        snapshot = self.last() if snapshot_id is None else self._load(self._manifests()[snapshot_id])
        return self.rows(snapshot, keys)
