"""Versioned collections as Parquet under a folder.

::

    commits/<seq>-<id>/ data of one commit (a batch of ordered mutations)
    log/<seq>.json      publishes a commit: names its data
    delta/<from>-<to>/  sealed commits, still with versions and tombstones
    snapshot/<seq>/     live points, ranged by id
    manifest/<n>.json   what is current: snapshot, deltas, and the last sealed commit
    pins/<id>.json      views that readers hold, until when
    writers/<n>.json    writers in the order in which they took over

Every object is written once, under a new name.  Small files are written whole
under another name and then renamed to a name that must not exist, which the
file system does in one step (HDFS; on a local disk with a check before it).  A
commit counts from its file in ``log`` on: data of a writer that died, or that
lost to another one, is never read.

A reader holds a ``View``: one manifest and the commits after it up to a fixed
one.  It reads the same state however much is written, sealed or compacted
meanwhile, and ``pin`` keeps its files from ``cleanup``.  A view whose files are
gone raises; it never reads fewer rows.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.model import LOG, POINT, Config
from vecloom.operators import points as ops


class Files:
    """The few file operations that Spark's readers and writers don't offer, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> None:
        """Publishes a new file with its whole content; raises FileExistsError if the name is taken."""
        place = self._path(name)
        held = self._path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(held, False)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        kind = getattr(hadoop, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            hadoop.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(held, place, how)
        except Exception as error:
            self.fs.delete(held, False)
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                raise FileExistsError(name) from None
            raise

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        found = (s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else ()
        return sorted(n for n in found if not n.startswith("."))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    #: Last commit held by the snapshot and the deltas.
    sealed: int = 0
    snapshot: str | None = None
    deltas: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class View:
    """One state: a manifest and the commits after it, by number and data."""

    manifest: Manifest
    commits: tuple[tuple[int, str], ...] = ()

    @property
    def sequence(self) -> int:
        return self.commits[-1][0] if self.commits else self.manifest.sealed


class Store:
    #: Commits in the log that make sealing due, and must not be exceeded; deltas that make merging due.
    SEAL_AT, HARD_TAIL, MAX_DELTAS = 32, 64, 8
    #: Seconds for which a pin holds unless it is renewed.
    PIN_SECONDS = 3600

    def __init__(self, spark: SparkSession, path: str, config: Config):
        self.spark, self.path, self.config, self.files = spark, path.rstrip("/"), config, Files(spark, path)
        self.writer: int | None = None

    # ---- reading
    def manifest(self) -> Manifest:
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        return _manifest(json.loads(self.files.read(f"manifest/{names[-1]}"))) if names else Manifest()

    def tail(self, manifest: Manifest | None = None) -> list[int]:
        m = manifest or self.manifest()
        return [n for n in self._published() if n > m.sealed]

    def _published(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("log") if n.endswith(".json")]

    def _data(self, n: int) -> str:
        return json.loads(self.files.read(f"log/{n:020d}.json"))["data"]

    def view(self, seq: int | None = None, manifest: Manifest | None = None) -> View:
        """The newest state, or that of commit ``seq``, which must not be sealed away."""
        m = manifest or self.manifest()
        if seq is not None and seq < m.sealed:
            raise ValueError("that state has been compacted away; read an older manifest")
        numbers = self.tail(m)
        last = max([m.sealed, *numbers, self.manifest().sealed]) if seq is None else seq
        wanted = list(range(m.sealed + 1, last + 1))
        if [n for n in numbers if n <= last] != wanted:
            raise ValueError(f"commits of that state are gone: {sorted(set(wanted) - set(numbers))[:5]}")
        return View(m, tuple((n, self._data(n)) for n in wanted))

    def _log(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], LOG)

    def _snapshot(self, m: Manifest) -> DataFrame:
        return self.spark.read.schema(POINT).parquet(f"{self.path}/{m.snapshot}") if m.snapshot else self.spark.createDataFrame([], POINT)

    def live(self, state: View | Manifest | None = None, seq: int | None = None) -> DataFrame:
        """Live points of a view, or of a manifest (the newest by default) and the commits after it, up to ``seq``."""
        v = state if isinstance(state, View) else self.view(seq, state)
        names = [*v.manifest.deltas, *(data for _, data in v.commits)]
        gone = [n for n in (*names, v.manifest.snapshot) if n and not self.files.exists(n)]
        if gone:
            raise ValueError(f"files of that state are gone: {gone[:5]}")
        return ops.live_over(self._snapshot(v.manifest), self._log(names)) if names else self._snapshot(v.manifest)

    def sequence(self) -> int:
        m = self.manifest()
        return max([m.sealed, *self.tail(m)])

    # ---- pins
    def pin(self, view: View, seconds: float = PIN_SECONDS) -> str:
        """Keeps the files of ``view`` from cleanup for a time; returns the pin's name."""
        name = uuid.uuid4().hex
        self.files.create(f"pins/{name}.json", json.dumps({"until": time.time() + seconds, "view": asdict(view)}))
        self.live(view)  # raises if a cleanup came between the view and its pin
        return name

    def unpin(self, name: str) -> None:
        self.files.remove(f"pins/{name}.json")

    def pins(self) -> list[View]:
        """Views whose pins still hold; others are removed."""
        found = []
        for name in self.files.names("pins"):
            held = json.loads(self.files.read(f"pins/{name}"))
            if held["until"] < time.time():
                self.files.remove(f"pins/{name}")
                continue
            found.append(View(_manifest(held["view"]["manifest"]), tuple((n, data) for n, data in held["view"]["commits"])))
        return found

    # ---- writing
    def take_over(self) -> int:
        """Makes this the only writer: commits of stores that took over earlier, or never did, are refused from now on."""
        number = max([0, *(int(n[:-5]) for n in self.files.names("writers"))]) + 1
        self.files.create(f"writers/{number:020d}.json", "{}")
        self.writer = number
        return number

    def _check_writer(self) -> None:
        taken = [int(n[:-5]) for n in self.files.names("writers")]
        if taken and self.writer != max(taken):
            raise PermissionError("another writer has taken over")

    def commit(self, rows: DataFrame, seq: int | None = None) -> int:
        """Appends one commit (log rows without a number).

        Its data is written first; the commit's file in ``log`` is what makes it
        count.  Of two writers of the same number one fails and leaves nothing.
        """
        self._check_writer()
        m = self.manifest()
        tail = self.tail(m)
        if len(tail) >= self.HARD_TAIL:
            raise RuntimeError("the log is full: seal it first")
        n = max([m.sealed, *tail]) + 1
        if seq is not None and seq != n:
            raise FileExistsError(f"commit {seq} is not the next one")
        name = f"commits/{n:020d}-{uuid.uuid4().hex}"
        rows.withColumn("seq", F.lit(n).cast("long")).select(*LOG.fieldNames()).write.parquet(f"{self.path}/{name}")
        try:
            self._check_writer()
            self.files.create(f"log/{n:020d}.json", json.dumps({"data": name}))
        except (FileExistsError, PermissionError):
            self.files.remove(name)
            raise
        return n

    def _publish(self, m: Manifest) -> Manifest:
        new = replace(m, version=m.version + 1)
        self.files.create(f"manifest/{new.version:020d}.json", json.dumps(asdict(new)))
        return new

    # ---- maintenance
    def seal(self) -> Manifest:
        """Moves the log's commits into one delta."""
        m = self.manifest()
        tail = self.tail(m)
        if not tail:
            return m
        name = f"delta/{tail[0]:020d}-{tail[-1]:020d}-{uuid.uuid4().hex[:8]}"
        newest = ops.latest(self._log([self._data(n) for n in tail])).select(*LOG.fieldNames())
        newest.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self._publish(replace(m, sealed=tail[-1], deltas=(*m.deltas, name)))

    def consolidate(self) -> Manifest:
        """Merges the two oldest deltas, newest version wins; without a snapshot below, tombstones go."""
        m = self.manifest()
        if len(m.deltas) < 2:
            return m
        first, second = m.deltas[:2]
        name = f"delta/{first.split('/')[1].split('-')[0]}-{second.split('-')[1]}-{uuid.uuid4().hex[:8]}"
        merged = ops.latest(self._log([first, second])).select(*LOG.fieldNames())
        if m.snapshot is None:
            merged = merged.where("op = 'put'")
        merged.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self._publish(replace(m, deltas=(name, *m.deltas[2:])))

    def checkpoint(self, files: int | None = None) -> Manifest:
        """Writes a snapshot of the current state, ranged by id; nothing to do if there is one already."""
        view = self.view()
        m, seq = view.manifest, view.sequence
        if seq == 0 or (m.snapshot and m.snapshot.startswith(f"snapshot/{seq:020d}")):
            return m
        name = f"snapshot/{seq:020d}-{uuid.uuid4().hex[:8]}"
        parts = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.live(view).repartitionByRange(parts, "id").sortWithinPartitions("id").write.parquet(f"{self.path}/{name}")
        return self._publish(replace(m, sealed=seq, snapshot=name, deltas=()))

    def compact(self) -> Manifest:
        m = self.checkpoint()
        self.cleanup()
        return m

    def cleanup(self, pinned: tuple[View | Manifest, ...] = ()) -> list[str]:
        """Removes what neither the newest state, nor a stored pin, nor a state in ``pinned`` reaches.

        Data of a commit that never counted goes once its number is sealed.
        """
        newest = self.manifest()
        given = [p if isinstance(p, View) else View(p) for p in pinned]
        states = [View(newest), *given, *self.pins()]
        manifests = [v.manifest for v in states]
        needed = {n for m in manifests for n in (*m.deltas, m.snapshot) if n} | {data for v in states for _, data in v.commits}
        numbers = {n for v in states for n, _ in v.commits}
        # a manifest without a view is read with all commits after it
        oldest = min([newest.sealed, *(p.sealed for p in pinned if isinstance(p, Manifest))])
        dead = [f"{f}/{n}" for f in ("delta", "snapshot") for n in self.files.names(f) if f"{f}/{n}" not in needed]
        dead += [f"log/{n:020d}.json" for n in self._published() if n <= oldest and n not in numbers]
        dead += [f"commits/{n}" for n in self.files.names("commits") if int(n.split("-")[0]) <= oldest and f"commits/{n}" not in needed]
        kept = {f"{m.version:020d}.json" for m in manifests}
        dead += [f"manifest/{n}" for n in self.files.names("manifest") if n not in kept]
        for name in dead:
            self.files.remove(name)
        return dead

    def maintain(self) -> str | None:
        """One unit of work, the most urgent first; None if nothing is due."""
        m = self.manifest()
        if len(self.tail(m)) >= self.SEAL_AT:
            self.seal()
            return "seal"
        if len(m.deltas) > self.MAX_DELTAS:
            self.consolidate()
            return "consolidate"
        return "cleanup" if self.cleanup() else None

    def status(self) -> dict:
        m = self.manifest()
        return {"sequence": self.sequence(), "tail": len(self.tail(m)), "deltas": len(m.deltas), "snapshot": m.snapshot, "live": self.live(m).count(), "dimensions": self.config.dimensions, "metric": str(self.config.metric)}

    # ---- copies
    def backup(self, target: str) -> int:
        """Copies the current state; the manifest comes last, so an unfinished copy isn't a store. Returns the row count."""
        view = self.view()
        copy = Store(self.spark, target, self.config)
        if copy.files.names("manifest") or copy.files.names("log"):
            raise FileExistsError(target)
        name = f"snapshot/{view.sequence:020d}-{uuid.uuid4().hex[:8]}"
        live = self.live(view)
        live.write.parquet(f"{target}/{name}")
        new = Manifest(version=0, sealed=view.sequence, snapshot=name)
        if digest(copy._snapshot(new)) != digest(live):
            raise RuntimeError("the copy differs from its source")
        copy._publish(new)
        return copy.live().count()

    def restore(self, backup: str) -> int:
        """Fills this store, which must be empty, from a backup, and checks what it copied; its next commit follows the backup's last."""
        source = Store(self.spark, backup, self.config)
        if not source.files.names("manifest"):
            raise FileNotFoundError(backup)
        return source.backup(self.path)


def _manifest(found: dict) -> Manifest:
    return Manifest(**(found | {"deltas": tuple(found["deltas"])}))


def digest(points: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash of points."""
    row = points.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(id, vector, to_json(array_sort(map_entries(metadata)))))")).first()
    return row[0], row[1] or 0
