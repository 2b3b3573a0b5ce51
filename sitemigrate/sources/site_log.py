"""Tables as a log: each version adds files with its new rows, and one manifest that names all files.

A commit writes only what is new: rows, and the keys of rows that new ones replace (tombstones). Its manifest is put in place
last, by one rename; a commit that fails before leaves files that no manifest names, and can be run again. A reader takes
one manifest and sees one version, whatever is written meanwhile.

Where a table has ``FANOUT`` pieces of one level, a commit merges them into one piece of the next level, so a row is
written again once for each level only, and a version is never made of many small pieces.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemigrate.sources.site import KEYS, SCHEMAS, SiteTables
from sitemigrate.storage import dealt

FANOUT = 8


@dataclass(frozen=True)
class Piece:
    """Files of a table: rows at ``path``, keys of earlier rows that they replace at ``gone`` (or none)."""

    table: str
    level: int
    path: str
    gone: str | None = None


class TableLog:
    """Versions of tables below ``path``; a version's number is the caller's, such as that of a micro-batch.

    ``schemas`` has the tables; ``keys`` what tells rows apart in those where new rows may replace old ones.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], keys: dict[str, list[str]] | None = None):
        self.spark, self.path, self.schemas, self.keys = spark, path.rstrip("/"), schemas, keys or {}
        self._root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of all complete versions, in order."""
        if not self._fs.exists(self._root):
            return []
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(self._root)]
        return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))

    def pieces(self, version: int | None = None) -> list[Piece]:
        """What a version (the last by default) is made of, oldest pieces first; nothing before the first commit."""
        known = self.versions()
        if not known:
            return []
        at = self._path(f"manifest/v={known[-1] if version is None else version}.json")
        stream = self._fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Piece(**p) for p in json.loads(text)]

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the last by default; empty before the first commit."""
        pieces = self.pieces(version)
        return {name: self._table(name, [p for p in pieces if p.table == name]) for name in self.schemas}

    def commit(self, added: dict[str, DataFrame], version: int, replaced: dict[str, DataFrame] | None = None) -> bool:
        """Writes a version: that before it, with rows ``added`` to tables, and without rows whose keys are in ``replaced``.

        ``replaced`` has the key columns (see ``keys``) of a table; it takes out rows of earlier versions only. False, and nothing
        changed, if the version is there already.
        """
        before = [v for v in self.versions() if v < version]
        if self._fs.exists(self._path(f"manifest/v={version}.json")):
            return False
        pieces, attempt = self.pieces(before[-1]) if before else [], uuid.uuid4().hex
        for name, rows in added.items():
            path, gone = f"{self.path}/data/{name}/{attempt}", None
            rows.write.parquet(path)
            if replaced and name in replaced and replaced[name].take(1):
                gone = f"{self.path}/gone/{name}/{attempt}"
                replaced[name].select(*self.keys[name]).distinct().write.parquet(gone)
            if gone or self.spark.read.schema(self.schemas[name]).parquet(path).take(1):
                pieces.append(Piece(name, 0, path, gone))
        for name in added:
            pieces = self._merged(name, pieces, attempt)
        return self._publish(pieces, version)

    def expire(self, keep: int = 1) -> list[str]:
        """Deletes versions but the last ``keep``, and files that only they name; returns the folders that went.

        Files that no manifest names, as of a commit under way, are left alone.
        """
        known = self.versions()
        paths = lambda vs: {x for v in vs for p in self.pieces(v) for x in (p.path, p.gone) if x}
        old = known[: max(0, len(known) - keep)]
        gone = sorted(paths(old) - paths(known[len(old) :]))
        for v in old:
            self._fs.delete(self._path(f"manifest/v={v}.json"), False)
        for path in gone:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        return gone

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _table(self, name: str, pieces: list[Piece]) -> DataFrame:
        read = lambda *paths: self.spark.read.schema(self.schemas[name]).parquet(*paths)
        if not pieces:
            return self.spark.createDataFrame([], self.schemas[name])
        last = max((i for i, p in enumerate(pieces) if p.gone), default=0)
        if last == 0:
            return read(*(p.path for p in pieces))
        # Rows older than a tombstone of their key are gone: pieces are counted in their order.
        dated, tombs = None, None
        for i, p in enumerate(pieces[:last]):
            rows = read(p.path).withColumn("__at", F.lit(i))
            dated = rows if dated is None else dated.unionByName(rows)
        for i, p in enumerate(pieces):
            if p.gone:
                keys = self.spark.read.parquet(p.gone).withColumn("__gone", F.lit(i))
                tombs = keys if tombs is None else tombs.unionByName(keys)
        latest = tombs.groupBy(*self.keys[name]).agg(F.max("__gone").alias("__gone"))
        alive = dated.join(dealt(latest), self.keys[name], "left").filter("__gone IS NULL OR __at >= __gone")
        return alive.select(*dated.columns[:-1]).unionByName(read(*(p.path for p in pieces[last:])))

    def _merged(self, name: str, pieces: list[Piece], attempt: str) -> list[Piece]:
        """``pieces`` with the newest ones of a table made one where ``FANOUT`` of them are of one level, level by level."""
        own, others = [p for p in pieces if p.table == name], [p for p in pieces if p.table != name]
        while len(own) >= FANOUT and len({p.level for p in own[-FANOUT:]}) == 1:
            run, earlier = own[-FANOUT:], own[:-FANOUT]
            level = run[-1].level + 1
            path, gone = f"{self.path}/data/{name}/{attempt}-{level}", None
            self._table(name, run).write.parquet(path)
            if earlier and (tombs := [p.gone for p in run if p.gone]):
                gone = f"{self.path}/gone/{name}/{attempt}-{level}"
                self.spark.read.parquet(*tombs).distinct().write.parquet(gone)
            own = [*earlier, Piece(name, level, path, gone)]
        return others + own

    def _publish(self, pieces: list[Piece], version: int) -> bool:
        """Puts the manifest in place by a rename; false if another one was quicker."""
        draft = self._path(f"manifest/_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps([vars(p) for p in pieces]).encode()))
        finally:
            stream.close()
        target = self._path(f"manifest/v={version}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            return False
        return True


class SiteLog(TableLog):
    """Versions of a site."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, SCHEMAS, KEYS)

    def read(self, version: int | None = None) -> SiteTables:
        return SiteTables(**self.tables(version))
