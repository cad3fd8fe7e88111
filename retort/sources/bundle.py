"""Versioned bundles: a folder of Parquet versions and one manifest for each.

A commit stages ``data/v=<k>-<id>``, claims version ``k`` by creating a file
that may not exist yet (compare and swap on the version number) and renames
``manifest-<k>.json`` into place.  Readers take the newest manifest, so data without one
(a crashed commit) is never seen; :meth:`Bundle.vacuum` deletes it [L5, L10-L13].
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import KINDS, OBJECT, EntityFrame, HistoryEntry

FORMAT = 1


class ConflictError(RuntimeError):
    """Another writer committed first, or the base doesn't fit."""


class Bundle:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _p(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._p("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(""))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        if not have:
            raise FileNotFoundError(f"no bundle at {self.path}")
        version = have[-1] if version is None else version
        if version not in have:
            raise FileNotFoundError(f"no version {version} in {self.path}")
        stream = self._fs.open(self._p(f"manifest-{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def load(self, version: int | None = None) -> EntityFrame:
        """The frame of a version, with its history; kinds come from a fixed list, never from code named in a file [A23]."""
        m = self.manifest(version)
        if m["kind"] not in KINDS or m["format"] != FORMAT:
            raise ValueError("the bundle's kind or format isn't known")
        schema = T.StructType.fromJson(m["schema"])
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{m['data']}")
        return EntityFrame(df, m["kind"], [HistoryEntry.from_dict(h) for h in m["history"]])

    def commit(self, frame: EntityFrame, base: int | None, check: Callable[[dict, EntityFrame], None] | None = None) -> int:
        """Writes the next version after ``base`` (None: the first); :class:`ConflictError` if that is taken."""
        have = self.versions()
        if (have[-1] if have else None) != base:
            raise ConflictError(f"the base is version {base}, the newest is {have[-1] if have else None}")
        if check and base is not None:
            check(self.manifest(base), frame)
        version = 0 if base is None else base + 1
        data = f"data/v={version}-{uuid.uuid4().hex[:12]}"
        try:
            frame.df.write.parquet(f"{self.path}/{data}")
            body = {"format": FORMAT, "kind": frame.kind, "version": version, "base": base, "data": data, "schema": json.loads(frame.df.schema.json()), "history": [h.to_dict() for h in frame.history]}
            self._create(version, json.dumps(body).encode())
        except Exception:
            self._fs.delete(self._p(data), True)
            raise
        return version

    def _create(self, version: int, body: bytes) -> None:
        """The version is claimed by creating a file that may not exist; the manifest is then renamed into place whole."""
        claim = self._p(f"claim-{version}")
        try:
            self._fs.create(claim, False).close()
        except Exception as e:
            raise ConflictError(f"version {version} is taken") from e
        part = self._p(f".{uuid.uuid4().hex}")
        try:
            if self._fs.exists(self._p(f"manifest-{version}.json")):
                raise ConflictError(f"version {version} has been written meanwhile")
            out = self._fs.create(part, False)
            out.write(bytearray(body))
            out.close()
            if not self._fs.rename(part, self._p(f"manifest-{version}.json")):
                raise ConflictError(f"version {version} can't be written")
        except Exception:
            self._fs.delete(part, False)
            self._fs.delete(claim, False)
            raise

    def vacuum(self) -> int:
        """Deletes data that no manifest names, and claims of crashed commits; not while another commits."""
        for k in [self.versions()[-1] + 1] if self.versions() else []:
            self._fs.delete(self._p(f"claim-{k}"), False)
        used = {self.manifest(v)["data"].split("/")[1] for v in self.versions()}
        if not self._fs.exists(self._p("data")):
            return 0
        gone = [s.getPath() for s in self._fs.listStatus(self._p("data")) if s.getPath().getName() not in used]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def save(frame: EntityFrame, path: str, overwrite: bool = False, object_writer: Callable[[Column], Column] | None = None) -> int:
    """A frame as a bundle [B11]; an existing one is an error, or gets a new version with ``overwrite``.

    ``object_writer`` makes what is stored of the object column [N12, X12].
    """
    if object_writer is not None:
        frame = frame._same_rows(frame.df.withColumn(OBJECT, object_writer(F.col(OBJECT))))
    bundle = Bundle(frame.spark, path)
    have = bundle.versions()
    if have and not overwrite:
        raise FileExistsError(path)
    return bundle.commit(frame, have[-1] if have else None)


def load(spark: SparkSession, path: str, version: int | None = None, object_reader: Callable[[Column], Column] | None = None) -> EntityFrame:
    """A version of a bundle [A23]; ``object_reader`` makes the object column of what is stored."""
    frame = Bundle(spark, path).load(version)
    return frame if object_reader is None else frame._same_rows(frame.df.withColumn(OBJECT, object_reader(F.col(OBJECT))))
