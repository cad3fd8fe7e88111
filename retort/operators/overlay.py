"""Copy-on-write overlays on a bundle [L1-L13].

An overlay is a frame whose plan extends a committed version.  Edits are plan
steps: deltas win over the base, a dropped column hides the base's until it is
added again, nested overlays see the outer one's pending edits.  ``commit``
writes the next version atomically; a subset's edits are written back to the
rows they came from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import OBJECT, PREFIX, EntityFrame
from ..index import POS
from ..sources.bundle import Bundle, ConflictError


class Overlay:
    def __init__(self, bundle: Bundle, version: int | None = None):
        self.bundle = bundle
        self.version = bundle.versions()[-1] if version is None else version
        self.base = bundle.load(self.version)
        self.frame = self.base

    def edit(self, f: Callable[[EntityFrame], EntityFrame]) -> Overlay:
        """A new overlay with one more edit; this one stays as it is [L7]."""
        out = Overlay.__new__(Overlay)
        out.bundle, out.version, out.base, out.frame = self.bundle, self.version, self.base, f(self.frame)
        return out

    def _check(self, manifest: dict, frame: EntityFrame) -> None:
        """All differences between the base as it was and as it is [L13]."""
        errors = []
        then = {f.name: f for f in T.StructType.fromJson(manifest["schema"]).fields}
        now = {f.name: f for f in self.base.df.schema.fields}
        if then.keys() != now.keys():
            errors.append(f"columns {sorted(then.keys() ^ now.keys())}")
        for n in sorted(then.keys() & now.keys()):
            if then[n].dataType != now[n].dataType or then[n].metadata.get("shape") != now[n].metadata.get("shape"):
                errors.append(f"type of {n}: {then[n].dataType.simpleString()} {then[n].metadata.get('shape') or ''}".rstrip())
            kept = {f.name: f for f in frame.df.schema.fields}.get(n)
            if kept is not None and kept.dataType != then[n].dataType and n in (POS, OBJECT):
                errors.append(f"{n} would become {kept.dataType.simpleString()}")
        if manifest["kind"] != self.base.kind:
            errors.append(f"kind {manifest['kind']}")
        if errors:
            raise ConflictError("the base has changed: " + "; ".join(errors))

    def commit(self) -> int:
        """The overlay's frame as the next version."""
        return self.bundle.commit(self.frame, self.version, self._check)

    def commit_rows(self) -> int:
        """Rows of the overlay written back to their positions; other base rows stay, new positions are appended."""
        return self.bundle.commit(self.base._new(write_back(self.base, self.frame).df), self.version, self._check)

    def materialize(self, path: str) -> EntityFrame:
        return self.frame.materialized(path)


def write_back(base: EntityFrame, delta: EntityFrame) -> EntityFrame:
    """Rows of ``delta`` over those of ``base`` by position: an outer join in which the delta's columns win.

    Only the columns that ``delta`` has are joined; Spark broadcasts neither side
    of a full join, so for edits of a predicate's rows an edit of the whole frame
    with that predicate (``update_metadata(values, predicate)``) is cheaper: it
    needs no join.
    """
    d = delta.df.select(F.col(POS).alias("_dpos"), F.lit(True).alias("_there"), *[F.col(f"`{c}`").alias(f"_d_{c}") for c in delta.df.columns if c != POS])
    met = base.df.join(d, F.col(POS) == F.col("_dpos"), "full_outer")
    columns = [c for c in base.df.columns if c != POS] + [c for c in delta.df.columns if c not in base.df.columns]
    out = []
    for c in columns:
        if c not in delta.df.columns:
            out.append(F.col(f"`{c}`"))
        elif c not in base.df.columns:
            out.append(F.col(f"`_d_{c}`").alias(c))
        else:
            out.append(F.when(F.col("_there"), F.col(f"`_d_{c}`")).otherwise(F.col(f"`{c}`")).alias(c))
    return base._new(met.select(F.coalesce(F.col(POS), F.col("_dpos")).alias(POS), *out))


def tombstone(frame: EntityFrame, *columns: str) -> EntityFrame:
    """Columns hidden until they are added again [L2, L3]; features by their names."""
    out = frame
    for c in columns:
        out = out.drop_feature(c) if PREFIX + c in frame.df.columns else out.drop_metadata(c)
    return out


__all__ = ["OBJECT", "Overlay", "tombstone", "write_back"]
