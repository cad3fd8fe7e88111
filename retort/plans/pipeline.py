"""Pipelines of blocks: one plan from source to result [M1-M3, M5].

Row blocks give the same result for any batching and any number of tasks, so a
pipeline runs as one lazy plan.  Runs of neighbouring pure filters are reordered
so that native predicates come before Python kernels; nothing moves across a
dedup, a sampler or a preparation.  Dedup and samples are of the whole table, not
of a batch; what must see a batch as a whole is a :class:`BatchFunction`.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from ..frame import EntityFrame
from .blocks import BatchFunction, Block, Source


def ordered(steps: Sequence[Block]) -> list[Block]:
    """Native pure filters first within each run of pure filters; stable."""
    out: list[Block] = []
    run: list[Block] = []
    for s in [*steps, None]:
        if s is not None and s.pure:
            run.append(s)
            continue
        out += [b for b in run if b.native] + [b for b in run if not b.native]
        run = []
        if s is not None:
            out.append(s)
    return out


class Pipeline:
    def __init__(self, steps: Sequence[Block] = ()):
        self.steps = list(steps)
        for s in self.steps:
            self._check(s)

    @staticmethod
    def _check(step: Block) -> None:
        if not isinstance(step, Block):
            raise TypeError(f"{step!r} is not a block")

    def add_step(self, step: Block) -> Pipeline:
        self._check(step)
        self.steps.append(step)
        return self

    def run(self, table: EntityFrame | None = None, audit: bool = False) -> EntityFrame:
        """The frame after all steps; an empty pipeline is the identity.

        A source reads once; a table given as well is ignored with a warning.
        ``audit`` counts rows around every step (one job each) for the history.
        """
        frame = table
        for step in ordered(self.steps):
            if isinstance(step, Source):
                if frame is not None:
                    warnings.warn(f"{step.name} ignores the table it is given", stacklevel=2)
                frame = step.load()
                frame = step.run(frame, audit)
            elif frame is None:
                raise ValueError("the pipeline needs a table or a source")
            else:
                frame = step.run(frame, audit)
        return frame

    def run_batches(self, table: EntityFrame, batch_size: int) -> EntityFrame:
        """:meth:`run` with batches of ``batch_size`` rows for the blocks that work by batch [M2, M3].

        It is one plan, whatever the number of batches: row blocks don't depend on
        them, and rows that reach a batch block are numbered and dealt to batches
        there, so a batch is whole after filters too.  The schema stays when
        nothing is left.
        """
        if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size < 1:
            raise ValueError("batch_size must be a positive integer")
        steps = [BatchFunction(s.func, s.returns, batch_size, s.label) if isinstance(s, BatchFunction) else s for s in self.steps]
        return Pipeline(steps).run(table)
