"""Lineage over several keyed steps.

A job is a chain of stages: the source rows and, after each step, that step's
rows.  Every stage has key columns; a step brings its edges, a DataFrame with the
keys of both sides.  A ``Cursor`` is a set of ids at a stage and moves along the
edges: ``back(n)``, ``forward(n)``, ``back_all()``, ``show()`` for the values.

Ids stay in DataFrames.  A move is a null-safe semi join of the edges with the
ids; the ids are broadcast only within a measured size, otherwise Spark plans the
join (a hot id is split by AQE).  Edges are whatever the job has already made:
columns of its own rows, no second copy.

Ids are computed and kept only where a join needs them.  A cursor holds the edge
rows that its move selected, and where these are also the edges of the next move
no join is made: the next key is a column of the same rows (see ``_passes``).  The
same holds for a step whose key is computed from the key before (``made``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import MAX_BROADCAST_BYTES, join_small, materialize, measured_bytes


@dataclass
class Stage:
    name: str
    values: DataFrame
    key: list[str]
    #: holds the keys of the stage before and of this one (None for the source)
    edges: DataFrame | None = None
    #: this key's columns as expressions of the key before, instead of edges
    made: dict[str, Column] | None = None


@dataclass
class Lineage:
    """``Lineage(lines, ["line_id"]).step("records", records, ["line_id", "pos"])...``"""
    source: DataFrame
    key: list[str]
    name: str = "source"
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES
    stages: list[Stage] = field(init=False)

    def __post_init__(self):
        self.stages = [Stage(self.name, self.source, list(self.key))]

    def step(self, name: str, values: DataFrame, key: list[str], edges: DataFrame | None = None,
             made: dict[str, Column] | None = None) -> Lineage:
        """The rows that a step makes, with their key.  ``edges`` holds the key
        columns of the stage before and of this one; ``values`` itself if it does.
        The two keys may share columns, which then hold the same values.  A key that
        is computed from the key before is given as ``made`` instead, an expression
        of those columns for each of its own."""
        if any(s.name == name for s in self.stages):
            raise ValueError(f"a stage is called {name!r} already")
        if made is not None:
            if edges is not None or set(made) != set(key):
                raise ValueError(f"{name!r} needs an expression for each key column, and then no edges")
            if taken := [c for c in key if c in self.rows_of(len(self.stages) - 1).columns]:
                raise ValueError(f"the rows before {name!r} have columns {taken} already")
            self.stages.append(Stage(name, values, list(key), None, dict(made)))
            return self
        edges = values if edges is None else edges
        columns = list(dict.fromkeys([*self.stages[-1].key, *key]))
        if missing := [c for c in columns if c not in edges.columns]:
            raise ValueError(f"the edges to {name!r} lack {missing}")
        self.stages.append(Stage(name, values, list(key), edges))
        return self

    def place(self, stage: str | int) -> int:
        names = [s.name for s in self.stages]
        return names.index(stage) if isinstance(stage, str) else range(len(names))[stage]

    def rows_of(self, place: int) -> DataFrame:
        """Rows that hold every id of a stage: its edges, the values of the source,
        or the rows of the stage before with the key that is made of them."""
        stage = self.stages[place]
        if stage.made is not None:
            return self.rows_of(place - 1).withColumns(stage.made)
        return stage.values if stage.edges is None else stage.edges

    def at(self, stage: str | int, ids: DataFrame) -> Cursor:
        """Ids at a stage; ``ids`` has its key columns (others are ignored, repeats count once)."""
        place = self.place(stage)
        return Cursor(self, place, ids.select(*self.stages[place].key))


class Cursor:
    """Ids at a stage of a job: the keys of ``rows``.  ``source`` is the frame that
    the rows were selected from, ``whole`` tells that all its rows with these ids
    are among them."""

    def __init__(self, lineage: Lineage, place: int, rows: DataFrame, source: DataFrame | None = None, whole: bool = False):
        self.lineage, self.place = lineage, place
        self._rows, self._source, self._whole = rows, source, whole
        self._kept, self._bytes = None, 0

    @property
    def stage(self) -> Stage:
        return self.lineage.stages[self.place]

    @property
    def ids(self) -> DataFrame:
        """The distinct ids; computed where they are used, unless a join has kept them."""
        return self._rows.select(*self.stage.key).distinct() if self._kept is None else self._kept

    def keep(self) -> Cursor:
        """Compute the ids now, once."""
        if self._kept is None:
            self._kept = materialize(self.ids)
            self._bytes = measured_bytes(self._kept)
        return self

    def _semi(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is among the ids; a struct, so that null ids join."""
        self.keep()
        key = F.struct(*[F.col(f"`{c}`") for c in self.stage.key])
        ids = self._kept.select(key.alias("_id"))
        return join_small(rows.withColumn("_id", key), ids, "_id", "left_semi", self._bytes, self.lineage.max_broadcast_bytes).drop("_id")

    def _passes(self, edges: DataFrame, target: Stage) -> bool:
        """Whether the rows at hand lead to the same ids as a join of ``edges`` with
        the ids: they come from these edges, and all rows of an id are there, or one
        is as good as all since the id itself holds the key that is looked for."""
        return edges is self._source and (self._whole or set(target.key) <= set(self.stage.key))

    def _back(self) -> Cursor:
        stage, to = self.stage, self.place - 1
        target = self.lineage.stages[to]
        if stage.made is not None:
            # the rows of an id before are chosen by that id alone: all or none
            rows = self.lineage.rows_of(to)
            return Cursor(self.lineage, to, self._semi(rows.withColumns(stage.made)), rows, True)
        if self._passes(stage.edges, target):
            return Cursor(self.lineage, to, self._rows, self._source)
        return Cursor(self.lineage, to, self._semi(stage.edges), stage.edges, set(stage.key) <= set(target.key))

    def _forward(self) -> Cursor:
        stage, to = self.stage, self.place + 1
        target = self.lineage.stages[to]
        if target.made is not None:
            return Cursor(self.lineage, to, self._rows.withColumns(target.made))
        if self._passes(target.edges, target):
            return Cursor(self.lineage, to, self._rows, self._source)
        return Cursor(self.lineage, to, self._semi(target.edges), target.edges, set(stage.key) <= set(target.key))

    def back(self, steps: int = 1) -> Cursor:
        """The ids that made these, ``steps`` steps before."""
        if not 0 <= steps <= self.place:
            raise ValueError(f"there are {self.place} steps before {self.stage.name!r}")
        return self if not steps else self._back().back(steps - 1)

    def back_all(self) -> Cursor:
        return self.back(self.place)

    def forward(self, steps: int = 1) -> Cursor:
        """The ids that are made from these, ``steps`` steps on."""
        left = len(self.lineage.stages) - 1 - self.place
        if not 0 <= steps <= left:
            raise ValueError(f"there are {left} steps after {self.stage.name!r}")
        return self if not steps else self._forward().forward(steps - 1)

    def show(self) -> DataFrame:
        """The rows of the stage that have these ids."""
        return self._semi(self.stage.values)
