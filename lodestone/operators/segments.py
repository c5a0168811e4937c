"""Keyed tables that change by small steps: Parquet folders that are never changed once written, and a list of those that count.

    path/state/v=N              a row for each segment that counts
    path/<table>/segment=S      a segment's rows
    path/dead/by=T/of=S         keys of segment S whose rows went by the change T

A change writes its own rows, the keys that go, and the next state. Nothing is seen of it before its state is whole,
and then all tables are switched at once; a change that breaks off leaves folders that no state names. Of two changes to
one state the second fails, as its state is there already. Segments of like size are merged, and lose their dead rows then, so
there are few of them and a row is rewritten a number of times that grows with the logarithm of the whole.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

#: So many segments of like size are merged into one; so are those with more dead rows than live ones.
FAN = 8
_STATE = "segment string, n long, total long, n_dead long, total_dead long, dead_by array<string>, note string"
_EMPTY = "_empty"


@dataclass
class Segments:
    """tables: names and schemas; each has the column key. The first has one row for each key and change, and a number to sum, measure.

    arrange: how a table's rows are laid out when they are written.
    """

    spark: SparkSession
    path: str
    key: str
    tables: dict[str, str]
    measure: str
    arrange: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    @property
    def main(self) -> str:
        return next(iter(self.tables))

    # --- states ----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """The states that are whole."""
        fs, p = self._folder(f"{self.path}/state")
        if not fs.exists(p):
            return []
        found = (s.getPath() for s in fs.listStatus(p))
        return sorted(int(d.getName()[2:]) for d in found if d.getName().startswith("v=") and fs.exists(self._folder(f"{d}/_SUCCESS")[1]))

    def state(self, version: int | None = None) -> list[dict]:
        """The segments of a version, the last by default: few rows."""
        if version is None:
            version = next(reversed(self.versions()), None)
        if version is None:
            return []
        return [r.asDict() for r in self.spark.read.schema(_STATE).parquet(f"{self.path}/state/v={version}").collect()]

    @property
    def note(self) -> str | None:
        """What the last change noted; None without one."""
        return next((s["note"] for s in self.state()), None)

    def totals(self) -> tuple[int, int]:
        """How many rows the main table has, and the sum of their measure; from the state alone."""
        state = self.state()
        return sum(s["n"] - s["n_dead"] for s in state), sum(s["total"] - s["total_dead"] for s in state)

    # --- reading ---------------------------------------------------------------------------

    def _schema(self, table: str) -> str:
        return f"{self.tables[table]}, segment string"

    def _rows(self, table: str, state: list[dict]) -> DataFrame:
        """Rows of the state's segments, dead ones too, with their segment."""
        paths = [f"{self.path}/{table}/segment={s['segment']}" for s in state if s["segment"] != _EMPTY]
        if not paths:
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _live(self, table: str, state: list[dict]) -> DataFrame:
        rows = self._rows(table, state)
        paths = [f"{self.path}/dead/by={by}/of={s['segment']}" for s in state for by in s["dead_by"]]
        if not paths:
            return rows
        kind = rows.schema[self.key].dataType.simpleString()
        dead = self.spark.read.schema(f"{self.key} {kind}, by string, of string").option("basePath", f"{self.path}/dead").parquet(*paths)
        return rows.join(dead.select(self.key, F.col("of").alias("segment")), [self.key, "segment"], "left_anti").select(*rows.columns)

    def read(self, table: str | None = None) -> DataFrame:
        """The rows that count. A filter reaches the files. The state is the one of now, so a change later on is not seen."""
        return self._live(table or self.main, self.state()).drop("segment")

    # --- writing ---------------------------------------------------------------------------

    def _write_state(self, version: int, segments: list[dict], note: str | None) -> None:
        # An empty state has a row too, so that it holds the note.
        none = {"segment": _EMPTY, "n": 0, "total": 0, "n_dead": 0, "total_dead": 0, "dead_by": []}
        rows = [s | {"note": note} for s in segments if s["segment"] != _EMPTY] or [none | {"note": note}]
        self.spark.createDataFrame([tuple(r[c.split()[0]] for c in _STATE.split(", ")) for r in rows], _STATE).coalesce(1).write.parquet(f"{self.path}/state/v={version}")

    def _write_segment(self, name: str, frames: dict[str, DataFrame]) -> dict:
        for table, rows in frames.items():
            self.arrange.get(table, lambda x: x)(rows).write.parquet(f"{self.path}/{table}/segment={name}")
        found = self.spark.read.schema(self.tables[self.main]).parquet(f"{self.path}/{self.main}/segment={name}")
        n, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(self.measure), F.lit(0)).cast("long")).first()
        return {"segment": name, "n": n, "total": total, "n_dead": 0, "total_dead": 0, "dead_by": []}

    def _bury(self, name: str, state: list[dict], gone: DataFrame) -> list[dict]:
        """The state once the rows of gone's keys are dead."""
        if not any(s["n"] for s in state):
            return state
        live = self._live(self.main, state).select(self.key, F.col(self.measure).alias("measure"), F.col("segment").alias("of"))
        path = f"{self.path}/dead/by={name}"
        live.join(gone.select(self.key).distinct(), self.key, "left_semi").write.partitionBy("of").parquet(path)
        kind = live.schema[self.key].dataType.simpleString()
        dead = self.spark.read.schema(f"{self.key} {kind}, measure long, of string").parquet(path)
        told = {r["of"]: r for r in dead.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("measure"), F.lit(0)).alias("total")).collect()}  # a row for each segment
        return [s | {"n_dead": s["n_dead"] + told[k].n, "total_dead": s["total_dead"] + told[k].total, "dead_by": [*s["dead_by"], name]} if (k := s["segment"]) in told else s for s in state]

    def change(self, frames: dict[str, DataFrame] | None = None, gone: DataFrame | None = None, note: str | None = None, whole: bool = False) -> None:
        """Adds rows to all tables, once those of gone's keys have left; whole: once all have left."""
        known = self.versions()
        version = known[-1] + 1 if known else 1
        state = [] if whole or not known else self.state(known[-1])
        name = f"{version}-{uuid.uuid4().hex[:8]}"
        if gone is not None:
            state = self._bury(name, state, gone)
        if frames:
            new = self._write_segment(name, frames)
            state = [*state, new] if new["n"] else state
        self._write_state(version, state, note)
        self.merge()
        self._clean()

    def merge(self, fan: int = FAN) -> None:
        """Merges segments of like size where there are many of them, and rewrites those that are mostly dead."""
        known = self.versions()
        state = self.state(known[-1])
        alive = {s["segment"]: s["n"] - s["n_dead"] for s in state if s["segment"] != _EMPTY}
        tiers: dict[int, list[str]] = {}
        for name, n in alive.items():
            tiers.setdefault(int(math.log(max(n, 1), fan)), []).append(name)
        chosen = {name for names in tiers.values() if len(names) >= fan for name in names}
        chosen |= {s["segment"] for s in state if s["n_dead"] > s["n"] / 2 or len(s["dead_by"]) > fan * fan}
        if not chosen:
            return
        of, rest = [s for s in state if s["segment"] in chosen], [s for s in state if s["segment"] not in chosen]
        version = known[-1] + 1
        if any(alive[s["segment"]] for s in of):
            rest = [*rest, self._write_segment(f"{version}-{uuid.uuid4().hex[:8]}", {t: self._live(t, of).drop("segment") for t in self.tables})]
        self._write_state(version, rest, state[0]["note"])

    def _clean(self) -> None:
        """Deletes states but the last three, and what only these named."""
        known = self.versions()
        old, kept = known[:-3], [self.state(v) for v in known[-3:]]
        segments = {s["segment"] for state in kept for s in state}
        dead = {(by, s["segment"]) for state in kept for s in state for by in s["dead_by"]}
        for version in old:
            for s in self.state(version):
                if s["segment"] not in segments:
                    for table in self.tables:
                        self._delete(f"{self.path}/{table}/segment={s['segment']}")
                for by in s["dead_by"]:
                    if (by, s["segment"]) not in dead:
                        self._delete(f"{self.path}/dead/by={by}/of={s['segment']}")
            self._delete(f"{self.path}/state/v={version}")

    def _delete(self, path: str) -> None:
        fs, p = self._folder(path)
        fs.delete(p, True)
