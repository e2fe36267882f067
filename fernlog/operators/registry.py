"""Analyzers by name: functions from lines to findings; one that fails leaves a warning and doesn't stop the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fernlog.operators.logs import union_findings
from fernlog.storage import stored


@dataclass
class Registry:
    analyzers: dict[str, tuple[list[str], Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)

    def register(self, name: str, types: list[str], fn: Callable[[DataFrame], DataFrame]) -> None:
        if name in self.analyzers:
            raise ValueError(f"there is an analyzer {name}")
        self.analyzers[name] = (types, fn)

    def run(self, lines: DataFrame) -> tuple[DataFrame | None, list[dict]]:
        """All findings of ``lines`` (with ``type``), and the state of each run.

        Each analyzer's findings are written to the shared folder on their own, so that one which fails while it runs,
        or whose plan can't be made, takes none of the others' findings with it.
        """
        found, runs = [], []
        for name, (types, fn) in self.analyzers.items():
            try:
                found.append(stored(fn(lines.where(lines["type"].isin(types)).drop("type")), "analyzer"))
                runs.append({"name": name, "status": "completed", "warning": None})
            except Exception as e:  # noqa: BLE001  whatever an analyzer raises is its own failure
                runs.append({"name": name, "status": "failed", "warning": str(e).splitlines()[0][:300]})
        return (union_findings(*found) if found else None), runs
