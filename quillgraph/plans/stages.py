"""Stages as plug-ins: named functions from tables to tables, run in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """run gets all tables and returns those that it changes or adds. Optional stages run only if they are named."""

    name: str
    run: Callable[[Tables], Tables]
    needs: tuple[str, ...] = ()
    optional: bool = False


def run_stages(stages: list[Stage], tables: Tables, only: set[str] | None = None, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> Tables:
    """The tables after the stages; ``only`` picks some by name; ``keep`` may store what a stage wrote and read it back."""
    names = {s.name for s in stages}
    if only is not None and (unknown := only - names):
        raise ValueError(f"no such stages: {sorted(unknown)}")
    out = dict(tables)
    for s in stages:
        if s.name in only if only is not None else not s.optional:
            if lacking := [n for n in s.needs if n not in out]:
                raise ValueError(f"{s.name} lacks {lacking}")
            out |= {n: keep(n, df) if keep else df for n, df in s.run(out).items()}
    return out
