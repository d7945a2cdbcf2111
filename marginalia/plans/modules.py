"""Modules: named stages from artifacts to artifacts, registered by ``kind:label``.

A module is a function over a DataFrame of inputs (doc_id, region_id, content and what else
the stage before gave) that returns (doc_id, region_id, content, problem). It runs where
Spark puts the partitions; a document or region it can't do has a problem and no content.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Execute = Callable[[DataFrame, Mapping[str, object]], DataFrame]


@dataclass(frozen=True)
class Module:
    name: str
    version: str
    input_types: frozenset[str]
    output_types: frozenset[str]
    execute: Execute
    params: Mapping[str, object] = field(default_factory=dict)

    def __call__(self, inputs: DataFrame) -> DataFrame:
        return self.execute(inputs, self.params)


class Modules:
    """Builders by kind; a module is asked for as ``kind:label`` and must bear that name."""

    def __init__(self):
        self._builders: dict[str, Callable[..., Module]] = {}

    def register(self, kind: str, builder: Callable[..., Module]) -> None:
        if not kind or ":" in kind:
            raise ValueError(f"not a kind: {kind!r}")
        self._builders[kind] = builder

    def kinds(self) -> list[str]:
        return sorted(self._builders)

    def build(self, name: str, **params) -> Module:
        kind, _, label = name.partition(":")
        if kind not in self._builders:
            raise KeyError(f"unknown kind: {kind!r}, known are {self.kinds()}")
        module = self._builders[kind](label, **params)
        if module.name != name:
            raise ValueError(f"{name!r} built a module named {module.name!r}")
        return module


def discover(modules: Modules, group: str = "marginalia.modules", trusted: bool = False) -> dict[str, str]:
    """Registers the builders that installed packages offer in an entry point group; the problems of those that don't load, by name.

    Code of others is only loaded where it is trusted.
    """
    problems: dict[str, str] = {}
    for entry in sorted(entry_points(group=group), key=lambda e: e.name) if trusted else ():
        try:
            modules.register(entry.name, entry.load())
        except Exception as problem:  # noqa: BLE001 - whatever a plug-in raises must not end the others
            problems[entry.name] = repr(problem)
    return problems


def column_module(name: str, version: str, column: Callable[[Column], Column], inputs=("raw_text",), outputs=("corrected_text",)) -> Module:
    """A module that is one expression over the content; null content is a problem."""

    def execute(rows: DataFrame, params: Mapping[str, object]) -> DataFrame:
        out = rows.withColumn("content", column(F.col("content")))
        return out.withColumn("problem", F.when(F.col("content").isNull(), F.lit("no content")).otherwise(F.col("problem") if "problem" in rows.columns else F.lit(None).cast("string")))

    return Module(name, version, frozenset(inputs), frozenset(outputs), execute)


def chain(modules: list[Module], inputs: DataFrame) -> DataFrame:
    """One after the other; what one gives the next must take."""
    for before, after in zip(modules, modules[1:]):
        if not before.output_types & after.input_types:
            raise ValueError(f"{after.name} takes nothing that {before.name} gives")
    for module in modules:
        inputs = module(inputs)
    return inputs


def fan_out(regions: DataFrame, module: Module) -> DataFrame:
    """The layout rows (doc_id, region_id, dfs_pos, leaf, lines ...) with the texts a module gives for each leaf.

    Regions are rows, so they run side by side; one that fails keeps its lines and is
    counted in ``problems`` of its document.
    """
    asked = regions.filter("leaf").select("doc_id", "region_id", F.array_join("lines", "\n").alias("content"))
    done = module(asked).select("doc_id", "region_id", F.col("content").alias("__text"), F.col("problem").alias("__problem"))
    out = regions.join(done, ["doc_id", "region_id"], "left")
    failed = out.groupBy("doc_id").agg(F.count("__problem").alias("problems"))
    filled = F.when(F.col("__problem").isNull() & F.col("__text").isNotNull(), F.split("__text", "\n")).otherwise(F.col("lines"))
    return out.withColumn("lines", filled).drop("__text", "__problem").join(failed, "doc_id")
