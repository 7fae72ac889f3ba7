"""A preprocessing run from a configuration: which stages, in which order, with which arguments."""

from __future__ import annotations

import ast
import configparser
from collections.abc import Callable

from pyspark.sql import DataFrame

from cladeworks.operators import molecules
from cladeworks.sources.scratch import written

STAGES: dict[str, Callable[..., DataFrame]] = {
    "quality": molecules.quality_filter,
    "resolve": molecules.resolve_umi_sequence,
    "whitelist": molecules.correct_to_whitelist,
    "umi_correction": molecules.correct_umis,
    "filter": molecules.filter_molecule_table,
}
REQUIRED = ("name", "input")


def parse(text: str) -> dict[str, dict[str, object]]:
    """Sections of an INI text with every value read as a Python literal; [general] must name the run and its input."""
    reader = configparser.ConfigParser()
    reader.optionxform = str
    reader.read_string(text)
    found = {s: {k: ast.literal_eval(v) for k, v in reader[s].items()} for s in reader.sections()}
    missing = [k for k in REQUIRED if k not in found.get("general", {})]
    unknown = [s for s in found if s != "general" and s not in STAGES]
    if missing or unknown:
        raise ValueError(f"missing in [general]: {missing}; unknown stages: {unknown}")
    return found


def chain(entry: str, exit_: str) -> list[str]:
    """The stages from entry to exit, both included."""
    names = list(STAGES)
    if entry not in names or exit_ not in names or names.index(entry) > names.index(exit_):
        raise ValueError(f"no stages from {entry} to {exit_}")
    return names[names.index(entry) : names.index(exit_) + 1]


def run(table: DataFrame, config: dict[str, dict[str, object]], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Apply the configured stages between the general section's entry and exit, each written before the next. A stage without a section, or a whitelist stage without a whitelist, is left out.

    Where a whitelist corrects barcodes, the filter stage does not correct them again.
    """
    general, white = config["general"], (tables or {}).get("whitelist")
    for name in chain(str(general.get("entry", "quality")), str(general.get("exit", "filter"))):
        if name not in config or (name == "whitelist" and white is None):
            continue
        options = dict(config[name])
        if name == "whitelist":
            options["whitelist"] = white
        if name == "filter" and "whitelist" in config and white is not None:
            options.setdefault("distance", 0)
        table = written(STAGES[name](table, **options), f"stage-{name}")
    return table
