"""Configuration: sections as dataclasses, from TOML or JSON, where a section may name another file."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

from ..functions.roi import Roi
from ..operators.objective import SolveParameters
from ..operators.search import random_configs


def load(path: str) -> dict:
    """The file's content, with every string value that names a TOML or JSON file beside it replaced by that file's content."""
    file = Path(path)
    raw = tomllib.loads(file.read_text()) if file.suffix == ".toml" else json.loads(file.read_text())

    def follow(value):
        if isinstance(value, dict):
            return {k: follow(v) for k, v in value.items()}
        if isinstance(value, str) and value.endswith((".toml", ".json")) and (file.parent / value).exists():
            return load(str(file.parent / value))
        return value

    return follow(raw)


def make(kind, values: dict):
    """A dataclass from a dictionary, nested sections included; unknown names are errors."""
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings {sorted(unknown)} in {kind.__name__}")
    made = {}
    for name, value in values.items():
        section = known[name].metadata.get("section")
        made[name] = make(section, value) if section and isinstance(value, dict) else value
    return kind(**made)


def dump(config) -> str:
    return json.dumps(asdict(config) if is_dataclass(config) else config, indent=1, sort_keys=True, default=str)


def section(kind, **more):
    return field(metadata={"section": kind}, **more)


@dataclass
class RoiSection:
    offset: list
    shape: list

    def __post_init__(self):
        if len(self.offset) != 4 or len(self.shape) != 4:
            raise ValueError("a box has four offsets and four sizes")

    @property
    def roi(self) -> Roi:
        return Roi(tuple(self.offset), tuple(self.shape))


@dataclass
class ExtractSection:
    edge_move_threshold: float | dict = 15.0
    use_motion: bool = True

    def __post_init__(self):
        if not isinstance(self.edge_move_threshold, dict):
            self.edge_move_threshold = {-1: float(self.edge_move_threshold)}
        self.edge_move_threshold = {int(k): float(v) for k, v in self.edge_move_threshold.items()}


@dataclass
class SolveSection:
    """Either a list of parameter sets, a grid, or a random search of ``num_configs`` sets; greedy tracking needs none."""

    parameters: list = field(default_factory=list)
    search: dict = field(default_factory=dict)
    grid: dict = field(default_factory=dict)
    num_configs: int | None = None
    seed: int = 42
    greedy: bool = False
    clip_low_score: float | None = None
    from_scratch: bool = False
    block_size: list | None = None
    context: list | None = None

    def __post_init__(self):
        if (self.block_size is None) != (self.context is None):
            raise ValueError("block_size and context belong together")
        for given in (self.block_size, self.context):
            if given is not None and (len(given) != 4 or any(v is not None and v < 0 for v in given)):
                raise ValueError("block_size and context have four values, t, z, y and x; 0 in a block's size: not cut")
        if self.block_size and any(s and 2 * c > s for s, c in zip(self.block_size, self.context)):
            raise ValueError("context can be half a block at most")
        if bool(self.parameters) + bool(self.search) + bool(self.grid) > 1:
            raise ValueError("parameters, search and grid exclude one another")
        if self.search and not self.num_configs:
            raise ValueError("a random search needs num_configs")

    def blocks(self) -> dict:
        """size and context of ``solve_store``; none are given where the config has none."""
        if self.block_size is None:
            return {}
        return {"size": tuple(v or None for v in self.block_size), "context": tuple(self.context)}

    def sets(self) -> dict[int, SolveParameters]:
        if self.search:
            rows = random_configs(self.search, self.num_configs, self.seed)
        elif self.grid:
            rows = [{}]
            for name, values in self.grid.items():
                rows = [r | {name: v} for r in rows for v in (values if isinstance(values, list) else [values])]
        else:
            rows = self.parameters or [{}]
        return verified({i + 1: SolveParameters(**{k: v for k, v in r.items() if v is not None}) for i, r in enumerate(rows)})


def verified(sets: dict[int, SolveParameters]) -> dict[int, SolveParameters]:
    """The sets; those that look at the border need to know how far a cell moves, and all must look at it or none."""
    if len({p.check_node_close_to_roi for p in sets.values()}) > 1:
        raise ValueError("parameter sets differ in check_node_close_to_roi")
    if any(p.check_node_close_to_roi and not p.max_cell_move for p in sets.values()):
        raise ValueError("max_cell_move has to be set")
    return sets


def search_files(sets: dict[int, SolveParameters], folder: str) -> list[str]:
    """One configuration file for each parameter set, as an array job reads them; their names in order."""
    paths = []
    for k, p in sets.items():
        paths.append(f"{folder}/parameters_{k}.json")
        with open(paths[-1], "w") as f:
            json.dump({"parameters": [asdict(p)]}, f, indent=1)
    return paths


@dataclass
class EvaluateSection:
    matching_threshold: float = 15.0
    window_size: int = 50
    sparse: bool = True
    fn_div_count_unconnected_parent: bool = True
    validation_score: bool = False
    ignore_one_off_div_errors: bool = False
    exempt_divisions_after_end: bool = False
    from_scratch: bool = False
    roi: RoiSection | None = section(RoiSection, default=None)


@dataclass
class Config:
    store: str
    roi: RoiSection | None = section(RoiSection, default=None)
    extract: ExtractSection = section(ExtractSection, default_factory=ExtractSection)
    solve: SolveSection = section(SolveSection, default_factory=SolveSection)
    evaluate: EvaluateSection = section(EvaluateSection, default_factory=EvaluateSection)

    def __post_init__(self):
        own, whole = self.evaluate.roi, self.roi
        if own is not None and whole is not None and own.shape[0] is not None and whole.shape[0] is not None and own.shape[0] > whole.shape[0]:
            raise ValueError("the box of evaluation has more frames than the data's")

    @property
    def evaluation_roi(self) -> Roi | None:
        """Its own box, else the data's."""
        chosen = self.evaluate.roi or self.roi
        return None if chosen is None else chosen.roi

    @classmethod
    def from_file(cls, path: str) -> Config:
        return make(cls, load(path))


def work_items(samples: list[str], checkpoints: list[int], param_ids: list[int] | None = None) -> list[dict]:
    """Every sample with every checkpoint and parameter set."""
    return [{"sample": s, "checkpoint": c} | ({} if p is None else {"param_id": p}) for s in samples for c in checkpoints for p in (param_ids or [None])]


def latest(names: list[str]) -> str | None:
    """The name with the greatest number in it."""
    numbered = [(int("".join(filter(str.isdigit, n)) or -1), n) for n in names]
    return max(numbered)[1] if numbered else None
