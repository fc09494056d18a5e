"""Experiment configurations in JSON, and the catalogue of data sets."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from ..operators.frame import max_distance


@dataclass(frozen=True)
class DatasetParams:
    """What is known of a data set beforehand."""

    name: str
    box: tuple[float, float, float, float]
    objects: int = 0
    vocabulary: int = 0

    @property
    def max_distance(self) -> float:
        return max_distance(*self.box)


# Extents (x from, y from, x to, y to), objects and vocabulary of the public collections and of the three small samples.
CATALOGUE = {
    p.name: p
    for p in (
        DatasetParams("PAPER", (0.0, 0.0, 27.0, 30.0), 7, 5),
        DatasetParams("TESTING", (-4.0, -5.0, 8.0, 5.0), 10, 7),
        DatasetParams("ORIGINAL", (-4.0, -5.0, 5.0, 5.0), 8, 6),
        DatasetParams("HOTELS", (-159.0, 19.0, -68.0, 70.0), 20_000, 600),
        DatasetParams("POSTAL_CODES", (-176.0, -55.0, 180.0, 74.0), 171_000, 549_405),
        DatasetParams("SPORTS", (-180.0, -90.0, 180.0, 79.0), 1_750_000, 452_950),
        DatasetParams("PARKS", (-180.0, -90.0, 180.0, 81.0), 9_960_000, 1_002_722),
    )
}


@dataclass(frozen=True)
class DatasetConfig:
    """A data set of an experiment: a table of the driver (PART or DOCUMENTS), or files of places and keywords.

    ``usage`` is the share of its objects that take part; shares outside (0, 1] mean all. Of a data set in the
    catalogue the extent scales the costs, of any other the world's.
    """

    name: str = "PART"
    places: str | None = None
    keywords: str | None = None
    usage: float = 1.0

    @property
    def share(self) -> float:
        return self.usage if 0 < self.usage <= 1 else 1.0


@dataclass(frozen=True)
class QueryParams:
    """Defaults of one query; a sweep varies one of them at a time (fixed values of the experiments)."""

    queries: int = 20
    group_size: int = 10
    subgroup_percent: int = 60
    keywords: int = 4
    area: float = 0.01
    keyword_space: int = 3
    k: int = 10
    alpha: float = 0.5
    radius: float = 10.0
    join_distance: float = 0.01
    join_similarity: float = 0.5


@dataclass(frozen=True)
class Config:
    dataset: DatasetConfig = DatasetConfig()
    secondary: DatasetConfig | None = None
    smoothing: float = 0.2
    iterations: int = 1
    seed: int = 1
    params: QueryParams = QueryParams()
    sweeps: dict[str, list] = field(default_factory=dict)
    experiments: list[str] = field(default_factory=list)
    overrides: dict[str, dict] = field(default_factory=dict)


#: Older names of settings.
RENAMED = {"numberOfQueries": "queries", "groupSize": "group_size", "subGroupSize": "subgroup_percent", "numberOfKeywords": "keywords", "querySpaceArea": "area", "keywordSpace": "keyword_space", "topk": "k", "joinDistance": "join_distance", "joinSimilarity": "join_similarity"}


def _dataset(given: str | dict | None) -> DatasetConfig | None:
    return DatasetConfig(given) if isinstance(given, str) else DatasetConfig(**given) if given else None


def load(text: str) -> Config:
    """Unknown settings raise; a smoothing that is not positive becomes the default. A data set is a name or its settings."""
    raw = json.loads(text)
    rename = lambda d: {RENAMED.get(k, k): v for k, v in d.items()}
    params = QueryParams(**rename(raw.pop("params", {})))
    sweeps = rename(raw.pop("sweeps", {}))
    overrides = {k: rename(v) for k, v in raw.pop("overrides", {}).items()}
    dataset = _dataset(raw.pop("dataset", None)) or DatasetConfig()
    config = Config(dataset=dataset, secondary=_dataset(raw.pop("secondary", None)), params=params, sweeps=sweeps, overrides=overrides, **raw)
    return config if config.smoothing > 0 else dataclasses.replace(config, smoothing=0.2)


def save(config: Config) -> str:
    return json.dumps(dataclasses.asdict(config), indent=2, sort_keys=True)
