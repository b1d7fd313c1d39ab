"""Settings, checked strictly: a field that is not known is an error at every level."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints


@dataclass(frozen=True)
class CorpusConfig:
    scales: tuple[int, ...] = (5000, 100000)
    sample: int = 0
    jaccard: float = 0.85
    seed: int = 42
    retain_seed: bool = True

    def __post_init__(self) -> None:
        if not self.scales or min(self.scales) <= 0 or len(set(self.scales)) != len(self.scales):
            raise ValueError("scales must be different numbers above 0")
        object.__setattr__(self, "scales", tuple(sorted(self.scales)))
        if self.sample < 0:
            raise ValueError("sample must not be negative")
        if not 0 <= self.jaccard <= 1:
            raise ValueError("jaccard must be from 0 to 1")


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 0.9
    b: float = 0.4
    method: str = "lucene"
    stopwords: bool = True


@dataclass(frozen=True)
class VectorConfig:
    encoder: str = "hash-embed"
    exact_to: int = 5000
    nlist: dict[int, int] = field(default_factory=lambda: {5000: 512, 100000: 2048, 500000: 4096, 1000000: 4096})
    nprobe: tuple[int, ...] = (4, 8, 16, 32, 64, 256)
    m: int = 48
    bits: int = 4
    k_factor: int = 4
    coarse: str = "kmeans"  # or "lloyd": fixed rounds from the vectors of the smallest ids
    rounds: int = 2

    def __post_init__(self) -> None:
        if self.coarse not in ("kmeans", "lloyd"):
            raise ValueError("coarse is kmeans or lloyd")

    def nlist_for_scale(self, scale: int) -> int:
        """The setting of the nearest scale that has one."""
        if not self.nlist:
            raise KeyError("no scale has an nlist")
        return self.nlist[min(self.nlist, key=lambda s: (abs(s - scale), s))]


@dataclass(frozen=True)
class HybridConfig:
    rrf_k: tuple[int, ...] = (10, 30, 60, 100, 200)
    weights: tuple[tuple[float, float], ...] = ((1.0, 1.0), (0.5, 0.5), (0.7, 0.3))
    pool: int = 100


@dataclass(frozen=True)
class RerankConfig:
    slug: str = "overlap"
    pool: int = 50
    tail: bool = False


@dataclass(frozen=True)
class PreflightConfig:
    target: float = 0.6789
    tolerance: float = 0.03
    least: float = 0.62


@dataclass(frozen=True)
class LatencyConfig:
    """Calls that are timed for each row of results, after the calls that are not; none by default."""

    calls: int = 0
    warmup: int = 1


@dataclass(frozen=True)
class Config:
    corpus: CorpusConfig = CorpusConfig()
    bm25: Bm25Config = Bm25Config()
    vector: VectorConfig = field(default_factory=VectorConfig)
    hybrid: HybridConfig = HybridConfig()
    rerank: RerankConfig = RerankConfig()
    preflight: PreflightConfig = PreflightConfig()
    latency: LatencyConfig = LatencyConfig()
    k_values: tuple[int, ...] = (10, 100)


def _tuples(x: Any) -> Any:
    return tuple(_tuples(y) for y in x) if isinstance(x, list) else x


def build(kind: type, values: dict) -> Any:
    """A settings object from plain values; lists become tuples, and nlist may be a list beside the scales."""
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"{kind.__name__}: unknown fields {sorted(unknown)}")
    hints, out = get_type_hints(kind), {}
    for name, value in values.items():
        if is_dataclass(hints[name]):
            out[name] = build(hints[name], value)
        elif name == "nlist":
            out[name] = {int(k): int(v) for k, v in value.items()}
        else:
            out[name] = _tuples(value)
    return kind(**out)


def load_config(path: str | None = None) -> Config:
    """From a JSON file, or YAML where that library is there; the defaults without a path."""
    if path is None:
        return Config()
    with open(path) as f:
        text = f.read()
    try:
        values = json.loads(text)
    except ValueError:
        import yaml

        values = yaml.safe_load(text)
    nlist = values.get("vector", {}).get("nlist")
    if isinstance(nlist, list):
        scales = values.get("corpus", {}).get("scales", list(CorpusConfig().scales))
        if len(scales) != len(nlist):
            raise ValueError("nlist and scales have different lengths")
        values["vector"]["nlist"] = dict(zip(scales, nlist))
    return build(Config, values)
