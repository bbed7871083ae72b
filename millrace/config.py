"""Configuration: sections with defaults, validation, and overrides per environment."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

SOURCE_TYPES = {"s3", "dynamodb", "api", "confluence", "notion", "github", "local"}
STRATEGIES = {"auto", "recursive", "semantic", "sentence", "fixed", "adaptive", "code_aware", "table", "hierarchical"}
ENVIRONMENTS = ("dev", "staging", "prod")


@dataclass
class Source:
    name: str = ""
    type: str = ""
    config: dict = field(default_factory=dict)
    file_types: list = field(default_factory=lambda: ["md", "txt", "pdf"])
    update_frequency: str = "daily"
    access_control: dict = field(default_factory=dict)


@dataclass
class Chunking:
    strategy: str = "auto"
    max_chunk_size: int = 512
    min_chunk_size: int = 50
    overlap: int = 50
    metadata_extraction: dict = field(default_factory=lambda: dict.fromkeys(("title", "date", "author"), True))
    strategies: dict = field(default_factory=dict)


@dataclass
class Embedding:
    model: str = "local/dev"
    dimensions: int = 1024
    batch_size: int = 100
    quantization: str = "float32"


@dataclass
class Storage:
    provider: str = "parquet"
    index_name: str = "index"
    replicas: int = 1
    config: dict = field(default_factory=dict)


@dataclass
class Retrieval:
    method: str = "hybrid"
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3
    top_k: int = 5
    reranking: dict = field(default_factory=dict)


@dataclass
class Query:
    endpoint: bool = True
    timeout_ms: int = 3000
    cache: dict = field(default_factory=dict)


@dataclass
class Quality:
    evaluation: dict = field(default_factory=dict)
    drift_detection: dict = field(default_factory=dict)
    feedback: dict = field(default_factory=dict)
    alerts: list = field(default_factory=list)


@dataclass
class Cost:
    budget: dict = field(default_factory=lambda: {"monthly_total": 100.0})
    optimization: dict = field(default_factory=dict)


_SECTIONS = {"chunking": Chunking, "embedding": Embedding, "storage": Storage, "retrieval": Retrieval, "query": Query, "quality": Quality, "cost": Cost}


@dataclass
class Config:
    project_name: str = "project"
    project_version: str = "1.0.0"
    data_sources: list[Source] = field(default_factory=list)
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    storage: Storage = field(default_factory=Storage)
    retrieval: Retrieval = field(default_factory=Retrieval)
    query: Query = field(default_factory=Query)
    quality: Quality = field(default_factory=Quality)
    cost: Cost = field(default_factory=Cost)
    environments: dict = field(default_factory=dict)

    def problems(self) -> list[str]:
        """What is wrong with the values, all of it."""
        c, r = self.chunking, self.retrieval
        weights = r.semantic_weight + r.keyword_weight
        checks = [
            (not self.data_sources, "there is no data source"),
            *[(not s.name, "a data source has no name") for s in self.data_sources],
            *[(s.type not in SOURCE_TYPES, f"{s.type!r} is no type of data source") for s in self.data_sources],
            (c.max_chunk_size < c.min_chunk_size, "max_chunk_size is below min_chunk_size"),
            (c.overlap >= c.max_chunk_size, "overlap has to be below max_chunk_size"),
            (self.embedding.dimensions < 1, "dimensions have to be positive"),
            (r.top_k < 1, "top_k has to be positive"),
            (r.method == "hybrid" and abs(weights - 1) > 0.01, f"the weights add up to {weights}, not 1"),
            (c.strategy not in STRATEGIES, f"{c.strategy!r} is no chunking strategy"),
        ]
        return [text for wrong, text in checks if wrong]


def _merge(section: Any, values: dict) -> None:
    known = {f.name for f in fields(section)}
    for key, value in (values or {}).items():
        if key in known:
            setattr(section, key, value)


def _apply(config: Config, values: dict) -> None:
    project = values.get("project") or {}
    config.project_name = values.get("project_name", project.get("name", config.project_name))
    config.project_version = str(project.get("version", config.project_version))
    for name in _SECTIONS:
        _merge(getattr(config, name), values.get(name))
    if "data_sources" in values:
        known = {f.name for f in fields(Source)}
        config.data_sources = [s if isinstance(s, Source) else Source(**{k: v for k, v in s.items() if k in known}) for s in values["data_sources"] or []]


def parse(values: dict) -> Config:
    config = Config()
    _apply(config, values)
    config.environments = dict(values.get("environments") or {})
    wrong = config.problems()
    if wrong:
        raise ValueError("; ".join(wrong))
    return config


def load(path: str) -> Config:
    """Read YAML (where a YAML library is installed) or JSON; a missing or empty file is an error."""
    text = Path(path).read_text("utf-8")
    if not text.strip():
        raise ValueError(f"{path} is empty")
    try:
        import yaml
    except ImportError:
        yaml = None
    values = yaml.safe_load(text) if yaml is not None else json.loads(text)
    if not isinstance(values, dict):
        raise ValueError(f"{path} has no sections")
    return parse(values)


def for_environment(config: Config, name: str, overrides: dict | None = None) -> Config:
    """A copy with the environment's values: sections merge key by key, data sources are replaced, unknown keys are passed over."""
    if name not in ENVIRONMENTS:
        raise ValueError(f"{name!r} is no environment; there are {', '.join(ENVIRONMENTS)}")
    out = copy.deepcopy(config)
    _apply(out, config.environments.get(name) or {} if overrides is None else overrides)
    return out
