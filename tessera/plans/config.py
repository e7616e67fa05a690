"""Settings that change results, as frozen dataclasses; unknown names are rejected."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class GateConfig:
    semantic_weight: float = 0.7
    sparse_weight: float = 0.3
    threshold: float = 0.45


@dataclass(frozen=True)
class RetrievalConfig:
    k: int = 6
    fetch_factor: int = 2
    lambda_mult: float = 0.6
    score_threshold: float = 0.6
    search_type: str = "mmr"
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self):
        object.__setattr__(self, "search_type", self.search_type.lower())
        if self.search_type not in ("similarity", "mmr", "similarity_score_threshold", "hybrid"):
            raise ValueError(f"unknown search type {self.search_type!r}")


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 345
    overlap: int = 56
    least_chars: int = 50
    least_score: float = 0.3


@dataclass(frozen=True)
class ChatConfig:
    max_turns: int = 5
    merge: str = "api_first"
    gate: bool = True
    retrieve_with_history: bool = False
    validate: bool = True
    provider: str = "none"
    system_message: str = "You are a helpful assistant. Use the following context and conversation history to answer the question."


    def __post_init__(self):
        object.__setattr__(self, "provider", self.provider.lower())


@dataclass(frozen=True)
class KeywordConfig:
    per_document: int = 10
    final: int = 100
    least_length: int = 3
    least_documents: int | None = None
    least_fraction: float = 0.01
    diversity: float = 0.3
    clusters: int = 4
    seed: int = 42


@dataclass(frozen=True)
class CentroidConfig:
    mode: str = "auto"
    share: float = 0.5
    diversity: float = 0.01


@dataclass(frozen=True)
class EngineConfig:
    gate: GateConfig = field(default_factory=GateConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    chat: ChatConfig = field(default_factory=ChatConfig)
    keywords: KeywordConfig = field(default_factory=KeywordConfig)
    centroid: CentroidConfig = field(default_factory=CentroidConfig)


#: Earlier names of settings, by the section they are in.
EARLIER = {KeywordConfig: {"extraction_diversity": "diversity", "final_top_n": "final", "top_n_per_doc": "per_document"}, CentroidConfig: {"centroid_diversity": "diversity"}}


def _renamed(values: dict[str, Any], kind) -> dict[str, Any]:
    """Settings under their present names; an earlier name that is given, and isn't null, goes before the present one.

    min_doc_freq is a number of documents, or a share of them where min_doc_freq_mode says `fraction`.
    """
    out = dict(values)
    for old, new in EARLIER.get(kind, {}).items():
        if (value := out.pop(old, None)) is not None:
            out[new] = value
    if kind is KeywordConfig:
        mode, least = out.pop("min_doc_freq_mode", "absolute"), out.pop("min_doc_freq", None)
        if mode not in ("absolute", "fraction"):
            raise ValueError(f"unknown min_doc_freq_mode {mode!r}")
        if least is not None:
            out["least_documents" if mode == "absolute" else "least_fraction"] = least if mode == "absolute" else float(least)
    return out


def with_keys(cfg: EngineConfig, keys: Mapping[str, str]) -> EngineConfig:
    """The configuration with its provider, if ``keys`` (an environment, say) has one under PROVIDER_API_KEY, else with none."""
    if cfg.chat.provider == "none" or keys.get(f"{cfg.chat.provider.upper()}_API_KEY"):
        return cfg
    return dataclasses.replace(cfg, chat=dataclasses.replace(cfg.chat, provider="none"))


def from_mapping(values: dict[str, Any], kind=EngineConfig):
    """A configuration from nested mappings; unknown names raise, earlier ones count."""
    fields, values = {f.name: f for f in dataclasses.fields(kind)}, _renamed(values, kind)
    if unknown := sorted(set(values) - set(fields)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = {}
    for name, value in values.items():
        made = fields[name].default_factory if fields[name].default_factory is not dataclasses.MISSING else None
        out[name] = from_mapping(value, made) if made and isinstance(value, dict) else value
    return kind(**out)


def deep_merge(base: dict, change: dict) -> dict:
    """Nested mappings merge, everything else (lists too) is replaced."""
    out = dict(base)
    for k, v in change.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def changed_sections(old: dict, new: dict) -> list[str]:
    """Top-level names whose value differs, sorted."""
    return sorted(k for k in {*old, *new} if old.get(k) != new.get(k))


def load(path: str) -> EngineConfig:
    """The configuration of a YAML file; an empty one gives the defaults."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {})


def save(change: dict, path: str) -> list[str]:
    """Merges ``change`` into a YAML file in one step and returns the sections that changed; without any
    the file stays as it is. The result has to be a valid configuration."""
    import os

    import yaml

    old = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = yaml.safe_load(f) or {}
    new = deep_merge(old, change)
    from_mapping(new)
    if changed := changed_sections(old, new):
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            yaml.safe_dump(new, f, sort_keys=True, allow_unicode=True)
        os.replace(f"{path}.new", path)
    return changed
