"""Frozen parameters of every operator; validation happens on the driver before any plan."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

RAW_ONLY, CLEANED_ONLY, DUAL_CONTEXT = "raw_only", "cleaned_only", "dual_context"
TEXT_POLICIES = (RAW_ONLY, CLEANED_ONLY, DUAL_CONTEXT)


@dataclass(frozen=True)
class ChunkConfig:
    chunk_size: int = 1000
    overlap: int = 0
    split_on_newline: bool = True

    def __post_init__(self):
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        if self.overlap < 0:
            raise ValueError("overlap must be non-negative")
        if self.overlap >= self.chunk_size:
            raise ValueError("overlap must be less than chunk_size")


@dataclass(frozen=True)
class MetadataFilter:
    """Conjunction of equalities; unset fields are ignored."""

    document_id: str | None = None
    source_path: str | None = None
    source_type: str | None = None
    key_value: Mapping[str, str] = field(default_factory=dict)

    def items(self) -> list[tuple[str, str]]:
        own = [(n, getattr(self, n)) for n in ("document_id", "source_path", "source_type")]
        return [(k, v) for k, v in own if v is not None] + list(self.key_value.items())

    def is_empty(self) -> bool:
        return not self.items()

    def describe(self) -> list[str]:
        """One `key=value` per filter, fixed fields first."""
        return [f"{k}={v}" for k, v in self.items()]

    def flat(self) -> dict[str, str]:
        """One mapping; a metadata key named like a field wins."""
        return dict(self.items())


@dataclass(frozen=True)
class RetrievalRequest:
    query: str
    top_k: int = 5
    alpha: float = 0.5
    filters: MetadataFilter | None = None
    text_policy: str | None = None
    retrieval_run_id: str = ""

    def problems(self) -> list[str]:
        found = []
        if not self.query or not self.query.strip():
            found.append("query must not be empty")
        if self.top_k < 1:
            found.append("top_k must be >= 1")
        if not 0.0 <= self.alpha <= 1.0:
            found.append("alpha must be between 0.0 and 1.0")
        if self.text_policy is not None and self.text_policy not in TEXT_POLICIES:
            found.append(f"unknown text_policy: {self.text_policy}")
        return found

    def check(self) -> RetrievalRequest:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self


@dataclass(frozen=True)
class EvidenceBudget:
    """Limits on whole items; None is unlimited."""

    max_items: int | None = None
    max_raw_chars: int | None = None
    max_cleaned_chars: int | None = None
    max_context_chars: int | None = None


@dataclass(frozen=True)
class SelectionPolicy:
    order_by: str = "retrieval_rank"
    deduplicate_by: str = "document_chunk"

    def __post_init__(self):
        if self.order_by != "retrieval_rank":
            raise ValueError(f"Invalid order_by: {self.order_by}")
        if self.deduplicate_by not in ("document_chunk", "raw_text_hash"):
            raise ValueError(f"Invalid deduplicate_by: {self.deduplicate_by}")


@dataclass(frozen=True)
class ContextPolicy:
    include_raw_text: bool = True
    include_cleaned_text: bool = True


def policy_fields(policy) -> str:
    """`name=value` pairs in field order, as hashed into pack ids."""
    return "|".join(f"{f.name}={getattr(policy, f.name)}" for f in fields(policy))


@dataclass(frozen=True)
class Branding:
    """Names printed into notes and vaults; a deployment may set its own."""

    metadata_heading: str = "Provenance Metadata"
    metadata_issue: str = "missing_metadata_section"
    generator: str = "proofmill"
    vault_dir: str = "Vault"
    home_title: str = "Vault Home"
    marker: str = "<!-- generated: vault-index -->"
    manifest_name: str = "vault-manifest.json"


#: What a setting may be.
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")
PROVIDERS = ("local", "ollama", "openai")


@dataclass
class Settings:
    """Environment settings; a malformed number keeps the default and is recorded in `errors`."""

    data_dir: str = "./data"
    log_level: str = "INFO"
    model_provider: str = "local"
    embedding_model: str | None = None
    reasoning_model: str | None = None
    chunk_size: int = 1000
    chunk_overlap: int = 200
    top_k: int = 5
    hybrid_alpha: float = 0.5
    min_confidence_threshold: float = 0.7
    max_unsupported_claims: int = 0
    errors: list[str] = field(default_factory=list)

    @classmethod
    def from_env(cls, prefix: str = "PROOFMILL_", env: Mapping[str, str] | None = None) -> Settings:
        env, out = os.environ if env is None else env, cls()
        said = {"min_confidence_threshold": "MIN_CONFIDENCE"}
        for f in fields(cls):
            key = prefix + said.get(f.name, f.name.upper())
            if f.name == "errors" or key not in env:
                continue
            kind = type(getattr(out, f.name))
            try:
                setattr(out, f.name, kind(env[key]) if kind in (int, float) else env[key])
            except ValueError:
                out.errors.append(f"Invalid {'integer' if kind is int else 'float'} for {key}")
        out.log_level, out.model_provider = out.log_level.upper(), out.model_provider.lower()
        return out

    def validate(self) -> list[str]:
        share = lambda n: None if 0 <= getattr(self, n) <= 1 else f"{n} must be between 0 and 1: {getattr(self, n)}"
        least = lambda n, x, word: None if getattr(self, n) >= x else f"{n} must be {word}: {getattr(self, n)}"
        found = [
            None if self.log_level in LOG_LEVELS else f"Invalid log_level: {self.log_level}",
            None if self.model_provider in PROVIDERS else f"Invalid model_provider: {self.model_provider}",
            least("chunk_size", 1, "positive"), least("chunk_overlap", 0, "non-negative"),
            None if self.chunk_overlap < self.chunk_size else "chunk_overlap must be less than chunk_size",
            least("top_k", 1, "positive"), share("hybrid_alpha"), share("min_confidence_threshold"),
            least("max_unsupported_claims", 0, "non-negative"),
        ]
        return self.errors + [x for x in found if x]


_SETTINGS: list[Settings] = []


def get_settings() -> Settings:
    """The settings of this process, read from the environment once."""
    return _SETTINGS[0] if _SETTINGS else reload_settings()


def reload_settings() -> Settings:
    _SETTINGS[:] = [Settings.from_env()]
    return _SETTINGS[0]
