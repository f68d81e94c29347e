"""Settings of the engine; a changed copy is made with dataclasses.replace."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_strategy: str = "fixed"  # or "semantic"
    chunk_size: int = 512
    chunk_overlap: int = 64
    semantic_threshold: float = 0.5
    top_k_vector: int = 20
    top_k_keyword: int = 20
    top_k_final: int = 5
    rrf_k: int = 60
    mode: str = "hybrid"  # or "vector"
    reranker: str = "none"  # "local" (cross-encoder), "hosted" or "llm"
    reranker_model: str = ""
    reranker_url: str = ""  # of the hosted one
    reranker_key_name: str = ""  # environment variable of the workers that holds its key
    relevance_floor: float | None = None
    router_strategy: str = "heuristic"
    hard_threshold: float = 0.7
    local_model: str = "local-small"
    api_model: str = "api-medium"
    api_available: bool = True
    sql_enabled: bool = True
    sql_max_rows: int = 50
    sql_timeout_s: float = 5.0
    sql_scan_budget_bytes: int = 0  # 0: no budget
    schema_top_k: int = 8
    graph_enabled: bool = True

    def __post_init__(self) -> None:
        for name, known in (("chunk_strategy", ("fixed", "semantic")), ("mode", ("hybrid", "vector")), ("router_strategy", ("heuristic",)), ("reranker", ("none", "local", "hosted", "llm"))):
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}; known: {', '.join(known)}")

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        """Settings from a mapping; unknown keys are errors."""
        names = {f.name for f in fields(cls)}
        if unknown := set(values) - names:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)
