"""Engine configuration: frozen dataclasses with the defaults of every knob that a plan reads."""

from __future__ import annotations

from dataclasses import dataclass

from .functions.tokenizer import TokenizerConfig


@dataclass(frozen=True)
class FusionConfig:
    method: str = "rrf"
    rrf_k: int = 60
    vector_weight: float = 0.4
    sparse_weight: float = 0.3
    graph_weight: float = 0.3
    normalize_scores: bool = True

    def weights(self) -> dict[str, float]:
        """Weights of the legs summing to one; the defaults where none is positive."""
        given = {"vector": self.vector_weight, "sparse": self.sparse_weight, "graph": self.graph_weight}
        total = sum(given.values())
        if total <= 0:
            return {"vector": 0.4, "sparse": 0.3, "graph": 0.3}
        return given if 0.99 <= total <= 1.01 else {k: v / total for k, v in given.items()}


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 50
    final_k: int = 10
    similarity_threshold: float = 0.0
    min_score_sparse: float = 0.0
    min_score_graph: float = 0.0
    #: What shaping keeps one hit of: chunk_id or file_path.
    dedup_by: str = "chunk_id"
    enable_mmr: bool = False
    relax_max_terms: int = 8
    file_path_max_terms: int = 6
    max_chunks_per_file: int = 3
    neighbor_window: int = 1
    mmr_lambda: float = 0.7
    rerank_top_n: int = 50
    rerank_alpha: float = 0.7
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


@dataclass(frozen=True)
class GraphConfig:
    max_hops: int = 2
    top_k: int = 30
    #: Seeds are drawn from so many times ``top_k`` hits of an index that corpora share.
    overfetch: int = 10
    neighbor_window: int = 1
    expansion_weight: float = 0.8
    concepts_per_chunk: int = 8
    min_concept_length: int = 4
    relations_per_chunk: int = 12
    #: Chunks of a corpus from which concepts are drawn.
    chunk_budget: int = 200
    heuristic_weight: float = 0.5


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 1000
    overlap: int = 200
    target_tokens: int = 512
    overlap_tokens: int = 64
    min_chars: int = 50
    max_tokens: int = 8000
    heading_level: int = 4
    max_depth: int = 10
    ast_overlap_lines: int = 20
    preserve_imports: bool = True
    #: What becomes of a separator between two pieces: none, prefix of the next or suffix of the one before.
    separator_keep: str = "suffix"
    tokenizer: TokenizerConfig = TokenizerConfig()

    def __post_init__(self) -> None:
        if self.overlap >= self.size or self.overlap_tokens >= self.target_tokens:
            raise ValueError("an overlap must be smaller than what it overlaps")
        if self.separator_keep not in ("none", "prefix", "suffix"):
            raise ValueError(f"no such way to keep separators: {self.separator_keep}")


@dataclass(frozen=True)
class RecallConfig:
    #: Off: every message searches with the default intensity.
    enabled: bool = True
    default_intensity: str = "standard"
    skip_max_tokens: int = 4
    light_top_k: int = 3
    standard_top_k: int = 5
    deep_top_k: int = 10
    standard_recency: float = 0.3
    deep_recency: float = 0.5


@dataclass(frozen=True)
class EvalConfig:
    final_k: int = 5
    recall_ks: tuple[int, ...] = (5, 10, 20)
    precision_k: int = 5
    ndcg_k: int = 10
