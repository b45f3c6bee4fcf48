"""Default parameters of the operators, gathered in one frozen dataclass."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # Defaults that must equal the reference's behaviour.
    fixed_chunk_size: int = 1000
    fixed_overlap: int = 100
    sentence_max_chunk: int = 1000
    semantic_threshold: float = 0.8
    word_chunk_size: int = 1000
    recursive_chunk_size: int = 1000
    recursive_overlap: int = 200
    top_k_loader: int = 5
    top_k_app: int = 3
    overfetch_factor: int = 5
    min_line_length: int = 5
    min_entity_length: int = 3
    entity_labels: tuple = ("B-LOC",)
    debug_sample: int = 10
    default_chunking: str = "sentence"
    supported_upload_extensions: tuple = (".pptx", ".docx", ".pdf")
    convertible_extensions: tuple = (".pptx", ".docx", ".pdf", ".jpg", ".jpeg", ".png")
    collection_name: str = "research_papers"

    # Our own choices (not in the reference).
    embed_dim: int = 64
    distance_decimals: int = 6
    # Largest query matrix (bytes) shipped to every task for exact kNN; larger query
    # sets are processed in blocks of this size.
    max_broadcast_query_bytes: int = 64 * 1024 * 1024
    # Largest per-partition top-k state (k rows per query) of one query block.
    max_topk_state_rows: int = 200_000
    lsh_tables: int = 4
    # Width of a bucket, in median nearest-neighbour distances of a bounded sample of rows.
    lsh_widths: float = 2.0
    lsh_sample: int = 500
    lsh_seed: int = 17
    models: tuple = field(default=("rag", "enhanced", "gpt", "claude"))


DEFAULTS = Config()
