"""Sources (text lines, the given parquet tables) and sinks."""

from seedgrow.sources.sinks import write_results, write_roc, write_table
from seedgrow.sources.tables import (
    binary_embedding_samples,
    document_samples,
    embedding_samples,
    letter_frequencies,
    part_lines,
    quality_samples,
    read_table,
)
from seedgrow.sources.text import good_lines, parse_labeled_lines, read_labeled_text, rejected_lines

__all__ = [
    "write_results",
    "write_roc",
    "write_table",
    "binary_embedding_samples",
    "document_samples",
    "embedding_samples",
    "letter_frequencies",
    "part_lines",
    "quality_samples",
    "read_table",
    "good_lines",
    "parse_labeled_lines",
    "read_labeled_text",
    "rejected_lines",
]
