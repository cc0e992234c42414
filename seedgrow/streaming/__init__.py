"""Streaming.

The original tool is batch only: it reads a text file, trains, evaluates
and writes result files; it has no streaming source, sink or stateful
operator, so this package adds none. Training is inherently batch (a loop
of fits over a fixed pool). A fitted ``SemiSupervisedModel`` is an
ordinary Spark ``Model`` whose ``transform`` is a per-row projection, so it
applies unchanged to a streaming DataFrame; ``score_stream`` is that call
with the confidence column the batch operators use
(``tests/test_streaming.py`` runs it on a stream of ``embeddings``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from seedgrow.functions.vectors import max_probability


def score_stream(model, stream: DataFrame, confidence_col: str = "confidence") -> DataFrame:
    """``model.transform`` on a streaming DataFrame plus the top-class
    probability: stateless, so no watermark or state store is involved."""
    out = model.transform(stream)
    return out.withColumn(confidence_col, max_probability(model.getProbabilityCol()))


__all__ = ["score_stream"]
