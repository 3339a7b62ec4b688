"""Presets of the retrieval pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PipelineConfig:
    """Rows kept by each stage, and the weights of scores. ``sort_by`` names the score of the last ranking."""

    pool: int = 80
    dense: int = 60
    neural: int = 40
    final: int = 20
    lexical_mix: tuple[float, ...] = (0.7, 0.3)
    dense_mix: tuple[float, ...] = (0.3, 0.7)
    neural_mix: tuple[float, ...] = (0.2, 0.2, 0.6)
    context: float = 0.2
    sentence: float = 0.2
    heading: float = 0.0
    keyword: float = 0.0
    dedupe: float = 0.9
    sort_by: str = "ultimate"
    #: how the pool is ranked: by scaled scores, or by reciprocal ranks of lists (of subqueries too, or of the nearest)
    fuse: str = "scores"
    main: float = 0.0  # weight of the similarity to the main query where lists are fused


# The presets in use.
PRESETS = {
    "canonical": PipelineConfig(),
    "exhaustive": PipelineConfig(300, 200, 100, 60, sentence=0.5),
    "exhaustive_v2": PipelineConfig(250, 150, 75, 60),
    "small": PipelineConfig(30, 20, 10, 5, sentence=0.5),
    "nr": PipelineConfig(300, 150, 100, 50, neural_mix=(0.2, 0.3, 0.5), context=1.0, sentence=1.0),
    "llm_rerank": PipelineConfig(250, 150, 100, 70, neural_mix=(0.0, 0.2, 0.7)),
    "heading": PipelineConfig(300, 200, 0, 35, context=1.0, heading=0.4, sentence=1.0),
    "heading_keyword": PipelineConfig(350, 150, 0, 40, (0.4, 0.3, 0.3), (0.2, 0.6, 0.2), context=1.0, heading=0.3, keyword=0.4, sentence=1.0),
    "keyword": PipelineConfig(300, 150, 0, 50, context=1.0, heading=0.3, sentence=1.0, sort_by="semantic"),
    "sparse_first": PipelineConfig(100, 60, 0, 30, context=1.0, sentence=1.0, sort_by="sentence_similarity"),
    "rrf": PipelineConfig(80, 60, 0, 20, fuse="lists", context=0.0),
    "multi_query": PipelineConfig(80, 50, 0, 30, fuse="subqueries", main=1.0, context=0.0),
    "dense_first": PipelineConfig(80, 80, 0, 30, fuse="nearest", main=0.5, context=0.0),
    "mixture": PipelineConfig(50, 150, 0, 60, neural_mix=(0.3, 0.0, 0.7), sentence=0.3, dedupe=0.85),
}
