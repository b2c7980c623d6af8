"""The registered queries of the training-data operators, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm.decontamination import op2_decontamination
from docweave.llm.language_id import op9_language_id
from docweave.llm.line_quality import op11_line_quality
from docweave.llm.masked_lm import op8_masked_lm
from docweave.llm.near_dedup import op1_near_dedup
from docweave.llm.piece_codec import op6_sentencepiece
from docweave.llm.pii import op5_pii
from docweave.llm.ranked_search import OP13_SQL, op13_ranked_search
from docweave.llm.sharding import op3_sharding
from docweave.llm.token_files import op10_token_files
from docweave.llm.toxicity import op4_toxicity
from docweave.llm.vector_search import op7_nearest_neighbours
from docweave.llm.whitening import op12_whitening


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_masked_lm": op8_masked_lm,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
    "op11_line_quality": op11_line_quality,
    "op12_whitening": op12_whitening,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": pipeline,
}

# Queries without SQL are tested against brute force, exact round trips or held-out accuracy in tests/llm.
SQL: dict[str, str] = {"op13_ranked_search": OP13_SQL}
