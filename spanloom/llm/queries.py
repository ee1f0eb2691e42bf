"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from .embedding_dedup import ORACLE as EMBEDDING_SQL, op3_embedding_dedup
from .hamming_topk import ORACLE as TOPK_SQL, op10_topk
from .html_text import op4_html_text
from .langid import op5_langid
from .mixing import op6_mixing
from .ngram_lm import op9_lm_score
from .packing import op2_packing
from .pii import op7_pii
from .simhash import op1_simhash
from .token_matrix import op8_token_matrix


def pipeline(spark, sf_dir):
    """Every stage of the corpus pipeline, which stands at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline} | {f.__name__: f for f in (op1_simhash, op2_packing, op3_embedding_dedup, op4_html_text, op5_langid, op6_mixing, op7_pii, op8_token_matrix, op9_lm_score, op10_topk)}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": EMBEDDING_SQL, "op10_topk": TOPK_SQL}
