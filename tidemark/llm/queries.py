"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from tidemark.llm import quality_rules
from tidemark.llm.bpe import op7_bpe
from tidemark.llm.embeddings import op9_embeddings
from tidemark.llm.html_text import op1_html_text
from tidemark.llm.language_model import op5_language_model
from tidemark.llm.packing import op6_packing
from tidemark.llm.quality_rules import op4_quality_rules
from tidemark.llm.sharding import op8_sharding
from tidemark.llm.simhash import op2_simhash
from tidemark.llm.token_counts import op3_token_counts
from tidemark.llm.weak_label import op10_weak_label

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_text, op2_simhash, op3_token_counts, op4_quality_rules, op5_language_model,
        op6_packing, op7_bpe, op8_sharding, op9_embeddings, op10_weak_label,
    )
}
ORACLE_SQL = {"op4_quality_rules": quality_rules.ORACLE_SQL}
