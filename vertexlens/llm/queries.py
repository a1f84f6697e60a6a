"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from vertexlens.llm.chat import OP5_SQL, op5_chat_formatting
from vertexlens.llm.decontam import OP8_SQL, op8_decontamination
from vertexlens.llm.langid import op7_language_id
from vertexlens.llm.neardup import OP4_SQL, op4_near_duplicates
from vertexlens.llm.packing import op1_best_fit_packing
from vertexlens.llm.phrases import OP12_SQL, op12_collocations
from vertexlens.llm.quality import op2_quality_classifier
from vertexlens.llm.repeats import OP10_SQL, op10_repeated_passages
from vertexlens.llm.resample import OP13_SQL, op13_importance_resampling
from vertexlens.llm.rules import OP3_SQL, op3_quality_rules
from vertexlens.llm.tokens import op6_token_counts
from vertexlens.llm.toxicity import op9_toxicity
from vertexlens.llm.urls import OP11_SQL, op11_url_filters

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_url_filters": op11_url_filters,
    "op12_collocations": op12_collocations,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL = {"op3_quality_rules": OP3_SQL, "op4_near_duplicates": OP4_SQL, "op5_chat_formatting": OP5_SQL, "op8_decontamination": OP8_SQL, "op10_repeated_passages": OP10_SQL, "op11_url_filters": OP11_SQL, "op12_collocations": OP12_SQL, "op13_importance_resampling": OP13_SQL}
