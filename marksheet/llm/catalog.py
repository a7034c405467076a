"""Registered queries of the training-data operators, with DuckDB text where SQL expresses them."""

from marksheet.llm.decontamination import op6_decontamination
from marksheet.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from marksheet.llm.language_model import op2_language_model
from marksheet.llm.lexical_search import OP11_SQL, op11_lexical_search
from marksheet.llm.license_scan import OP9_SQL, op9_license_scan
from marksheet.llm.minhash_duplicates import OP12_SQL, op12_minhash_duplicates
from marksheet.llm.mixing import op10_mixing
from marksheet.llm.near_duplicates import op3_near_duplicates
from marksheet.llm.pii_surrogates import op5_pii_surrogates
from marksheet.llm.quality_rules import op8_quality_rules
from marksheet.llm.secret_scan import op4_secret_scan
from marksheet.llm.sharding import op1_sharding
from marksheet.llm.substring_dedup import OP7_SQL, op7_substring_dedup

QUERIES = {f.__name__: f for f in (op1_sharding, op2_language_model, op3_near_duplicates, op4_secret_scan, op5_pii_surrogates, op6_decontamination,
                                   op7_substring_dedup, op8_quality_rules, op9_license_scan, op10_mixing, op11_lexical_search,
                                   op12_minhash_duplicates, op13_hard_negatives)}
ORACLE = {"op7_substring_dedup": OP7_SQL, "op9_license_scan": OP9_SQL, "op11_lexical_search": OP11_SQL,
          "op12_minhash_duplicates": OP12_SQL, "op13_hard_negatives": OP13_SQL}
