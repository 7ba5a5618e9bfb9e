"""The queries of these operators by name, and SQL twins where SQL can express them."""
from __future__ import annotations

from .ann import op5_neighbours
from .language import op1_language
from .mixing import mixing_sql, op4_mixing
from .near import SQL as NEAR_SQL, op8_near_duplicates
from .packing import op3_packing
from .passages import op6_passages
from .ppm import op9_lm_score
from .quality import op2_quality
from .secrets import op7_secrets
from .skyband import SQL as SKYBAND_SQL, op11_source_divergence
from .suffixes import op13_repeated_strings
from .tokens import op10_token_counts
from .trie import SQL as TRIE_SQL, op12_prefix_trie

QUERIES = {f.__name__: f for f in (op1_language, op2_quality, op3_packing, op4_mixing, op5_neighbours, op6_passages, op7_secrets, op8_near_duplicates, op9_lm_score, op10_token_counts,
                                   op11_source_divergence, op12_prefix_trie, op13_repeated_strings)}
ORACLE: dict[str, str] = {"op4_mixing": mixing_sql(1.5), "op8_near_duplicates": NEAR_SQL, "op11_source_divergence": SKYBAND_SQL, "op12_prefix_trie": TRIE_SQL}
