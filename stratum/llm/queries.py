"""The text operators' registered queries and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from stratum.llm.bpe import op6_bpe_codec
from stratum.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from stratum.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from stratum.llm.fill_middle import OP13_SQL, op13_fill_middle
from stratum.llm.html_wrappers import op8_html_wrappers
from stratum.llm.licenses import OP10_SQL, op10_license_templates
from stratum.llm.mixing import op7_source_mix
from stratum.llm.ngram_join import OP4_SQL, op4_ngram_jaccard
from stratum.llm.pii import op2_pii_pseudonyms
from stratum.llm.quality import OP5_SQL, op5_quality_ledger
from stratum.llm.secrets import op9_secret_links
from stratum.llm.substring_dedup import OP12_SQL, op12_substring_dedup
from stratum.llm.url_rules import op3_url_rules

QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_pii_pseudonyms, op3_url_rules, op4_ngram_jaccard, op5_quality_ledger, op6_bpe_codec,
    op7_source_mix, op8_html_wrappers, op9_secret_links, op10_license_templates,
    op11_conversation_repair, op12_substring_dedup, op13_fill_middle)}
ORACLE = {"op1_exact_dedup": OP1_SQL, "op4_ngram_jaccard": OP4_SQL, "op5_quality_ledger": OP5_SQL,
          "op10_license_templates": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_fill_middle": OP13_SQL}
