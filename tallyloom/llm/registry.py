"""Queries of this subpackage and their SQL, by name."""

from tallyloom.llm.chat import OP3_SQL, op3_chat_formatting
from tallyloom.llm.fingerprints import op9_lookup_sketch
from tallyloom.llm.manifest import OP13_SQL, op13_subtree_exchange
from tallyloom.llm.mixing import OP8_SQL, op8_fair_queueing
from tallyloom.llm.packing import op2_harmonic_packing
from tallyloom.llm.quality import OP10_SQL, op10_distribution_divergence
from tallyloom.llm.repeats import OP1_SQL, op1_suffix_repeats
from tallyloom.llm.runs import OP11_SQL, op11_branching_tandems
from tallyloom.llm.secrets import OP7_SQL, op7_trigram_secrets
from tallyloom.llm.simhash import op6_anchor_covering
from tallyloom.llm.substrings import OP12_SQL, op12_fm_index
from tallyloom.llm.token_files import op5_token_files
from tallyloom.llm.toxicity import op4_toxicity_lexicon

QUERIES = {
    "op1_suffix_repeats": op1_suffix_repeats,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_toxicity_lexicon": op4_toxicity_lexicon,
    "op5_token_files": op5_token_files,
    "op6_anchor_covering": op6_anchor_covering,
    "op7_trigram_secrets": op7_trigram_secrets,
    "op8_fair_queueing": op8_fair_queueing,
    "op9_lookup_sketch": op9_lookup_sketch,
    "op10_distribution_divergence": op10_distribution_divergence,
    "op11_branching_tandems": op11_branching_tandems,
    "op12_fm_index": op12_fm_index,
    "op13_subtree_exchange": op13_subtree_exchange,
}

#: The others have none: SQL engines have no XXH64 (op6, op9), tokenizers (op2, op5) or learned lexicon (op4).
ORACLE_SQL = {
    "op1_suffix_repeats": OP1_SQL,
    "op3_chat_formatting": OP3_SQL,
    "op7_trigram_secrets": OP7_SQL,
    "op8_fair_queueing": OP8_SQL,
    "op10_distribution_divergence": OP10_SQL,
    "op11_branching_tandems": OP11_SQL,
    "op12_fm_index": OP12_SQL,
    "op13_subtree_exchange": OP13_SQL,
}
