"""The queries of this subpackage by name, and their SQL."""

from importlib import import_module

_MODULES = {
    "op1_warc": "warc",
    "op2_suffix_dedup": "bwt",
    "op3_line_dedup": "linededup",
    "op4_toxicity": "toxicity",
    "op5_pii": "pii",
    "op6_quality": "quality",
    "op7_minhash": "minhash",
    "op8_decontamination": "decontaminate",
    "op9_embeddings": "itq",
    "op10_bpe": "bpe",
}

QUERIES = {name: import_module(f"tessera.llm.{module}").query for name, module in _MODULES.items()}
ORACLES = {name: sql for name, module in _MODULES.items() if (sql := import_module(f"tessera.llm.{module}").ORACLE)}
