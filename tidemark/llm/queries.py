"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op9_bpe
from .decontaminate import OP13_SQL, op13_decontaminate
from .fim import OP12_SQL, op12_fim
from .flac import op7_flac
from .hnsw import op10_hnsw
from .minhash import op1_minhash
from .mixing import OP3_SQL, op3_mixing
from .pii import op6_pii
from .suffix_dedup import op8_suffix_array
from .toxicity import op5_toxicity
from .url_filter import OP4_SQL, op4_url_filter
from .warc import OP2_SQL, op2_warc
from .whitening import op11_whitening

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_flac": op7_flac,
    "op8_suffix_array": op8_suffix_array,
    "op9_bpe": op9_bpe,
    "op10_hnsw": op10_hnsw,
    "op11_whitening": op11_whitening,
    "op12_fim": op12_fim,
    "op13_decontaminate": op13_decontaminate,
}

ORACLE_SQL = {
    "op2_warc": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op4_url_filter": OP4_SQL,
    "op12_fim": OP12_SQL,
    "op13_decontaminate": OP13_SQL,
}
