"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, decontaminate, fingerprint, lexical, linededup, minhash, periodic, pii, quality, rollup, simhash, tokenfile, toxicity

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_pii": pii.op3_pii,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_quality": quality.op6_quality,
    "op7_simhash": simhash.op7_simhash,
    "op8_token_file": tokenfile.op8_token_file,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_token_counts": rollup.op10_token_counts,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_minhash": minhash.op12_minhash,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

#: The others need tokenisers, fitted models or hashes that SQL doesn't have; tests hold them against brute force.
ORACLE_SQL = {
    "op2_decontamination": decontaminate.ORACLE_SQL,
    "op9_line_dedup": linededup.ORACLE_SQL,
    "op11_lexical_search": lexical.ORACLE_SQL,
    "op12_minhash": minhash.ORACLE_SQL,
}
