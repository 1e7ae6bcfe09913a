"""The queries of this subpackage, one for each operator, and the SQL of those that have one."""

from __future__ import annotations

from . import ann, bpe, licenses, minhash, packing, quality, sharding, suffixes, toxicity, warc

QUERIES = {
    "op1_license_digests": licenses.query,
    "op2_suffix_merge": suffixes.query,
    "op3_hashed_ngram_ratio": quality.query,
    "op4_automaton_bpe": bpe.query,
    "op5_hyperminhash": minhash.query,
    "op6_zstd_distance": toxicity.query,
    "op7_histogram_packing": packing.query,
    "op8_slot_shards": sharding.query,
    "op9_transactions": warc.query,
    "op10_multi_index_hashing": ann.query,
}
ORACLES: dict[str, str] = {
    "op1_license_digests": licenses.SQL,
}
