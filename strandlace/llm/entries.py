"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontamination, licenses, line_dedup, packing, quality, scoring, secrets, sharding, simhash, substring_dedup, vector_codes
from .oracles import ORACLES


def queries() -> dict:
    return {
        "op1_secret_ledger": secrets.op1,
        "op2_simhash_bktree": simhash.op2,
        "op3_line_windows": line_dedup.op3,
        "op4_brown_scores": scoring.op4,
        "op5_license_rules": licenses.op5,
        "op6_recompression": substring_dedup.op6,
        "op7_host_quality": quality.op7,
        "op8_positional_index": decontamination.op8,
        "op9_rendezvous": sharding.op9,
        "op10_best_fit": packing.op10,
        "op11_chat_bytes": chat.op11,
        "op12_vantage_codes": vector_codes.op12,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
