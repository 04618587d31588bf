"""The corpus queries and their oracle SQL."""

from __future__ import annotations

from . import bmw, decontaminate, html, langid, minhash, packing, pfp, repair, suffixtree, toxicity


def queries() -> dict:
    return {
        "op1_html": html.op1_html,
        "op2_minhash": minhash.op2_minhash,
        "op3_packing": packing.op3_packing,
        "op4_substring": suffixtree.op4_substring,
        "op5_bmw": bmw.op5_bmw,
        "op6_langid": langid.op6_langid,
        "op7_repair": repair.op7_repair,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_pfp": pfp.op9_pfp,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict:
    return {"op2_minhash": minhash.ORACLE, "op4_substring": suffixtree.ORACLE, "op5_bmw": bmw.ORACLE}
