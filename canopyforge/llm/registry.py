"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import decontaminate, langid, linededup, pages, pieces, secretscan, simhash, tokenfiles, topk, toxicity
from .common import Query

_MODULES = {
    "op1_decontaminate": decontaminate,
    "op2_langid": langid,
    "op3_tokenfiles": tokenfiles,
    "op4_linededup": linededup,
    "op5_topk": topk,
    "op6_pages": pages,
    "op7_simhash": simhash,
    "op8_pieces": pieces,
    "op9_toxicity": toxicity,
    "op10_secretscan": secretscan,
}


def queries() -> dict[str, Query]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
