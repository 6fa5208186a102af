"""Queries of the training-data operators, by name."""

from __future__ import annotations

from quillframe.llm import ann, langid, media, minhash, mixing, packing, quality, toxicity, urlfilter, warc


def queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_language_id": langid.query,
        "op3_packing": packing.query,
        "op4_mixing": mixing.query,
        "op5_ann": ann.query,
        "op6_toxicity": toxicity.query,
        "op7_minhash": minhash.query,
        "op8_media": media.query,
        "op9_url_filter": urlfilter.query,
        "op10_quality": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.ORACLE_SQL,
        "op4_mixing": mixing.ORACLE_SQL,
        "op7_minhash": minhash.ORACLE_SQL,
        "op9_url_filter": urlfilter.ORACLE_SQL,
    }
