"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from . import ann, decontamination, license_scan, line_dedup, quality, sentencepiece_fst, sharding, simhash, toxicity, warc_fixity

MODULES = (decontamination, toxicity, license_scan, warc_fixity, simhash, sharding, ann, line_dedup, sentencepiece_fst, quality)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
