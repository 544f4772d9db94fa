"""The registered queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from . import dsir, exact, langid, lmscore, minhash, mixing, packing, quality, suffix, toxicity

_MODULES = [packing, mixing, suffix, quality, minhash, dsir, langid, toxicity, exact, lmscore]

QUERIES = {m.QUERY: m.query for m in _MODULES}
ORACLES = {m.QUERY: m.ORACLE for m in _MODULES if hasattr(m, "ORACLE")}
