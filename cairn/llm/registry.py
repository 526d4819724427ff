"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fingerprint, langid, lmscore, neardup, packing, pieces, pii, quality, tokencount, urlfilter

MODULES = (lmscore, tokencount, packing, urlfilter, neardup, quality, pii, pieces, langid, fingerprint)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name[:2] == "op" and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
