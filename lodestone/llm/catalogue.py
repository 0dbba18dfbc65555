"""Every query of this subpackage with its SQL, where SQL can express it."""

from lodestone.llm import components, encoding, leakage, mixing, origin, parsecheck, topn

MODULES = [parsecheck, topn, components, origin, leakage, mixing, encoding]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
