"""The named queries of this subpackage and the SQL of those that SQL can express."""

from adloom.llm import archives, chat, decontaminate, html, negatives, packing, phrases, pii, quality, secrets, sharding, simhash, tokencount

_MODULES = [tokencount, quality, simhash, pii, decontaminate, secrets, chat, archives, packing, html, sharding, negatives, phrases]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
