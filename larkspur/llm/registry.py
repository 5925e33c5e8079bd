"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import decontaminate, dedup, htmltext, jaccard, langid, licenses, lmscore, mixing, neighbours, quality, sharding, spelling, vector_codes
from .common import with_package

_MODULES = (dedup, htmltext, quality, langid, lmscore, sharding, jaccard, decontaminate, mixing, licenses, neighbours, vector_codes, spelling)
QUERIES = {name: with_package(query) for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
