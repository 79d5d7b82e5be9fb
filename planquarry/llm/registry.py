"""The queries of this subpackage and their SQL."""

from . import bpe, chat, fingerprints, licenses, ngram_join, packing, quality, repeats, sharding, vectors

_MODULES = (ngram_join, packing, vectors, licenses, quality, bpe, sharding, fingerprints, chat, repeats)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
