"""The queries opN_<name> and, where SQL can express them, their SQL."""

from . import bpe, fingerprint, minhash, packing, pii, quality, suffix, toxicity, unigram, warc

MODULES = (minhash, pii, fingerprint, suffix, warc, toxicity, packing, bpe, quality, unigram)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
