"""Registry of named queries: a Spark callable and, where one exists, the DuckDB text of the same result."""
import re

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle is not None:
            # `by` (a voxel row) is a reserved word there; keywords are written in capitals
            ORACLES[name] = re.sub(r'(?<!["\w])by(?!["\w])', '"by"', oracle)
        return fn
    return deco
