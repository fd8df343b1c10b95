"""Small tables and brute-force counterparts for the text operators."""

from __future__ import annotations

import os

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def documents(spark, rows):
    """Rows (doc_id, text[, lang]) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def components(nodes, linked):
    """Smallest reachable node of every node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}
