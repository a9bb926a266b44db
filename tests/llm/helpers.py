"""Small tables with every awkward case, and brute force."""

import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=()):
    """rows: (doc_id, text[, lang]); extra: names of columns that may clash with what operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) + tuple("x" for _ in extra) for r in rows]
    return spark.createDataFrame(full, DOCS + "".join(f", `{c}` string" for c in extra))


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def rows(df):
    return [tuple(r) for r in df.collect()]
