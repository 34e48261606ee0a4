"""Small tables with awkward columns, and brute-force versions."""

import random
import zlib

#: Extra columns whose names the operators use inside.
EXTRA = ", id string, n long, key string, pos int, block string, words array<string>, start long, bucket long, component long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "x", 7, "k", 1, "b", ["w"], 2, 3, None) for r in rows], "doc_id long, text string, lang string" + EXTRA)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"{'abcdefghij'[rng.randrange(10)]}w{rng.randrange(vocabulary)}" for _ in range(n))


def words(text):
    return (text or "").encode().lower().split()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
