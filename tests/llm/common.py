"""Small tables with the awkward cases that every operator must take."""

import hashlib
import zlib

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 3000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog while seven wise owls watch it from the old barn roof"),
    (2, "The quick brown fox jumps over the lazy dog while seven wise owls watch it from the old barn roof"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, "one two"),
    (8, "Über die Brücke, naïve café — 日本語 テスト \x00 end"),
    (None, "an orphan text without an id but with several words in it"),
    (9, "one two"),
]


def docs(spark, rows=None, columns="doc_id long, text string"):
    """Documents with columns that clash with the names operators give."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(TEXTS if rows is None else rows, columns)
    clash = ("n_words", "spans", "kept", "score", "contamination", "k", "t", "id", "c0", "_key", "base_spans", "lang_pred", "p_top", "class_id", "start", "host", "rule")
    return frame.withColumns({c: F.lit(f"own {c}") for c in clash})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
