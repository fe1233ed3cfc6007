"""Documents with everything that real tables hold and samples lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The columns of documents, and others with names the operators use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row long, cut string, kept boolean, measures string, class string, token string, n long, spans string, hashed int, _row int"
)
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees near a river bank"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """From (doc_id, text) or (doc_id, text, source); the clashing columns hold nulls and zeros."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), None, "", None, None, "", None, 0, "", 0, 0) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    return [
        (1, PROSE, "a"),
        (1, PROSE, "a"),
        (2, PROSE, "b"),
        (3, None, "a"),
        (4, "", None),
        (5, " \n\t ", "b"),
        (None, PROSE + " once more", None),
        (None, None, None),
        (6, "word", "c"),
        (7, " ".join(f"w{i * i % 977}" for i in range(40_000)), "c"),
        (8, "x" * 100_000, "c"),
        (9, "Ünï😀cödé   text with odd\x0b\x0cspace\x1cand 中文字 " * 3, "d"),
    ]
