import pytest

from llm_texts import prose

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use for columns of their own
    "`row` int, part int, score double, kept string, features string, text_hash int, n_words string"
)


@pytest.fixture(scope="session")
def make(spark):
    """Documents with clashing extra columns from ``(doc_id, text[, lang])``."""

    def made(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, 1, 2, 0.5, "x", "y", 3, None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return made


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = prose(1, 60_000)
    return make(
        [
            (1, None),
            (2, ""),
            (3, " \t\n\x0b "),
            (4, "one"),
            (5, "You are. It is nice; it is the one.", None),
            (5, "You are. It is nice; it is the one.", None),
            (6, prose(2, 90)),
            (6, prose(3, 90)),
            (None, prose(2, 90)),
            (None, None, None),
            (7, long),
            (8, long + " tail"),
            (9, "x" * 300_000),
            (10, "123 --- !!!"),
            (11, "日本語 の 文 — ok fine"),
        ]
    )
