import re

import pytest

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
#: Nulls in any column, empty and very long texts, ties and repeated rows.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 30, "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog " * 30, "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog " * 30, "en", "a", 1),
    (3, "", "en", None, 0),
    (4, None, None, "b", None),
    (5, " \n\t ", "en", "b", 4),
    (6, LONG, "en", "c", 1),
    (7, LONG + " end", "en", "c", 1),
    (None, "no id here " * 20, "de", "c", 1),
    (None, None, None, None, None),
    (9, "日本語の文 ＡＢ 😀\x00é́", "ja", "d", 1),
    (9, "a second text of one id", "en", "d", 1),
    (10, "w", "en", "d", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with the operators' own names.
CLASHING = ("fingerprint", "score", "component_id", "block", "slot", "n_words", "spans", "text_hash", "_hash", "_id", "_text", "row", "hash", "key", "print", "n_tokens", "_found")


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, *["x"] * len(CLASHING)) for r in ROWS]
    return spark.createDataFrame(rows, COLUMNS + "".join(f", `{c}` string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folder(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(path / f"{name}.parquet"))
    return str(path)
