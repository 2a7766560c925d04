import pytest


def documents(spark, texts, ids=None):
    """Rows with columns whose names operators use themselves."""
    rows = [(ids[k] if ids else k, t, "en", "s", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp int, score int")


@pytest.fixture
def docs(spark):
    return lambda texts, ids=None: documents(spark, texts, ids)


#: Null, empty, white space only, very long, ties and repeated rows; the last two rows share an id and a null.
ODD = [None, "", " \n\t ", "word " * 40_000, "same text here", "same text here", "é x 漢字 ́a <|endoftext|> don't, STOP.", "\x1c\x85 a"]
ODD_IDS = [1, 2, 3, 4, 5, 5, None, None]
