import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, fp long, root string, kept string, label string, row string, h1 long, score double, of_source string, epochs long, `end` string, n long, copy long, `a b:c` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and long texts, copies, repeated rows, and columns of clashing names."""
    long_text = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "The MIT License applies. " * 3, "en", "a"),
        (1, "The MIT License applies. " * 3, "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (None, "one two three four five six seven eight nine ten " * 4, "en", "b"),
        (None, None, None, None),
        (4, "one two three four five six seven eight nine ten " * 4, "xx-odd", "b"),
        (5, long_text, "en", "b"),
        (6, long_text + " end", "de", "c"),
        (7, " \t\n\x0b\x0c\r ", "fr", "c"),
        (8, "line\nline\n\nline\n#$|<> a", "fr", ""),
        (9, "Ünïcödé K İ 日本 \x1f\x85\xa0 ' x", "es", "é"),
        (10, "  double  spaces   and \n\n lines \n ", "es", "é"),
    ]
    rows += [(100 + i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(60)), "en", "hot") for i in range(30)]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", 2, "r", "no", "x", "w", i, 0.5, "o", 3, "e", 4, 5, "y") for i, r in enumerate(rows)], DOCS)


@pytest.fixture(scope="session")
def labels(spark, odd):
    return spark.createDataFrame([(100 + i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (1, None, None), (4, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
