import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    def build(rows):
        full = [(*row, *("en", "a")[len(row) - 2:]) if len(row) < 4 else row for row in rows]
        return spark.createDataFrame(
            [(*row, None if row[1] is None else len(row[1])) for row in full], DOCS
        )
    return build


@pytest.fixture
def by_id():
    """Collected rows as dictionaries by their first column; one row for each."""
    def collect(df, key=None):
        rows = [row.asDict() for row in df.collect()]
        key = key or df.columns[0]
        out = {row[key]: row for row in rows}
        assert len(out) == len(rows)
        return out
    return collect
