import pytest

from plumbline.llm.queries import prepare

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A table like ``documents`` from texts or ``(doc_id, text[, lang[, source]])``, with further
    columns whose names clash with what operators add."""
    prepare(spark)

    def make(*rows, partitions=3):
        filled = []
        for at, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (at, row)
            doc_id, text, lang, source = (*row, *(None,) * (4 - len(row)))
            filled.append((doc_id, text, lang, source, len(text or ""), "x", 7, "y", "z"))
        clashing = ", size string, row long, digest string, n_tokens string"
        return spark.createDataFrame(filled, COLUMNS + clashing).repartition(partitions)

    return make
