import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, path string, h int, copies string"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (id, text[, source]); the further columns have names that operators use inside."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1]) if r[1] is not None else None, 7, "p", 1, "c") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables of one folder for queries: name to DataFrame."""

    def make(**frames):
        at = str(tmp_path_factory.mktemp("tables"))
        for name, frame in frames.items():
            frame.write.parquet(f"{at}/{name}.parquet")
        return at

    return make
