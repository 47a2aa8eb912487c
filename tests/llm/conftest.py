import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True, scope="session")
def work_folder(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("work")))


@pytest.fixture
def documents(spark):
    """Rows from texts, or from (doc_id, text, source)."""

    def make(rows):
        rows = [(i, r, "s") if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        return spark.createDataFrame(full, DDL)

    return make
