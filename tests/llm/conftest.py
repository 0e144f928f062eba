import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = {"n": 1, "key": "k", "size": 2, "kept": True, "component_id": 9, "part": "p", "spans": "s", "cell": 4, "_noise": 0.5, "target": "t", "taken": 1, "edits": "e", "score": 1.0, "digest": "d", "shard": 3}


@pytest.fixture
def docs(spark):
    from pyspark.sql import functions as F

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
        for k, v in CLASH.items() if clash else ():
            df = df.withColumn(k, F.lit(v))
        return df

    return make


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples of the named columns."""

    def of(df, *cols):
        return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=lambda t: tuple((x is None, x) for x in t))

    return of
