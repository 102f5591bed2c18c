import pytest


@pytest.fixture(scope="session", autouse=True)
def _released(spark):
    """Staged tables of the operators go when the tests are over."""
    yield
    from driftspark.llm import shared

    shared.release(spark)


@pytest.fixture
def table(spark):
    """Rows and a DDL schema to a frame of several partitions."""
    return lambda rows, schema, parts=3: spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)


@pytest.fixture
def batch_sizes(spark, monkeypatch):
    """The bound of an Arrow batch under which each staged table was written, by its name."""
    from driftspark.llm import shared

    seen, real = {}, shared.staged

    def staged(df, name):
        seen[name] = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB"))
        return real(df, name)

    monkeypatch.setattr(shared, "staged", staged)
    return seen


@pytest.fixture
def peak_bytes():
    """Most bytes that reading an iterator to its end allocated."""
    import tracemalloc

    def peak(rows):
        tracemalloc.start()
        try:
            for _ in rows:
                pass
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    return peak
