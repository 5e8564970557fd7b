"""Rules the source itself must keep."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "tidewatch"
FORBIDDEN = (
    r'mode\("overwrite"\)', r"localCheckpoint", r"\.fillna\(", r"\.na\.fill\(", r"crossJoin", r"toPandas\(",
    r"current_timestamp\(", r"@F\.udf", r"\btempfile\b", r"\.limit\(\d",
)


def test_no_forbidden_calls():
    for path in ROOT.rglob("*.py"):
        body = path.read_text()
        for pattern in FORBIDDEN:
            assert not re.search(pattern, body), f"{pattern} in {path}"


def test_every_query_is_named_after_its_operator():
    from tidewatch import catalog

    catalog.load()
    assert len(catalog.QUERIES) > 190
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert all(re.match(r"^[a-z]\d\d_", n) for n in catalog.QUERIES)


def test_scratch_tables_are_deleted(spark):
    from tidewatch import session

    path = session.scratch_table(spark, "probe")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    kept = list(session._MADE)
    session._MADE[:] = [(spark, path)]
    try:
        assert session.clear_scratch(spark) == 1
    finally:
        session._MADE[:] = [x for x in kept if x[1] != path]
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def test_local_warehouse_is_refused_off_one_process():
    import pytest
    from tidewatch import session

    class Conf:
        def get(self, key, default=None):
            return "/warehouse" if key.endswith("warehouse.dir") else default

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    def getCheckpointDir(self):
                        class No:
                            def isDefined(self):
                                return False

                        return No()

                return Sc()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())
