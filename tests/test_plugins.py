"""Plugins: sources, transforms and sinks from files."""

import pytest

from millrace.plans import plugins
from millrace.plans.pipeline import Pipeline
from tests.conftest import rows

PLUGIN = """
from pyspark.sql.datasource import DataSource, DataSourceReader


class Squares(DataSource):
    @classmethod
    def name(cls):
        return "squares"

    def schema(self):
        return "n int, square int"

    def reader(self, schema):
        return Reader(int(self.options.get("upto", 3)))


class Reader(DataSourceReader):
    def __init__(self, upto):
        self.upto = upto

    def read(self, partition):
        for n in range(self.upto):
            yield n, n * n


def register(registry):
    registry.source(Squares)
    registry.transform("even")(lambda df: df.filter("square % 2 = 0"))
    registry.sink("keep")(lambda df: kept.extend(map(tuple, df.collect())))


kept = []
"""


def test_plugins_of_a_directory(spark, tmp_path):
    (tmp_path / "squares.py").write_text(PLUGIN)
    found = plugins.load(spark, str(tmp_path))
    p = Pipeline(spark.read.format("squares").option("upto", 5).load()).transform(found.transforms["even"])
    assert rows(p.source) == [(0, 0), (2, 4), (4, 16)]
    p.to(found.sinks["keep"])
    (tmp_path / "twice.py").write_text("def register(r):\n    r.transform('even')(None)\n")
    with pytest.raises(ValueError):
        plugins.load(spark, str(tmp_path))
    (tmp_path / "twice.py").write_text("")
    with pytest.raises(ValueError):
        plugins.load(spark, str(tmp_path))
