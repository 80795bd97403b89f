import pytest

from tracewell.llm import common


def test_names_that_clash():
    assert common.fresh(["A", "b", "B_1"], "a", "b", "c", "c") == ["a_1", "b_2", "c", "c_1"]
    assert common.fresh([], "x") == ["x"]


def test_staged_tables_and_sizes(spark):
    df = spark.createDataFrame([(1, "abc", [1, 2]), (2, None, None)], "`odd ``name` long, t string, l array<int>")
    again = common.stage(df)
    assert again.schema == df.schema and sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    rows, size = common.total_bytes(again)
    assert rows == 2 and size > 40
    assert common.small(again) and not common.small(again, 10)
    assert "broadcast" in common.broadcast_if_small(again)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in common.broadcast_if_small(again, 10)._jdf.queryExecution().logical().toString().lower()
    assert common.total_bytes(again.limit(0)) == (0, 0)


def test_shared_folder_comes_from_the_session(spark):
    old = spark.conf.get("spark.checkpoint.dir", None)

    class Conf:
        def get(self, key, default=None):
            return "file:///shared" if key == "spark.checkpoint.dir" else default

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class None_:
                    def getCheckpointDir(self):
                        class Option:
                            def isDefined(self):
                                return False

                        return Option()

                return None_()

    class Session:
        conf, sparkContext = Conf(), Context()

    assert common.shared_dir(Session()) == "file:///shared"
    Session.conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})()
    with pytest.raises(ValueError):  # on a cluster no folder of this machine is made
        common.shared_dir(Session())
    assert spark.conf.get("spark.checkpoint.dir", None) == old
