import pytest

from proofmill.llm import common


def test_workspace_writes_below_the_shared_folder(spark, monkeypatch):
    space = common.Workspace(spark, "t")
    assert space.path.startswith(f"{common.shared_dir(spark)}/proofmill-t-")
    saved = space.save(spark.range(5).withColumnRenamed("id", "x"), "five")
    assert saved.columns == ["x"] and saved.count() == 5
    space.drop()
    fs, at = space._fs(space.path)
    assert not fs.exists(at)


def test_shared_folder_follows_the_setting(spark, monkeypatch):
    class Conf(dict):
        get = dict.get

    class Context:
        master, applicationId, made = "local[2]", "app-test", []

        def __init__(self, **conf):
            self.conf = Conf(conf)

        def getConf(self):
            return self.conf

        def setCheckpointDir(self, path):
            self.made.append(path)

    class Session:
        def __init__(self, own, context):
            self.conf, self.sparkContext = Conf(own), context

    set_there = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert common.shared_dir(Session(set_there, Context())) == "hdfs://x/y"
    assert common.shared_dir(Session({}, Context(**set_there))) == "hdfs://x/y"
    own = common.shared_dir(Session({}, Context()))
    assert own.startswith("file:///") and common.shared_dir(Session({}, Context())) == own and Context.made == [own]
    far = Context()
    far.master = "spark://host:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session({}, far))


def test_small_is_bounded(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b" * 100,)], "s string")
    assert len(common.small(rows, 3)) == 3
    assert common.small(rows, 2) is None and common.small(rows, 9, 50) is None


def test_word_rules(spark):
    rows = spark.createDataFrame([("a b c\x0bd\x1ce",), (None,), ("",), ("  x ",)], "s string")
    assert [r["n"] for r in rows.select(common.word_count(rows["s"]).alias("n")).collect()] == [3, 0, 0, 1]
    assert rows.select(common.ascii_lower(rows["s"]).alias("l")).first()["l"] == "a b c\x0bd\x1ce"
