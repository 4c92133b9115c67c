"""Tables in the shared folder and their lifetimes."""

from tidemark.session import hadoop_path, materialise, scope, shared_dir


def exists(spark, df):
    fs, path = hadoop_path(spark, df.inputFiles()[0])
    return fs.exists(path)


def test_scopes(spark):
    outer = materialise(spark.range(3), "t")
    with scope(spark) as keep:
        gone = materialise(spark.range(4), "t")
        with scope(spark) as inner:
            kept = inner(gone.where("id > 1"), "t")
            inside = materialise(spark.range(2), "t")
            file = hadoop_path(spark, inside.inputFiles()[0])
        assert not file[0].exists(file[1]) and exists(spark, kept)
        out = keep(kept, "t")
        files = [hadoop_path(spark, x.inputFiles()[0]) for x in (gone, kept)]
    assert not any(fs.exists(p) for fs, p in files)
    assert sorted(r.id for r in out.collect()) == [2, 3] and exists(spark, outer)
    assert shared_dir(spark).rpartition("/")[2] in out.inputFiles()[0]
