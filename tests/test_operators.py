"""Graph operators over frames, and a monotone program over a stream."""

import pytest

from stratalog.operators import connected, same_generation, transitive_closure
from stratalog.streaming import MonotoneProgram


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_graph_operators(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "x bigint, y bigint")
    assert pairs(transitive_closure(e)) == [(1, 2), (1, 3), (2, 3)]
    assert pairs(connected(e)) == sorted((a, b) for a in (1, 2, 3) for b in (1, 2, 3))
    s = lambda *rows: spark.createDataFrame(rows, "a string, b string")
    assert pairs(same_generation(s(("x", "p"), ("p", "r")), s(("r", "r")), s(("r", "q"), ("q", "y")))) == [("p", "q"), ("r", "r"), ("x", "y")]
    with pytest.raises(TypeError):
        transitive_closure(spark.createDataFrame([(1.5, 2.5)], "a double, b double"))


def test_monotone_stream(spark, tmp_path):
    text = ".decl e(a:number, b:number) input .decl p(a:number, b:number) p(x,y) :- e(x,y). p(x,z) :- p(x,y), e(y,z)."
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(source)
    program = MonotoneProgram(spark, text, "e", str(tmp_path / "state"), ["p"])
    stream = spark.readStream.schema("a int, b int").parquet(source)
    for extra, want in ((None, [(1, 2)]), ((2, 3), [(1, 2), (1, 3), (2, 3)])):
        if extra:
            spark.createDataFrame([extra], "a int, b int").write.mode("append").parquet(source)
        q = program.start(stream, str(tmp_path / "check"), availableNow=True)
        q.awaitTermination(120)
        assert q.exception() is None
        assert pairs(program.result("p")) == want
    with pytest.raises(ValueError, match="monotone"):
        MonotoneProgram(spark, text + " .decl n(a:number) n(x) :- e(x,_), !p(x,x).", "e", str(tmp_path), ["n"])
