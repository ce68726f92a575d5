"""Keys of lines: what they are, and that their parts are worked out once."""

from pyspark.sql import functions as F

from rimlight.llm.line_dedup import _line_key


def test_parts_of_a_key_are_worked_out_once(spark):
    rows = [("\t Ab C\x0b",), ("ab c",), ("Äb C ",), ("Äb c",), ("äb c",), (" \r",), ("",), (None,)]
    keys = spark.createDataFrame(rows, "line string").select(_line_key(F.col("line"), 1).alias("k"))
    plan = keys._jdf.queryExecution().analyzed().toString()
    assert plan.count("btrim(") == 1 and plan.count("translate(") == 1
    a, b, c, d, e, *none = [r.k for r in keys.collect()]
    assert a == b and c == d and len({a, c, e}) == 3 and none == [None] * 3
