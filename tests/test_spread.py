"""Few small inputs that give many rows: the rows come out of many tasks, and are the same."""

from pyspark.sql import functions as F

from rimlight.checks import QUERIES
from rimlight.operators import tone
from rimlight.operators import zones as Z


def one_file(spark, path, rows, schema):
    """A table in one file, as small tables are: one task reads it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def tasks_of(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_resampling_one_light_takes_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tone, "SHARE", 4)
    frames = [0, 1, 1, 4095, 4096, 9000, None]
    samples = one_file(spark, tmp_path / "s", [(t, f, 0, 7) for t in (1, None) for f in frames], "title_id int, frame_idx long, led_idx int, r int")
    totals = [3] * 20 + [0, None]
    targets = one_file(spark, tmp_path / "t", [(1, k // 2, 1, n) for k, n in enumerate(totals)] + [(None, 1, 1, 3), (1, None, 1, 3)],
                       "title_id int, target_id int, total_src int, total_tgt int")
    out = tone.resample_leds(samples, targets)
    assert out.columns == ["title_id", "led_idx", "frame_idx", "r", "target_id", "tgt_led"]
    got = [(r.title_id, r.frame_idx, r.target_id, r.tgt_led, r.led_idx, r.r) for r in out.collect()]
    expected = [(1, f, k, t, 0, 7) for f in frames for k in [k // 2 for k in range(20)] + [None] for t in range(3)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert tasks_of(out) > 4


def test_layouts_of_one_file_are_dealt_out(spark, tmp_path, monkeypatch):
    rows = [(k % 9 if k < 11 else None, 40, 30, 3, 0, 2, 1) for k in range(12)] + [(20, None, 30, 1, 1, 1, 1)]
    layouts = one_file(spark, tmp_path / "l", rows, "layout_id int, width int, height int, top int, bottom int, left int, right int")
    dealt = Z.dealt_layouts(layouts)
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, layouts.collect()))
    assert tasks_of(layouts) == 1 and tasks_of(dealt) > 2
    monkeypatch.setattr(Z, "PIXELS_PER_TASK", 500)
    assert Z.dealt_layouts(layouts).rdd.getNumPartitions() == 29  # 12 layouts of 1,200 pixels


def test_center_weight_takes_many_tasks(spark, sf_dir):
    """Pixels are spread out after the layouts are dealt, and summed up without another exchange."""
    plan = QUERIES["center_weight"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(layout_id") == 1 and plan.index("Generate") < plan.index("REPARTITION_BY_NUM")
