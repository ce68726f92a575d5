"""Targets of a light travel as arrays; every sample still meets every one of them."""

from rimlight.operators import tone


def test_targets_are_looked_up_once_for_a_sample(spark, monkeypatch):
    samples = spark.createDataFrame([(t, f, i, (f or 0) * 2 + i) for t in (1, 2) for f in (0, 5, 5000, None) for i in range(2)],
                                    "title_id int, frame_idx long, led_idx int, r int")
    rows = [(1, k, 2, 1 + k % 3) for k in range(300)] + [(1, 7, 2, 2)] * 3 + [(1, None, 2, 1), (2, 1, 2, None), (2, 2, 2, 0), (None, 1, 2, 2)]
    targets = spark.createDataFrame(rows, "title_id int, target_id int, total_src int, total_tgt int")
    expected = sorted(((1, t * 2 // n, f, (f or 0) * 2 + t * 2 // n if f is not None else None, k, t)
                       for title, k, _, n in rows if title == 1 for t in range(n) for f in (0, 5, 5000, None)), key=repr)
    samples = samples.selectExpr("title_id", "frame_idx", "led_idx", "if(frame_idx is null, null, r) as r")
    for share in (tone.SHARE, 16):
        monkeypatch.setattr(tone, "SHARE", share)
        out = tone.resample_leds(samples, targets)
        assert out.columns == ["title_id", "led_idx", "frame_idx", "r", "target_id", "tgt_led"]
        assert sorted(map(tuple, out.collect()), key=repr) == expected
        joins = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        assert "collect_list" in joins and "inline(_targets" in joins  # and not a row of the join for every target
