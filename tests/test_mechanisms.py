"""Selection, ordinals, automaton, compact readers, upserts and indexed seeks against plain code, with hot keys."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from rimlight.functions.packed import payload_delta
from rimlight.operators import compaction as C
from rimlight.operators import ordered
from rimlight.operators.routing import Automaton, name_matches
from rimlight.operators.selection import select_ranks
from rimlight.sources import indexed
from rimlight.streaming.progress import SCHEMA, ProgressTable


def test_selected_ranks_equal_sorting(spark):
    rng = random.Random(1)
    values = {k: [rng.choice([rng.randrange(-5, 5), rng.randrange(-2**62, 2**62), 1 << 40]) for _ in range(n)] for k, n in (("a", 400), ("b", 1), ("c", 30))}
    counts = spark.createDataFrame([(k, v, vs.count(v)) for k, vs in values.items() for v in set(vs)], "key string, v long, n long").repartition(4)
    ranks = [(k, r) for k, vs in values.items() for r in {1, (len(vs) + 1) // 2, len(vs)}]
    got = {(r.key, r.rank): r.v for r in select_ranks(counts, ["key"], "v", spark.createDataFrame(ranks, "key string, rank long")).collect()}
    assert got == {(k, r): sorted(values[k])[r - 1] for k, r in ranks}


def test_median_of_a_title_with_very_many_gaps(spark):
    n = 200_000
    step = 1_000 + (F.col("id") * 7919) % n  # nearly all gaps differ
    times = spark.range(n).select(F.lit("t").alias("title_id"), F.col("id").alias("frame_idx"), (F.col("id") * 500_000 + step).alias("ts_us"))
    row = C.vfr_report(times).first()
    ts = [i * 500_000 + 1_000 + (i * 7919) % n for i in range(n)]
    gaps = [b - a for a, b in zip(ts, ts[1:])]
    assert (row.gaps, row.median_gap_us, row.min_gap_us, row.max_gap_us) == (n - 1, median(gaps), min(gaps), max(gaps))
    assert row.drops == sum(g > 1.5 * row.median_gap_us for g in gaps)


def test_ordinals_of_a_sparse_hot_key(spark):
    """A million rows of one key, a million apart, beside small keys."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("key"), (F.col("id") * 1_000_000).alias("at")).unionByName(
        spark.range(50).select((F.col("id") % 5 + 2).cast("int").alias("key"), (F.col("id") * 10**12).alias("at")))
    out = ordered.with_row_index(df.repartition(8), ["key"], "at", "no")
    hot = out.where("key = 1")
    assert hot.where("no * 1000000 <> at").isEmpty() and hot.count() == n
    assert sorted((r.key, r.no) for r in out.where("key > 1").collect()) == [(k, i) for k in range(2, 7) for i in range(10)]
    assert out.columns == ["key", "at", "no"] and ordered.with_row_index(df.limit(0), ["key"], "at").count() == 0


def test_automaton_finds_what_is_contained():
    rng = random.Random(3)
    for _ in range(400):
        needles = list({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(1, 6))})
        automaton = Automaton(needles)
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        assert sorted(automaton.within(text)) == sorted(n for n in needles if n in text)


@pytest.mark.parametrize("limit", [100, 0])
def test_both_ways_of_contained_names(spark, limit):
    names = spark.createDataFrame([(n,) for n in ("room3tv", "kitchentv", "", "tv", "tv")], "norm_name string")
    mappings = spark.createDataFrame([(0, "TV"), (1, "room 3"), (2, "--"), (3, "tv"), (4, "x")], "mapping_order int, device_identifier string")
    got = sorted((r.norm_name, r.mapping_order) for r in name_matches(names, mappings, True, limit).collect())
    assert got == [("kitchentv", 0), ("kitchentv", 3), ("room3tv", 0), ("room3tv", 1), ("room3tv", 3), ("tv", 0), ("tv", 3)]
    loose = sorted(r.norm_name for r in name_matches(names, mappings, False, limit).where("mapping_order = 2").collect())
    assert loose == ["", "kitchentv", "room3tv", "tv"]


def test_similar_runs_come_back_within_the_similarity(spark):
    rng = random.Random(5)
    level, rows = 100, []
    for i in range(9_000):
        level = min(255, max(0, level + rng.choice([0, 0, 0, 1, 60, -60])))
        rows.append(("t", i, i * 41_666, bytearray([level] * 6)))
    frames = spark.createDataFrame(rows, "title_id string, frame_idx long, ts_us long, payload binary")
    exact = C.expand_runs(C.frame_runs(frames), frames)
    assert exact.exceptAll(frames).isEmpty() and exact.count() == len(rows)
    runs = C.frame_runs(frames, similarity=0.99)
    back = C.expand_runs(runs, frames).withColumnRenamed("payload", "back").join(frames, ["title_id", "frame_idx"])
    # each step of a run is within the similarity, so the k-th frame of a run is within k steps
    first = runs.select("first_frame", "frames", F.explode(F.expr("sequence(first_frame, first_frame + frames - 1)")).alias("frame_idx"))
    apart = back.join(first, "frame_idx").where(payload_delta("payload", "back") > 0.01 * (F.col("frame_idx") - F.col("first_frame")) + 1e-9)
    assert apart.isEmpty() and runs.count() < C.frame_runs(frames).count()


@pytest.mark.parametrize("threshold", [0, 25])
def test_deltas_come_back_within_the_threshold(spark, threshold):
    rng = random.Random(6)
    rows = [("t", i, i * 40, led, *[rng.randrange(256) if rng.random() < 0.1 else 128 + rng.randrange(20) for _ in range(4)])
            for i in range(100) if i % 7 != 3 or i % 48 == 0 for led in range(3)]
    samples = spark.createDataFrame(rows, "title_id string, frame_idx long, ts_us long, led_idx int, r int, g int, b int, w int")
    clock = samples.select("title_id", "frame_idx", "ts_us").distinct()
    back = {(r.frame_idx, r.led_idx): (r.r, r.g, r.b, r.w) for r in C.restore_deltas(C.delta_frames(samples, threshold=threshold), clock).collect()}
    assert set(back) == {(r[1], r[3]) for r in rows}
    assert max(abs(x - y) for r in rows for x, y in zip(back[r[1], r[3]], r[4:])) <= threshold


@pytest.mark.parametrize("every", [1, 3, 100])
def test_progress_table(spark, tmp_path, every):
    rng = random.Random(every)
    table = ProgressTable(spark, str(tmp_path / "p"), every)
    assert table.read().count() == 0
    latest, batches = {}, []
    for no in range(7):
        reports = [(f"i{rng.randrange(6)}", rng.randrange(100), rng.randrange(50)) for _ in range(rng.randrange(1, 9))]
        batches.append(spark.createDataFrame(reports, "item_id string, at long, frames_current long").select(
            "item_id", F.timestamp_seconds("at").alias("ts"), "frames_current", F.lit(50).cast("long").alias("frames_total")))
        for item, at, n in reports:
            latest[item] = max(latest.get(item, (-1, -1)), (at, n))
        table.upsert(batches[no], no)
        if no in (2, 5):  # a batch that is repeated changes nothing
            table.upsert(batches[no], no)
            table.upsert(batches[0], 0)
    got = {r.item_id: (int(r.ts.timestamp()), r.frames_current) for r in table.read().collect()}
    assert got == latest
    assert len(table._numbers("delta")) < every and table.read().schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()


def _scanned(df) -> int:
    """Rows that came out of the scans of frames."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "ts_us" in leaf.toString() and "Scan parquet" in leaf.toString() and "target_us" not in leaf.toString():
            total += leaf.metrics().apply("numOutputRows").value()
    return total


@pytest.mark.parametrize("pushed", [200, 0])
def test_indexed_seeks(spark, tmp_path, pushed):
    """Ten positions in 400 000 frames of two titles, one of them with steps back in time."""
    n, path = 200_000, str(tmp_path / f"x{pushed}")
    back = F.when((F.col("title_id") == "b") & (F.col("frame_idx") % 1000 == 999), 90_000_000).otherwise(0)
    frames = spark.range(2 * n).select(F.when(F.col("id") < n, "a").otherwise("b").alias("title_id"), (F.col("id") % n).alias("frame_idx")).withColumn(
        "ts_us", F.greatest(F.col("frame_idx") * 40_000 - back, F.lit(0)).cast("long")).withColumn("payload", F.lit(b"abc"))
    indexed.write_indexed_frames(frames, path)
    rng = random.Random(2)
    targets = [(rng.choice("ab"), rng.randrange(n * 40_000)) for _ in range(7)] + [("a", 10**12), ("a", 0), ("c", 5), ("b", 10_000_000)]
    ts = {t: [max(0, i * 40_000 - (90_000_000 if t == "b" and i % 1000 == 999 else 0)) for i in range(n)] for t in "ab"}
    find = lambda t, us: None if t not in ts else next((i for i, x in enumerate(ts[t]) if x >= us), n - 1)
    lookups = spark.createDataFrame(targets + targets[:2], "title_id string, target_us long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = indexed.seek_indexed(spark, path, lookups, pushed)
        rows = sorted(((r.title_id, r.target_us, r.frame_idx) for r in found.collect()), key=repr)
        if pushed:
            # ten seconds hold 250 frames; pages of a thousand rows are the least that is read
            assert 0 < _scanned(found) <= 10 * (250 + 2 * indexed.PAGE_ROWS)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows == sorted(((t, us, find(t, us)) for t, us in targets + targets[:2]), key=repr)
