"""Actions to steps and back."""

from spanforge.operators import replays as R


def test_steps_and_back(spark):
    seen = [(1, "#a", "h1", "s1", True), (2, "#b", "h2", "s2", True), (3, "#c", "h3", "s3", True), (4, "", "h4", "s4", True)]
    now = [(7, "#a", "h1", "s1", True), (8, "#b", "h2x", "s2", True), (9, "#c", "h3", "s3", True), (10, "#c", "h3", "s3", True), (11, "#h", "h1", "s1", False)]
    at = lambda n: f'[data-aid="{n}"]'
    cases = [
        (("goto", "u", None, None, None, None), ("goto", "u", None, None, None, None)), (("keyboard", None, "hi", "Control+A", None, None), ("keyboard", None, "hi", "Control+A", None, None)),
        (("download", "f", None, None, None, None), ("download", "f", None, None, None, None)), (("click", None, None, None, at(1), None), ("click", None, None, None, at(7), None)),
        (("fill", None, None, None, at(2), "v"), ("fill", None, None, None, at(8), "v")), (("press", None, None, "Tab", at(1), None), ("press", None, None, "Tab", at(7), None)),
        (("press", None, None, "", at(1), None), ("press", None, None, "Enter", at(7), None)), (("extract_text", None, None, None, at(3), None), ("extract_text", None, None, None, "#c", None)),
        (("download", "f", None, None, at(2), None), ("download", "f", None, None, at(8), None)), (("click", None, None, None, at(4), None), None),  # seen then, without a selector; gone now
        (("click", None, None, None, at(5), None), None), (("click", None, None, None, "#a", None), None), (("click", None, None, None, None, None), None), (("mouse", None, None, None, at(1), None), None), ((None,) * 6, None),
    ]
    df = spark.createDataFrame([(k, a, seen, now) for k, (a, _) in enumerate(cases)], f"k int, action {R.ACTION}, seen {R.SEEN}, now {R.SEEN}")
    steps = df.select("k", "now", R.step_of(R.F.col("action"), R.F.col("seen"), R.F.lit("why")).alias("s"))
    rows = {r.k: r for r in steps.select("k", "s", R.action_of(R.F.col("s"), R.F.col("now")).alias("a")).collect()}
    assert {k: rows[k].a and tuple(rows[k].a) for k in rows} == {k: want for k, (_, want) in enumerate(cases)}
    assert [k for k in rows if rows[k].s is None] == list(range(10, 15)) and tuple(rows[4].s) == ("fill", "v", "", "#b", "h2", "s2", "why")
    # on an unchanged page a step is its action again
    same = df.where("k < 9").select("k", "action", R.action_of(R.step_of(R.F.col("action"), R.F.col("seen"), R.F.lit("")), R.F.col("seen")).alias("again"))
    assert all(tuple(r.action) == tuple(r.again) for r in same.collect() if r.k != 6)


def test_banked(spark):
    seen = [(1, "#a", "h1", "s1", True)]
    go, click, mouse = ("goto", "u", None, None, None, None), ("click", None, None, None, '[data-aid="1"]', None), ("mouse", None, None, None, None, None)
    rows = [("a", 2, click, seen, "l"), ("a", 1, go, seen, None), ("b", 1, go, seen, "l"), ("b", 2, mouse, seen, "l")]
    got = {r.run_id: r for r in R.banked(spark.createDataFrame(rows, f"run_id string, step int, action {R.ACTION}, seen {R.SEEN}, label string")).collect()}
    assert got["a"].bankable and [s.action for s in got["a"].steps] == ["goto", "click"] and not got["b"].bankable and got["b"].steps[1] is None
