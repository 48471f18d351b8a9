"""A layer of the catalogue may be longer than a task can hold."""

from tideline.sources import catalog


def test_sections_reach_over_ranges_of_a_layer(spark):
    """A section of many lines, so that most ranges have no section line of their own; the first lines belong to none."""
    lines = [(0, 0, "early = 1"), (0, 1, "[Diagnostic:long]"), *[(0, i, f"o{i} = {i}") for i in range(2, 400)], (0, 400, "[Diagnostic:b]"), (0, 401, "x: 2"), (1, 0, "none = 3"), (1, 5, "[Diagnostic:long]"), (1, 6, "o7 = 8")]
    out = catalog.parse(spark.createDataFrame(lines, "layer int, line_no long, line string").repartition(3))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line.split("windowspecdefinition")[1] for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("__block" in w for w in windows)
    got = {(r["layer"], r["name"], r["option"]): r["value"] for r in out.collect()}
    assert got == {**{(0, "long", f"o{i}"): str(i) for i in range(2, 400)}, (0, "b", "x"): "2", (1, "long", "o7"): "8"}
    assert {r["option"]: r["value"] for r in catalog.merged(out).where("name = 'long'").collect()}["o7"] == "8"
