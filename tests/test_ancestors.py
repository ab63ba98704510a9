from inkwell.operators import context


def test_wanted_ancestors_far_up(spark):
    nodes = [(i, i - 1 if i else None, "function" if i in (0, 1) else "block", f"n{i}") for i in range(8)]
    d = spark.createDataFrame(nodes, "id long, parent long, type string, text string")
    got = {r.id: r.content for r in context.ancestors(d, ("function",)).collect()}
    both = "-- [function]\nn0\n\n-- [function]\nn1"
    assert got == {0: "", 1: "-- [function]\nn0", **{i: both for i in range(2, 8)}}
