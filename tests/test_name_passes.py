"""Work of the passes of block_match."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.operators import cohort as CO


def test_rows_of_names_are_read_once(spark):
    """However many passes there are, each side's rows are made once, and the passes see distinct names only."""
    seen = spark.sparkContext.accumulator(0)

    def told(i: int) -> str:
        seen.add(1)
        return ["Anna Meyer", "Bert Cole", "qqq", "zzzzzz", ""][i % 5] + "x" * (i % 2) if i % 7 else None

    made = F.udf(told, "string").asNondeterministic()
    left, right = (spark.range(n, n + 100).select(made(F.col("id").cast("int")).alias("name")) for n in (0, 50))
    got = {r["a"]: (r["b"], r["ratio"]) for r in CO.block_match(left, right).collect()}
    names = {x + y for x in ("Anna Meyer", "Bert Cole", "qqq", "zzzzzz") for y in ("", "x")} | {"x"}
    assert got == {x: (x, 1.0) for x in names}
    assert seen.value == 200
