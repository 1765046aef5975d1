"""Activity of users from orders and their lines."""

from __future__ import annotations

from datetime import datetime

from cohortry.sources import standins as S


def test_lines_meet_orders_before_they_are_summed(spark, tmp_path):
    day = datetime(2001, 1, 5)
    orders = [(1, 7, day, "1-URGENT"), (2, 7, day, "5-LOW"), (2, 7, day, "5-LOW"), (3, 8, datetime(1996, 1, 1), "1-URGENT"),
              (4, 8, day, None), (None, 9, day, "1-URGENT"), (5, 9, day, "5-LOW")]
    lines = [(1, 1.0, 0.09, 0.08, "A", "F"), (1, 50.0, 0.0, 0.0, "R", "O"), (2, 10.0, 0.01, 0.01, "A", "O"), (3, 5.0, 0.09, 0.08, "R", "F"),
             (4, None, None, None, "R", None), (4, 3.0, None, 0.0, None, "F"), (None, 4.0, 0.09, 0.08, "A", "F")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, "
                                 "l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = S.user_activity(spark, str(tmp_path))
    rows = {r.o_custkey: r.asDict() for r in found.collect()}
    assert set(rows) == {7, 8}  # orders without lines and without a key meet none
    first, other = rows[7], rows[8]
    assert [first[f"cnt_{c}"] for c in ("source", "memory", "involved", "record", "tree", "name")] == [1, 1, 1, 1, 1, 3]
    assert [first[f"q_{c}"] for c in ("tree", "name", "deceased", "living", "novel", "qualified")] == [50, 21, 1, 20, 20, 20]
    assert first["days_login"] == 1 and first["days_name"] == 1 and first["first_tree"] == day.date()
    assert other["cnt_tree"] == 1 and other["q_tree"] is None and other["days_login"] == 0 and other["cnt_name"] == 0
    # before, all lines were summed by order first, those outside the period too
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_orderkey" not in plan and plan.count("Aggregate") == 2
