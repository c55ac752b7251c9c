"""Comparison of a DataFrame with SQL that another engine runs on the same tables."""


def same_rows(duck, spark_df, sql: str) -> None:
    """Equal columns, types and rows, in any order."""
    left, right = spark_df.toArrow(), duck.sql(sql).to_arrow_table()
    assert sorted(left.column_names) == sorted(right.column_names)
    names = ",".join(f'"{c}"' for c in left.column_names)
    duck.register("left_", left)
    duck.register("right_", right)
    for a, b in (("left_", "right_"), ("right_", "left_")):
        assert duck.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b} LIMIT 3").fetchall() == []
    plain = lambda t: str(t).replace("large_", "")
    assert {c: plain(left.schema.field(c).type) for c in left.column_names} == {c: plain(right.schema.field(c).type) for c in left.column_names}
