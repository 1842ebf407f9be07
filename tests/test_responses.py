"""Answers are merged by what is as wide as their own call's fields, whatever is wrong with them."""

from pyspark.sql.types import ArrayType, StringType

from tallyframe.operators import collect

COLUMNS = "post_id string, window string, call string, body string, duration_s double"


def core(**values):
    names = ", ".join(f'{{"name": "{n}"}}' for n in values)
    return f'{{"columnHeaders": [{names}], "rows": [[{", ".join(map(str, values.values()))}]]}}'


def test_every_reason_of_repeated_answers(spark):
    curve = lambda *ps: '{"rows": [' + ", ".join(f"[{x}, {y}]" for x, y in ps) + "]}"
    rows = [
        ("a", "w1", "core", core(views=3, likes=1), 10.0), ("a", "w1", "core", core(views=2, likes=7), 10.0), ("a", "w1", "core", core(views='"x"'), 10.0), ("a", "w1", "core", '{"rows": [', 10.0),
        ("a", "w1", "retention", curve((0, 1), (1, 0.5)), 10.0), ("a", "w1", "retention", curve((0, 1), (1, 0.25), (2, 0)), 10.0), ("a", "w1", "retention", curve((0, '"x"')), 10.0), ("a", "w1", "retention", "no", 10.0),
        ("a", "w1", "lifetime", '{"items": [{"statistics": {"likeCount": "9", "commentCount": "4"}}]}', 10.0), ("a", "w1", "lifetime", '{"items": [{"statistics": {"likeCount": "n/a"}}]}', 10.0), ("a", "w1", "lifetime", None, 10.0), ("a", "w1", "other", "{", 10.0),
        (None, None, "core", "{", None), (None, None, "core", "{", None), (None, "w1", "retention", '{"rows": []}', 0.0), ("b", None, "lifetime", '{"items": []}', None), ("c", "w1", "other", "{", None),
    ]
    parsed = collect.parse_responses(spark.createDataFrame(rows, COLUMNS))
    assert parsed.schema["errors"].dataType == ArrayType(StringType(), False)
    got = {(r.post_id, r.window): r for r in parsed.collect()}
    assert set(got) == {("a", "w1"), (None, None), (None, "w1"), ("b", None)}
    a = got["a", "w1"]
    assert a.errors == ["core: not JSON", "core: not a number", "lifetime: not JSON", "lifetime: not a number", "retention: not JSON", "retention: not a number"]
    assert (a.views, a.likes, a.comments, a.shares) == (3, 7, 4, None)
    assert [tuple(p) for p in a.retention_curve] == [(0.0, 1.0), (10.0, 0.5)]
    assert (a.hook_retention_3s, a.dropoff_3s) == (0.85, 0.225)
    assert got[None, None].errors == ["core: not JSON"] and got[None, "w1"].errors == got["b", None].errors == []


def test_rows_wait_as_structures_of_their_call(spark):
    rows = spark.createDataFrame([("a", "w1", "core", "{}", 1.0)], COLUMNS)
    plan = collect.parse_responses(rows)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "ObjectHashAggregate" not in plan  # these copy each row with all calls' columns, beside its key
    assert all(f"max({call}_fields#" in plan for call in collect.CALLS)
