import json
import random
from itertools import permutations

from graphloom.llm import tool_calls as tc

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
TOOL = json.dumps({"required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": ["integer", "null"], "maximum": 5}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}, "additionalProperties": False, "type": "object"})


def test_canonical_round_trip():
    rnd = random.Random(0)

    def value(d=0):
        kind = rnd.randrange(7 if d < 3 else 5)
        if kind == 5:
            return [value(d + 1) for _ in range(rnd.randrange(4))]
        if kind == 6:
            return {rnd.choice("äb\"\\\nzé") + str(rnd.randrange(9)): value(d + 1) for _ in range(rnd.randrange(4))}
        return [None, True, rnd.randrange(-99, 99), rnd.random(), "x \t\"é"][kind]

    for _ in range(300):
        v = value()
        text = tc.canonical(v)
        assert json.loads(text) == v
        assert tc.canonical(json.loads(json.dumps(v))) == text
    assert tc.canonical({"b": 1.0, "a": [2.50]}) == '{"a":[2.5],"b":1}'


def test_order_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        ids = [f"c{k}" for k in range(5)]
        calls = [(c, (k,), [rnd.choice(ids) for _ in range(rnd.randrange(2))]) for k, c in enumerate(ids)]
        got = tc.positions(calls)
        ok = [p for p in permutations(range(5)) if all(n != ids[i] and p.index(ids.index(n)) < p.index(i) for i in range(5) for n in calls[i][2])]
        if ok:
            assert [ids[i] for i in min(ok)] == sorted(got, key=got.get)
        else:
            assert len(got) < 5


def test_rows(spark):
    calls = [
        (1, 1, "a", "find", '{"q": "x", "n": 2}', ["b"]), (1, 2, "b", "find", '{"n": 9, "q": "y"}', []), (1, 3, "b", "find", '{"q":"again"}', []),
        (2, 1, "a", "find", '{"q": 3}', ["b"]), (2, 2, "b", "find", "{oops", ["a"]), (2, 3, "c", "none", "{}", ["zz"]),
        (3, 1, "a", "find", None, None), (None, 1, "a", "find", '{"q":""}', []), (3, 2, None, "find", '{"q":"","tags":["a","c"]}', []),
    ]
    results = [(1, 5, "b", "late"), (1, 4, "b", "R"), (1, 6, "a", None), (2, 9, "zz", "lost"), (None, 1, "a", "no"), (3, 1, "a", "ok")]
    df = spark.createDataFrame([(*c, "x") for c in calls], CALLS + ", content string")
    got = tc.linked(df, spark.createDataFrame(results, RESULTS), spark.createDataFrame([("find", TOOL), ("find", TOOL)], "name string, schema string"))
    rows = sorted((r.conv_id or 0, r.call_id or "", r.json, r.position, r.answered, r.valid, r.problem) for r in got.collect())
    assert [(r[0], r[1], *r[3:]) for r in rows] == [
        (0, "a", None, False, True, "no id"),
        (1, "a", 2, True, True, None),
        (1, "b", 1, True, False, "arguments.n: too large"),
        (1, "b", None, False, True, "repeated id"),
        (2, "a", None, False, False, "arguments.q: not string"),
        (2, "b", None, False, False, "arguments: not JSON"),
        (2, "c", 1, False, False, "unknown tool"),
        (3, "", None, False, False, "arguments.tags[1]: not among the allowed values"),
        (3, "a", 1, True, False, "arguments: not object"),
    ]
    assert rows[1][2] == '{"arguments":{"n":2,"q":"x"},"id":"a","name":"find","result":null}'
    assert rows[2][2] == '{"arguments":{"n":9,"q":"y"},"id":"b","name":"find","result":"R"}'


def test_empty(spark):
    none = tc.linked(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame([], "name string, schema string"))
    assert none.count() == 0


def test_odd_arguments_and_schemas(spark):
    deep = "[" * 300 + "]" * 300
    odd = {"half": '{"q":"\\ud800"}', "nan": '{"q":NaN}', "huge": '{"q":1e999}', "deep": '{"q":' + deep + "}", "deeper": "[" * 100_000, "long": "1" * 5000, "big": str(10**400), "ok": '{"q":"x"}'}
    calls = [(1, k, name, "find", text, [], "t") for k, (name, text) in enumerate(odd.items())]
    calls += [(2, k, name, name, "{}", [None] if k == 0 else [], "t") for k, name in enumerate(("nojson", "list", "kinds", "yes", "no", "deepschema"))]
    tools = [("find", '{"properties":{"q":true}}'), ("nojson", "{"), ("list", "[]"), ("kinds", '{"required":5}'), ("yes", "true"), ("no", "false"), ("deepschema", '{"items":' * 300 + "1" + "}" * 300)]
    df = spark.createDataFrame(calls, CALLS + ", problem string")
    got = {r.call_id: r for r in tc.linked(df, spark.createDataFrame([], RESULTS), spark.createDataFrame(tools, "name string, schema string")).collect()}
    assert len(got) == len(calls)
    want = {"half": None, "nan": "arguments: not JSON", "huge": "arguments: not JSON", "deep": "arguments: nested too deeply", "deeper": "arguments: nested too deeply", "long": "arguments: not JSON", "big": None, "ok": None}
    want |= {"nojson": "schema: not usable", "list": "schema: not usable", "kinds": "schema: not usable", "yes": None, "no": "arguments: not allowed", "deepschema": "schema: not usable"}
    assert {k: r.problem for k, r in got.items()} == want
    assert got["half"].json == '{"arguments":{"q":"\\ud800"},"id":"half","name":"find","result":null}'
    for r in got.values():
        json.loads(r.json, parse_constant=lambda c: 1 / 0)


def test_repeated_rows_and_calls_without_conversation(spark):
    calls = [(1, 1, "a", "find", '{"q":"x"}', [])] * 3 + [(None, 1, "a", "find", '{"q":"x"}', [])] * 4 + [(2, None, "a", "find", '{"q":"x"}', ["b"]), (2, 5, "b", "find", '{"q":"x"}', None)]
    got = tc.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame([(1, 2, "a", "R")] * 2, RESULTS), spark.createDataFrame([("find", TOOL)], "name string, schema string")).collect()
    rows = sorted((r.conv_id or 0, r.call_id, r.position or 0, r.answered, r.problem or "") for r in got)
    assert rows == [(0, "a", 0, False, "no id")] * 4 + [(1, "a", 0, False, "repeated id")] * 2 + [(1, "a", 1, True, ""), (2, "a", 2, False, ""), (2, "b", 1, False, "")]


def test_order_over_tables_equals_the_heap(spark):
    """Conversations in and out of order, with circles and unknown calls, against the topological order of each."""
    rnd = random.Random(4)
    calls, want = [], {}
    for conv in range(40):
        rows = []
        for k in range(7):
            needs = [f"c{rnd.randrange(8 if conv % 2 else k + 1)}" for _ in range(rnd.randrange(3))]
            rows.append((conv, rnd.randrange(5), f"c{k}", "find", '{"q":"x"}', [n for n in needs if conv % 2 or n < f"c{k}"]))
        rows = sorted(rows, key=lambda r: (r[1], r[2])) if conv % 4 == 0 else rows
        place = tc.positions([(r[2], (r[1], r[2]), r[5]) for r in rows])
        want |= {(conv, r[2]): place.get(r[2]) for r in rows}
        calls += rows
    got = tc.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame([("find", TOOL)], "name string, schema string"))
    assert {(r.conv_id, r.call_id): r.position for r in got.collect()} == want


def test_fuzz_of_arguments_never_fails():
    rnd = random.Random(6)
    for _ in range(50_000):
        text = "".join(rnd.choice('{}[]",:\\u0d8Nae1.-+Ti \n') for _ in range(rnd.randrange(14)))
        value, problem = tc.parsed(text)
        assert problem or json.loads(tc.canonical(value)) == value
