import json

from voxloom.operators import drift
from voxloom.operators.drift import compare_headers, consistent_table, file_changes, file_headers, promote, quarantine, summary_of, union_schema

SCHEMA = "feed_name string, file_no int, line_no int, payload string, extra string, kind string"


def feed(spark, files):
    rows = [(name, no, i, p if isinstance(p, (str, type(None))) else json.dumps(p), "x", "y") for (name, no), ps in files.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, SCHEMA)


FILES = {
    ("f", 1): [{"customer_id": f"U{i}", "score": 0.1 * i, "note": None, "turns": [{"speaker": "agent", "text": "x", "start_time": 1.5}]} for i in range(6)] + ['{"customer_id": "U7", "sco', None, "[1]"],
    ("f", 2): [{"cust_id": f"U{i}", "score": str(0.1 * i), "turns": [{"speaker": "agent", "text": "x", "start": "2.5"}]} for i in range(6)] + [{"cust_id": "U9", "score": 1, "note": "n", "turns": []}],
    ("g", 2): [{"customer_id": "U1"}],
    ("f", 4): [{"cust_id": "U1"}],
}


def test_changes(spark):
    got = {tuple(r) for r in file_changes(file_headers(feed(spark, FILES))).select("feed_name", "file_no", "change_kind", "field_path", "new_path").collect()}
    assert got == {
        ("f", 2, "renamed", "customer_id", "cust_id"),
        ("f", 2, "retyped", "score", ""),
        ("f", 2, "added", "note", ""),
        ("f", 2, "renamed", "turns.start_time", "turns.start"),
        ("f", 2, "retyped", "turns.start", ""),
    }


def test_table_and_quarantine(spark):
    df = feed(spark, FILES)
    headers = file_headers(df)
    names, types = union_schema(headers, file_changes(headers), ("customer_id", "turns.start_time"))
    assert names["cust_id"] == "customer_id" and types["score"] == "number" and types["turns.start_time"] == "number"
    rows = consistent_table(df, names, types).collect()
    assert len(rows) == 15 and all(r.customer_id for r in rows)
    assert {t.start_time for r in rows if r.file_no == 2 and r.feed_name == "f" for t in r.turns} == {2.5}
    assert quarantine(df).count() == 3


def test_unfit_values_are_kept(spark):
    df = feed(spark, {("f", 1): [{"a": 1}, {"a": 2}, {"a": True}]})
    headers = file_headers(df)
    names, types = union_schema(headers, file_changes(headers))
    df2 = feed(spark, {("f", 1): [{"a": [1]}]})
    assert consistent_table(df2, names, {"a": "number"}).first().unfit == {"a": "[1]"}
    assert types["a"] in ("string", "number")


def test_empty(spark):
    df = feed(spark, {})
    assert file_headers(df).count() == 0 and file_changes(file_headers(df)).count() == 0 and quarantine(df).count() == 0


def test_compare_needs_name_or_telling_values():
    a = {"relevance": ("number", summary_of(["0.5", "0.7"]))}
    assert [c[0] for c in compare_headers(a, {"product_confidence": ("number", summary_of(["0.5", "0.7"]))})] == ["added", "removed"]
    assert compare_headers(a, {"relevance_score": ("string", summary_of(["0.4", "0.9"]))})[0][0] == "renamed"
    assert compare_headers({"redactions": ("number", summary_of(["1", "9"]))}, {"pii_count": ("number", summary_of(["2", "9"]))}, {"redactions": "x", "pii_count": "x"})[0][0] == "renamed"


def test_summaries_cover_all_values_in_any_order():
    """One text among thousands of numbers is counted, and sketches of parts give those of the whole."""
    values = [str(i) for i in range(5000)] + ["no number"] + [f"A-{i:05d}" for i in range(3000)]
    whole = summary_of(values)
    for step in (2, 7):
        parts = [summary_of(values[k::step]) for k in range(step)]
        merged = parts[0]
        for p in reversed(parts[1:]):
            merged = merged.merge(p)
        assert merged == whole
    assert whole.n == len(values) and whole.numbers == 5000 and len(whole.values) == drift.SKETCH
    other = summary_of([f"A-{i:05d}" for i in range(1500, 4500)])
    half = summary_of([f"A-{i:05d}" for i in range(3000)])
    x, y = drift._comparable(half.values, other.values)
    assert 0.3 < len(x.keys() & y.keys()) / min(len(x), len(y)) < 0.7


def test_a_text_past_many_numbers_keeps_the_column_text(spark):
    df = feed(spark, {("f", 1): [{"a": str(i)} for i in range(300)] + [{"a": "none"}]})
    headers = file_headers(df)
    names, types = union_schema(headers, file_changes(headers))
    assert types["a"] == "string" and consistent_table(df, names, types).filter("a = 'none'").count() == 1


def test_lattice():
    assert promote("number", "string") == "string" and promote("array", "string") == "array" and promote("boolean", None) == "boolean" and promote("object", "array") == "string"
