"""Spans of turns over whole calls, against plain Python."""

from voxloom import queries

SCHEMA = "call_id string, turns array<struct<speaker: string, text: string, start_time: double, speaker_confidence: double>>"


def shared(turns):
    """{(turn, tile): seconds} of turns whose times are seconds."""
    order = sorted((s, i) for i, s in enumerate(turns) if s is not None)
    out = {}
    for k, (s, i) in enumerate(order):
        e = order[k + 1][0] if k + 1 < len(order) else s + 10.0
        for tile in range(int(s // 20), int(e // 20) + 1):
            part = min(e, tile * 20.0 + 20.0) - max(s, tile * 20.0)
            if part > 0:
                out[i, tile] = round(part, 6)
    return out


def test_turns_after_1500_seconds_and_in_milliseconds(spark, tmp_path):
    long = [0.0, 12.0, 1490.0, None, 1510.0, 1555.5, 4000.0]
    short = [0.0, 4.5, 9.0, 31.0, 50.0]
    says = "something of forty characters, or nearly"
    marks = ["00:00 hello", "[00:04.5] yes", "0m09s well", "no mark", "(0:50) bye"]
    turn = lambda text, t: ("agent", text, t, None)
    rows = [
        ("long", [turn(says, t) for t in long]),
        ("pace", [turn(says, t * 1000) for t in short]),
        ("marks", [turn(m, t * 1000) for m, t in zip(marks, short, strict=True)]),
        ("seconds", [turn(m, t) for m, t in zip(marks, short, strict=True)]),
        ("odd", [turn(says, float("nan")), turn(says, float("inf")), turn("", 3.0), turn(None, 5.0)]),
        ("none", None),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "calls.parquet"))
    got: dict = {}
    for r in queries.interval_attribution(spark, str(tmp_path)).collect():
        got.setdefault(r.call_id, {})[r.a_id, r.b_id] = r.shared
    assert got == {"long": shared(long), "pace": shared(short), "marks": shared(short), "seconds": shared(short), "odd": shared([None, None, 3.0, 5.0])}
