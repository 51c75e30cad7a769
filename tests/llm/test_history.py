import random

from voxloom.llm import history
from voxloom.llm.wording import spoken_words

SCHEMA = "segment_id string, customer_id string, timestamp string, text string, batch_no int, doc string, words string"
VOCABULARY = [f"w{i}" for i in range(300)]


def words(rng, n=60):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def changed(rng, ws, share):
    out = list(ws)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"x{rng.randrange(10**6)}"
    return out


def run(spark, old, new):
    pad = lambda rows: [(*r, "d", "w") for r in rows]
    a = spark.createDataFrame(pad([(*r, None) for r in old]), SCHEMA).drop("batch_no")
    b = spark.createDataFrame(pad(new), SCHEMA)
    return {tuple(r) for r in history.repeated_segments(a, b).collect()}


def brute(old, new):
    accepted, out = {}, set()
    for r in {r[0]: r for r in old}.values():
        if None not in (r[0], r[1], r[3]):
            accepted.setdefault(r[1], []).append((r[0], r[3]))
    for r in sorted((r for r in new if None not in (r[0], r[1], r[3])), key=lambda r: (r[4], r[2], r[0])):
        mine, hit, seen = spoken_words(r[3]), [], []
        for sid, text in accepted.get(r[1], []):
            other = spoken_words(text)
            n = max(len(mine), len(other))
            if text == r[3] or n and history.common_in_order(mine, other) >= history.SAME * n:
                if other not in seen:
                    hit.append(sid)
                    seen.append(other)
        if hit:
            out |= {(r[0], h) for h in hit if h != r[0]}
        else:
            accepted.setdefault(r[1], []).append((r[0], r[3]))
    return out


def test_common_in_order_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert history.common_in_order(a, b) == table[-1][-1]


def test_against_brute_force(spark):
    rng = random.Random(2)
    old, new = [], []
    for i in range(60):
        old.append((f"S{i:03d}", f"U{i % 3}", "2026-03-01T00:00:00Z", " ".join(words(rng))))
    for i in range(120):
        base = rng.choice(old + new)
        text = base[3].split()
        kind = i % 6
        if kind == 0:
            text = words(rng)
        elif kind == 1:
            text = changed(rng, text, 0.1)
        elif kind == 2:
            text = text[:25] + words(rng, 35)  # only opens alike
        elif kind == 3:
            text = [w.upper() for w in text]
        customer = "U9" if kind == 4 else base[1]  # another customer's text is no case
        new.append((f"N{i:03d}", customer, f"2026-03-{2 + i % 20:02d}T00:00:00+0{i % 3}:00", " ".join(text), 1 + i % 5))
    new = [(*r[:2], r[2][:19] + "Z", *r[3:]) for r in new]
    assert run(spark, old, new) == brute(old, new)


def test_recall_of_the_least_similar_repeats(spark):
    """Every fifth word changed at random: what a search by the widest prefix finds, against all such pairs."""
    rng = random.Random(3)
    old, new = [], []
    for i in range(150):
        ws = words(rng, 100)
        old.append((f"S{i:03d}", "U", "2026-03-01T00:00:00Z", " ".join(ws)))
        new.append((f"N{i:03d}", "U", "2026-03-02T00:00:00Z", " ".join(changed(rng, ws, 0.19)), 1))
    want = brute(old, new)
    assert len(want) > 140 and len(run(spark, old, new) & want) >= 0.9 * len(want)


def test_chain_and_order(spark):
    rng = random.Random(4)
    a = words(rng, 100)
    b, c = changed(rng, a, 0.15), None
    c = changed(rng, b, 0.15)
    rows = [("N1", "U", "2026-03-03T00:00:00Z", " ".join(c), 2), ("N2", "U", "2026-03-01T00:00:00Z", " ".join(a), 1), ("N3", "U", "2026-03-02T00:00:00Z", " ".join(b), 1), ("N4", "U", "2026-03-09T00:00:00Z", " ".join(c), 2)]
    assert run(spark, [], rows) == brute([], rows)


def test_hot_group_of_near_copies_is_a_star(spark):
    rng = random.Random(5)
    base = words(rng, 80)
    new = [(f"N{i:03d}", "U", "2026-03-02T00:00:00Z", " ".join(changed(rng, base, 0.03)), 1) for i in range(150)]
    got = run(spark, [("S1", "U", "2026-03-01T00:00:00Z", " ".join(base))], new)
    assert got == {(r[0], "S1") for r in new}


def test_nulls_empties_repeats(spark):
    old = [("S1", "U", None, ""), ("S1", "U", None, ""), ("S2", None, "bad", "a b c"), ("S3", "U", "x", None), ("S4", "U", "2026-01-01T00:00:00Z", "!!! ???")]
    new = [("N1", "U", "2026-03-01T00:00:00Z", "", 1), ("N1", "U", "2026-03-01T00:00:00Z", "", 1), ("N2", "U", None, None, 1), ("N3", None, None, "a b c", 1), ("N4", "U", None, "!!! ???", 2), ("N5", "U", None, "???", None), ("N6", "U", None, "word " * 50_000, 3), ("N7", "U", None, "word " * 50_000, 4)]
    assert run(spark, old, new) == {("N1", "S1"), ("N4", "S4"), ("N7", "N6")}
    assert run(spark, [], []) == set()


def frames(spark, old, new):
    pad = lambda rows: [(*r, "d", "w") for r in rows]
    return spark.createDataFrame(pad([(*r, None) for r in old]), SCHEMA).drop("batch_no"), spark.createDataFrame(pad(new), SCHEMA)


def drift_of(rng, old, n, batch):
    out = []
    for i in range(n):
        base = rng.choice(old)
        text = " ".join(changed(rng, base[3].split(), 0.1)) if i % 2 else " ".join(words(rng))
        out.append((f"B{batch}-{i:03d}", base[1], f"2026-04-{batch:02d}T00:00:00Z", text, 1))
    return out


def test_batch_after_batch_reads_runs_only(spark, tmp_path):
    """Two batches in turn, over extended, merged and reopened runs, equal one brute-force pass; no raw history is read."""
    rng = random.Random(7)
    old = [(f"S{i:03d}", f"U{i % 3}", "2026-03-01T00:00:00Z", " ".join(words(rng))) for i in range(60)]
    one = drift_of(rng, old, 40, 1)
    two = [(*r[:4], 2) for r in drift_of(rng, old + one, 40, 2)]
    raw = tmp_path / "raw.parquet"
    frames(spark, old, one)[0].write.parquet(str(raw))
    run = history.build_run(spark.read.parquet(str(raw)), str(tmp_path / "run"))
    for f in raw.glob("*"):
        f.unlink()
    first = history.check_batch(frames(spark, [], one)[1], run)
    added = history.extended(first, str(tmp_path / "added"))
    merged = history.merge_runs(run, added, place=str(tmp_path / "merged"))
    want = brute(old, one + two)
    assert {tuple(r) for r in first.found.collect()} == {p for p in want if p[0].startswith("B1")}
    later = {p for p in want if p[0].startswith("B2")}
    batch = frames(spark, [], two)[1]
    for runs in ((run, added), (history.open_run(spark, merged.place),)):
        assert {tuple(r) for r in history.check_batch(batch, *runs).found.collect()} == later and later


def test_forest_is_sorted_bucketed_and_not_exchanged(spark):
    rng = random.Random(8)
    old, new = frames(spark, [(f"S{i}", "U", "2026-03-01T00:00:00Z", " ".join(words(rng))) for i in range(50)], [("N", "U", None, "a b", 1)])
    run = history.build_run(old)
    met = history.lookup(history.signed(history._numbered(new, history.F.lit(1)), run.next_doc).heads, run, history.REACH)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = met._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    forest = next(i for i, line in enumerate(lines) if "forest_" in line)
    before = next(i for i in range(forest - 1, 0, -1) if "Scan" in lines[i])
    # From the forest up to the join nothing is exchanged.
    assert run.forest.count() == 50 * history.TREES and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert not any("Exchange" in line for line in lines[before + 1 : forest])
    files = [spark.read.parquet(f).collect() for f in run.forest.inputFiles()]
    for rows in files:
        assert [(r.slot, r.code) for r in rows] == sorted((r.slot, r.code) for r in rows)
    assert len(files) == len({r.slot for rows in files for r in rows} and files) and not {r.slot for r in files[0]} & {r.slot for f in files[1:] for r in f}


def test_hot_ranges_are_spread_and_still_found(spark, monkeypatch):
    rng = random.Random(9)
    base = words(rng, 80)
    old = [(f"S{i:03d}", "U", "2026-03-01T00:00:00Z", " ".join(changed(rng, base, 0.02))) for i in range(150)]
    new = [("N1", "U", "2026-03-09T00:00:00Z", " ".join(changed(rng, base, 0.02)), 1)]
    a, b = frames(spark, old, new)
    run = history.build_run(a)
    assert run.hot and run.forest.select("slot").distinct().count() > len(run.hot) * 4
    assert {tuple(r) for r in history.check_batch(b, run).found.collect()} == brute(old, new)
    assert len(brute(old, new)) == 150


def test_three_near_copies_each_are_all_named(spark):
    rng = random.Random(10)
    old, new = [], []
    for i in range(100):
        base = words(rng, 80)
        old += [(f"S{i:03d}{k}", "U", f"2026-03-0{k + 1}T00:00:00Z", " ".join(changed(rng, base, 0.04))) for k in range(3)]
        new.append((f"N{i:03d}", "U", "2026-03-09T00:00:00Z", " ".join(changed(rng, base, 0.04)), 1))
    want = brute(old, new)
    assert len(want) == 300 and run(spark, old, new) == want


def test_search_reaches_95_of_100_least_similar_repeats():
    s, d = history.pair_similarity(), history.REACH
    assert history.widening() == list(range(history.DEPTH, d - 1, -1))
    assert 1 - (1 - s**d) ** history.TREES >= history.RECALL >= 0.95


def test_all_accepted_partners_are_named_after_the_first_search(spark):
    """Near-copies in history: the first search meets the earliest of each range, the later ones count too."""
    rng = random.Random(6)
    base = words(rng, 80)
    old = [(f"S{i}", "U", f"2026-03-0{i + 1}T00:00:00Z", " ".join(changed(rng, base, 0.02))) for i in range(4)]
    new = [("N1", "U", "2026-03-09T00:00:00Z", " ".join(changed(rng, base, 0.02)), 1)]
    assert run(spark, old, new) == brute(old, new) == {("N1", f"S{i}") for i in range(4)}
