"""One table from files whose schemas drift, and a log of every change.

Each file's schema is read from its own records in one parallel pass: which fields
hold values, of which types, and a summary of all values as they are written: how many
are numbers, whole numbers or times, the largest, and sketches of the values and of
their shapes, which keep those with the smallest hashes and so do not depend on order.
Consecutive files of a feed are compared on these headers alone. Types are folded
through a promotion lattice, names through the renames that were found, and all
records are cast to the union schema.

Defined results: unreadable records (cut-off lines, no object) are left out of the
headers and kept, with their text, in a quarantine; a field that only holds null is
not there; a value that does not fit the field's type becomes null in the table, its
text stays in ``unfit``; ties between types go to the wider one; empty input gives
empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import cut

#: Types in order of width; a promotion goes to the first type at or above both.
LATTICE = ("boolean", "number", "string", "array", "object")
#: Likeness of names and of values from which a field that went and one that came are the same.
SAME_NAME, SAME_VALUES, CERTAIN_VALUES = 0.5, 0.5, 0.9
#: Distinct values up to which a field counts as a list of codes, which may be recoded as a whole.
CODES = 12
#: Columns that the driver may plan for; headers with more distinct fields are refused, not cut.
MOST_FIELDS = 10_000


def kind_of(value: object) -> str | None:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        return "array"
    return "object" if isinstance(value, dict) else None


def promote(a: str | None, b: str | None) -> str | None:
    """Least type that holds both: scalars meet in string, an array takes scalars in, object and another in string."""
    if a is None or b is None or a == b:
        return a or b
    if "object" in (a, b):
        return "string"
    return "array" if "array" in (a, b) else "string"


def _values(record: dict, nested: str) -> Iterator[tuple[str, object]]:
    for name, value in record.items():
        yield name, value
        if name == nested and isinstance(value, list):
            for turn in value:
                if isinstance(turn, dict):
                    for inner, v in turn.items():
                        yield f"{nested}.{inner}", v


def _scalars(value: object) -> list[str]:
    """A value as comparable texts, whatever type it was written in."""
    if isinstance(value, list):
        return [s for v in value for s in _scalars(v)]
    if isinstance(value, dict):
        return [s for v in value.values() for s in _scalars(v)]
    if isinstance(value, bool):
        return [str(value).lower()]
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return [s for s in (p.strip() for p in str(value).split(",")) if s] or [""]


def read_record(payload: str | None) -> dict | None:
    try:
        record = json.loads(payload) if payload else None
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


#: Hashes that a sketch keeps; with fewer distinct values it holds them all.
SKETCH = 256
#: Fields whose summaries a task holds before it hands them on.
HELD_FIELDS = 20_000


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _smallest(sketch: dict[int, int]) -> dict[int, int]:
    return sketch if len(sketch) <= SKETCH else {h: sketch[h] for h in sorted(sketch)[:SKETCH]}


@dataclass
class Summary:
    """All written values of a field in a file; empty ones are counted as ``blank`` alone."""

    n: int = 0
    blank: int = 0
    times: int = 0
    numbers: int = 0
    whole: int = 0
    top: float = 0.0
    values: dict[int, int] = field(default_factory=dict)
    shapes: dict[int, int] = field(default_factory=dict)

    def add(self, written: Counter) -> Summary:
        values, shapes = Counter(self.values), Counter(self.shapes)
        for v, n in written.items():
            if not v:
                self.blank += n
                continue
            is_time, number, h, shape = _known_value(v) if len(v) < 64 else _looked_at(v)
            self.n += n
            self.times += n * is_time
            if number is not None:
                self.numbers += n
                self.whole += n * number.is_integer()
                self.top = max(self.top, abs(number))
            values[h] += n
            shapes[shape] += n
        self.values, self.shapes = _smallest(values), _smallest(shapes)
        return self

    def merge(self, other: Summary) -> Summary:
        # A hash among the smallest of the whole is among the smallest of each part that has it, so its count is complete.
        return Summary(
            self.n + other.n, self.blank + other.blank, self.times + other.times, self.numbers + other.numbers, self.whole + other.whole, max(self.top, other.top),
            _smallest(Counter(self.values) + Counter(other.values)), _smallest(Counter(self.shapes) + Counter(other.shapes)),
        )


#: Sketches travel as pairs of 8-byte numbers, which cost far less to read than maps.
_SUMMARY = pa.struct([("n", pa.int64()), ("blank", pa.int64()), ("times", pa.int64()), ("numbers", pa.int64()), ("whole", pa.int64()), ("top", pa.float64()), ("values", pa.binary()), ("shapes", pa.binary())])
_SUMMARY_SQL = "struct<n: bigint, blank: bigint, times: bigint, numbers: bigint, whole: bigint, top: double, values: binary, shapes: binary>"


def _written(summary: Summary) -> dict:
    return vars(summary) | {k: array("q", chain.from_iterable(sorted(getattr(summary, k).items()))).tobytes() for k in ("values", "shapes")}


def _pairs(packed: bytes) -> dict[int, int]:
    flat = memoryview(packed).cast("q").tolist()
    return dict(zip(flat[::2], flat[1::2], strict=True))


def _read(row: dict | Summary) -> Summary:
    return row if isinstance(row, Summary) else Summary(**{**row, "values": _pairs(row["values"]), "shapes": _pairs(row["shapes"])})


def summary_of(values: list[str]) -> Summary:
    return Summary().add(Counter(values))


def file_headers(feed: DataFrame, *, nested: str = "turns") -> DataFrame:
    """(feed_name, file_no, field_path, summary, kind, n): the schema of each file.

    Partial headers are made where the records lie, one for each field of a file in a
    task, then merged by file and field, so a feed that holds a third of the records
    is no hot group.
    """
    rows = feed.select("feed_name", "file_no", "payload")
    names = ["feed_name", "file_no", "field_path", *LATTICE, "summary"]

    def emit(kinds: dict[tuple, Counter], summaries: dict[tuple, Summary], readable: Counter) -> pa.RecordBatch:
        # The path "" stands for the file itself, so that files without any field still take their place.
        every = [*((k, c) for k, c in kinds.items()), *(((*f, ""), Counter(object=n)) for f, n in readable.items())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k, _ in every], pa.string()),
                pa.array([k[1] for k, _ in every], pa.int32()),
                pa.array([k[2] for k, _ in every], pa.string()),
                *(pa.array([c[kind] for _, c in every], pa.int64()) for kind in LATTICE),
                pa.array([_written(summaries.get(k) or Summary()) for k, _ in every], _SUMMARY),
            ],
            names,
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[tuple, Counter] = defaultdict(Counter)
        summaries: dict[tuple, Summary] = defaultdict(Summary)
        readable: Counter = Counter()
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                seen: dict[tuple, Counter] = defaultdict(Counter)
                for name, no, payload in zip(*(c.to_pylist() for c in whole.slice(start, 2000).columns), strict=True):
                    record = read_record(payload)
                    readable[name, no] += record is not None
                    if record is None:
                        continue
                    for path, value in _values(record, nested):
                        if (kind := kind_of(value)) is not None:
                            kinds[name, no, path][kind] += 1
                            seen[name, no, path].update(_scalars(value))
                for at, written in seen.items():
                    summaries[at].add(written)
                if len(summaries) > HELD_FIELDS:
                    yield emit(kinds, summaries, readable)
                    kinds.clear(), summaries.clear(), readable.clear()
        yield emit(kinds, summaries, readable)

    counts = ", ".join(f"`{k}` bigint" for k in LATTICE)
    partial = rows.mapInArrow(scan, f"feed_name string, file_no int, field_path string, {counts}, summary {_SUMMARY_SQL}")
    parts = partial.groupBy("feed_name", "file_no", "field_path").agg(*(F.sum(k).alias(k) for k in LATTICE), F.collect_list("summary").alias("parts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_written(reduce(Summary.merge, map(_read, p))) for p in b.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, _SUMMARY)], names)

    merged = parts.mapInArrow(merge, f"feed_name string, file_no int, field_path string, {counts}, summary {_SUMMARY_SQL}")
    most = F.greatest(*LATTICE)
    # Most values decide; with a tie the wider type, which is the later one.
    kind = F.coalesce(*(F.when(F.col(k) == most, F.lit(k)) for k in reversed(LATTICE)))
    return merged.withColumn("kind", kind).withColumn("n", sum(F.col(k) for k in LATTICE)).drop(*LATTICE)


_TIME = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d|1[0-9]{9}(?:[0-9]{3})?(?:\.\d+)?$")
_NUMBER = re.compile(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?$")


def _shape(value: str) -> str:
    """A written value with runs of letters and of digits made alike; long hexadecimal strings are one kind."""
    if _HEX.fullmatch(value):
        return f"hex{len(value)}"
    # Bytes: beyond ASCII everything counts as a letter.
    return _RUNS.sub(lambda m: m[0][:1], value.encode("utf-8", "replace").translate(_CLASSES)).decode()


_HEX, _RUNS = re.compile(r"[0-9a-f]{16,}"), re.compile(rb"a{2,}|9{2,}")
_CLASSES = bytes(ord("9") if chr(b).isdigit() and b < 128 else ord("a") if b > 127 or chr(b).isalpha() else b for b in range(256))


def _looked_at(value: str) -> tuple[bool, float | None, int, int]:
    """Whether it is a time, the number that it is, and the hashes of the value and of its shape."""
    return bool(_TIME.match(value)), float(value) if _NUMBER.match(value) else None, _hash(value), _shape_hash(_shape(value))


_known_value = lru_cache(maxsize=200_000)(_looked_at)
_shape_hash = lru_cache(maxsize=20_000)(_hash)
_PLAIN_SHAPES = frozenset(map(_hash, ("a", "a a")))


def _comparable(x: dict[int, int], y: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """Two sketches below the hash up to which both are complete."""
    last = min((max(s) for s in (x, y) if len(s) >= SKETCH), default=None)
    return (x, y) if last is None else ({h: n for h, n in x.items() if h <= last}, {h: n for h, n in y.items() if h <= last})


def value_likeness(a: Summary, b: Summary) -> tuple[float, bool]:
    """How far two summaries look like values of one field, and whether such values tell fields apart."""
    if not a.n or not b.n:
        return 0.0, False
    if a.times > 0.8 * a.n and b.times > 0.8 * b.n:
        return 1.0, True
    na, nb = a.numbers / a.n, b.numbers / b.n
    if min(na, nb) > 0.8:
        whole = abs(a.whole / a.numbers - b.whole / b.numbers)
        return (1 - whole) * (min(a.top, b.top) + 1e-9) / (max(a.top, b.top) + 1e-9), False
    if max(na, nb) > 0.8:
        return 0.0, False
    x, y = _comparable(a.values, b.values)
    shared = len(x.keys() & y.keys()) / max(1, min(len(x), len(y)))
    sx, sy = _comparable(a.shapes, b.shapes)
    held = max(sum(sx.values()) / a.n, sum(sy.values()) / b.n, 1e-9) if (len(sx), len(sy)) != (len(a.shapes), len(b.shapes)) or max(len(sx), len(sy)) >= SKETCH else 1.0
    alike = sum(min(sx[k] / a.n, sy[k] / b.n) for k in sx.keys() & sy.keys() if k not in _PLAIN_SHAPES) / held
    return max(shared, min(1.0, alike)), True


def _name_words(path: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", path.rpartition(".")[2])]


def _same_word(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    shared = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if shared == len(a) or shared >= 3 and shared >= len(a) - 1 or shared >= 4:
        return True
    rest = iter(b)
    return len(a) <= 3 and a[0] == b[0] and all(c in rest for c in a)


def name_likeness(a: str, b: str) -> float:
    """Share of the shorter name's words that the other has too, in full or abbreviated."""
    if a.rpartition(".")[0] != b.rpartition(".")[0]:
        return -1.0
    x, y = sorted((_name_words(a), _name_words(b)), key=len)
    return sum(any(_same_word(v, w) for w in y) for v in x) / max(1, len(x))


def same_fields(links: list[tuple[str, str]]) -> dict[str, str]:
    """One name for all paths that renames connect."""
    parent: dict[str, str] = {}

    def root(p: str) -> str:
        while parent.setdefault(p, p) != p:
            p = parent[p]
        return p

    for a, b in links:
        parent[root(a)] = root(b)
    return {p: root(p) for p in parent}


def compare_headers(old: dict[str, tuple[str, Summary]], new: dict[str, tuple[str, Summary]], known: dict[str, str] | None = None) -> list[tuple[str, str, str, str | None, str | None]]:
    """(change_kind, field_path, new_path, old type, new type) of one file against the one before, in order of the paths.

    ``known`` names paths that other files have shown to be one field.
    """
    known = known or {}
    # Most fields stay; only the values of those that go or come are looked at.
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    of_old, of_new = {g: _read(old[g][1]) for g in gone}, {c: _read(new[c][1]) for c in come}
    scored = []
    for g in gone:
        for c in come:
            n = 1.0 if g in known and known[g] == known.get(c) else name_likeness(g, c)
            v, telling = value_likeness(of_old[g], of_new[c])
            codes = max(len(of_old[g].values), len(of_new[c].values)) <= CODES and "array" not in (old[g][0], new[c][0])
            # Known by both; by values that nothing else has; or a list of codes recoded under nearly the same name.
            if n >= SAME_NAME and v >= SAME_VALUES or n >= 0 and telling and v >= CERTAIN_VALUES or n >= 1 and v == 0 and codes:
                scored.append((-(n + v), g, c))
    changes, used = [], set()
    for _, g, c in sorted(scored):
        if g in used or c in used:
            continue
        used |= {g, c}
        changes.append(("renamed", g, c, old[g][0], new[c][0]))
        if old[g][0] != new[c][0]:
            changes.append(("retyped", c, "", old[g][0], new[c][0]))
    changes += [("removed", g, "", old[g][0], None) for g in gone if g not in used]
    changes += [("added", c, "", None, new[c][0]) for c in come if c not in used]
    changes += [("retyped", p, "", old[p][0], new[p][0]) for p in old.keys() & new.keys() if old[p][0] != new[p][0]]
    return sorted(changes, key=lambda x: (x[1], x[0]))


def file_changes(headers: DataFrame) -> DataFrame:
    """Every difference of a file from the file numbered one less in its feed.

    Two passes over the headers: names that the first finds to be one field anywhere
    are known as such in the second, where a rename skips the name in common.
    """
    one = F.collect_list(F.struct("field_path", "kind", "summary"))
    files = cut(headers.groupBy("feed_name", "file_no").agg(one.alias("fields")))
    before = files.select("feed_name", (F.col("file_no") + 1).alias("file_no"), F.col("fields").alias("old"))
    pairs = files.join(before, ["feed_name", "file_no"]).select("feed_name", "file_no", "fields", "old")

    def comparing(known: dict[str, str]) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = lambda fields: {f["field_path"]: (f["kind"], f["summary"]) for f in fields if f["field_path"]}
            for b in batches:
                rows = []
                for name, no, new, old in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    rows += [(name, no, k, *c) for k, c in enumerate(compare_headers(read(old), read(new), known), 1)]
                cols = list(zip(*rows, strict=True)) or [()] * 8
                kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                    ["feed_name", "file_no", "change_no", "change_kind", "field_path", "new_path", "old_type", "new_type"],
                )

        return pairs.mapInArrow(compare, "feed_name string, file_no int, change_no int, change_kind string, field_path string, new_path string, old_type string, new_type string")

    links = comparing({}).filter("change_kind = 'renamed'").select("field_path", "new_path").distinct().limit(MOST_FIELDS + 1).collect()
    if len(links) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} distinct renames")
    return comparing(same_fields([(r[0], r[1]) for r in links if name_likeness(r[0], r[1]) >= SAME_NAME]))


def union_schema(headers: DataFrame, changes: DataFrame, preferred: tuple[str, ...] = ()) -> tuple[dict[str, str], dict[str, str]]:
    """(canonical name of every path, type of every canonical name).

    Paths that renames connect are one field, named as in ``preferred`` or else by
    the name in most files. Only distinct names come to the driver, whose number
    the schemas bound; beyond MOST_FIELDS this refuses.
    """
    kind = [F.count_if(F.col("kind") == k).alias(k) for k in LATTICE]
    numeric = F.bool_and((F.col("summary.numbers") == F.col("summary.n")) & (F.col("summary.blank") == 0))
    seen = headers.filter("field_path <> ''").groupBy("field_path").agg(F.count(F.lit(1)).alias("files"), numeric.alias("numeric"), *kind).limit(MOST_FIELDS + 1).collect()
    if len(seen) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} distinct fields")
    links = changes.filter("change_kind = 'renamed'").select("field_path", "new_path").distinct().limit(MOST_FIELDS + 1).collect()
    if len(links) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} distinct renames")
    root = same_fields([(a, b) for a, b in links])
    groups: dict[str, list] = defaultdict(list)
    for r in seen:
        groups[root.get(r["field_path"], r["field_path"])].append(r)
    names, types = {}, {}
    for rows in groups.values():
        best = max(rows, key=lambda r: (r["field_path"] in preferred, r["files"], r["field_path"]))["field_path"]
        folded = None
        for k in LATTICE:
            if any(r[k] for r in rows):
                folded = promote(folded, k)
        # Numbers written as text meet numbers in number.
        types[best] = "number" if folded in ("string", "number") and all(r["numeric"] for r in rows) else folded
        names |= {r["field_path"]: best for r in rows}
    return names, types


def consistent_table(feed: DataFrame, names: dict[str, str], types: dict[str, str], *, nested: str = "turns") -> DataFrame:
    """All readable records under the union schema, one row each, with the texts that did not fit.

    Numbers are double, arrays of scalars array<string>, objects their JSON text.
    ``unfit`` maps a field to the JSON of a value that its type cannot hold.
    """
    spark_type = {"boolean": "boolean", "number": "double", "string": "string", "array": "array<string>", "object": "string"}
    arrow_type = {"boolean": pa.bool_(), "number": pa.float64(), "string": pa.string(), "array": pa.list_(pa.string()), "object": pa.string()}
    flat = sorted(n for n in types if "." not in n and n != nested)
    inner = sorted(n.partition(".")[2] for n in types if n.startswith(f"{nested}."))

    def fit(value: object, kind: str) -> tuple[object, bool]:
        if value is None:
            return None, True
        if kind == "array":
            return [s if isinstance(s, str) else json.dumps(s) for s in value] if isinstance(value, list) else _scalars(value), True
        if kind == "number" and not isinstance(value, (list, dict, bool)):
            try:
                return float(value), True
            except ValueError:
                return None, False
        if kind == "boolean":
            return (value, True) if isinstance(value, bool) else (None, False)
        if kind in ("string", "object"):
            return value if isinstance(value, str) else json.dumps(value, sort_keys=True), True
        return None, False

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([(n, arrow_type[types[f"{nested}.{n}"]]) for n in inner])
        for b in batches:
            keys, columns, turns, unfit = [], {n: [] for n in flat}, [], []
            for *key, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (record := read_record(payload)) is None:
                    continue
                keys.append(key)
                wrong: dict[str, str] = {}
                row = {}
                for path, value in record.items():
                    name = names.get(path)
                    if name in columns and row.get(name) is None:
                        row[name], ok = fit(value, types[name])
                        if not ok:
                            wrong[name] = json.dumps(value)
                for n in flat:
                    columns[n].append(row.get(n))
                of = []
                for t in record.get(nested) or () if isinstance(record.get(nested), list) else ():
                    turn = dict.fromkeys(inner)
                    for path, value in t.items() if isinstance(t, dict) else ():
                        name = names.get(f"{nested}.{path}", "").partition(".")[2]
                        if name in turn and turn[name] is None:
                            turn[name], ok = fit(value, types[f"{nested}.{name}"])
                            if not ok:
                                wrong[f"{nested}.{name}"] = json.dumps(value)
                    of.append(turn)
                turns.append(of)
                unfit.append(list(wrong.items()))
            parts = [pa.array([k[i] for k in keys], b.schema.field(i).type) for i in range(3)]
            parts += [pa.array(columns[n], arrow_type[types[n]]) for n in flat]
            if inner:
                parts.append(pa.array(turns, pa.list_(struct)))
            parts.append(pa.array(unfit, pa.map_(pa.string(), pa.string())))
            yield pa.RecordBatch.from_arrays(parts, ["feed_name", "file_no", "line_no", *flat, *([nested] if inner else []), "unfit"])

    turn_type = ", ".join(f"`{n}`: {spark_type[types[f'{nested}.{n}']]}" for n in inner)
    schema = ["feed_name string, file_no int, line_no int", *(f"`{n}` {spark_type[types[n]]}" for n in flat)]
    schema += [f"`{nested}` array<struct<{turn_type}>>"] if inner else []
    rows = feed.select("feed_name", F.col("file_no").cast("int").alias("file_no"), F.col("line_no").cast("int").alias("line_no"), "payload")
    return rows.mapInArrow(cast, ", ".join([*schema, "unfit map<string,string>"]))


def quarantine(feed: DataFrame) -> DataFrame:
    """The records that no reader can read, as they came."""
    return feed.filter(F.try_parse_json("payload").isNull() | ~F.ltrim("payload").startswith("{")).select("feed_name", "file_no", "line_no", "payload")
