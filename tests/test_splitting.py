"""CSV and JSON files read by many tasks, beside Python's own readers."""

import csv
import io
import json
import os
import random

import pytest

from usagelens.sources import chat_exports, generic, splitting


@pytest.fixture(scope="module")
def small(spark):
    """A session whose splits hold a few lines only."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "300")
    own.conf.set("spark.sql.files.openCostInBytes", "64")
    return own


def put(path, text):
    with open(path, "w", newline="", encoding="utf-8") as out:
        out.write(text)
    return str(path)


CSV_PARTS = ["a", "b,c", '"', '""', 'x"y', "\n", "\r\n", '"\n', "\n\n", "é", ",", "1", ""]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_csv_against_the_csv_module(small, tmp_path, seed):
    rng = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n" if seed < 3 else "\r\n", quoting=csv.QUOTE_ALL if seed == 2 else csv.QUOTE_MINIMAL)
    writer.writerows([["p", "q", "r"]] + [["".join(rng.choice(CSV_PARTS) for _ in range(rng.randint(0, 6))) for _ in range(3)] for _ in range(300)])
    raw = out.getvalue() + '\n1,x"y,2\n"closed"tail,3,4\n\n5,"a""b",' + "\n" * (seed % 2)  # quotes amid fields, empty lines, with and without an end
    path = put(tmp_path / "t.csv", raw)
    wanted = [r for r in csv.reader(io.StringIO(raw, newline="")) if r]
    got = splitting.csv_records(small, path).orderBy("record").collect()
    assert [r.record for r in got] == list(range(len(wanted))) and len({r.block for r in got}) > 10 and [r.last for r in got].index(True) == len(got) - 1
    assert [next(csv.reader(io.StringIO(r.text, newline=""))) for r in got] == wanted
    docs = generic.read_csv_documents(small, path).collect()
    content = {json.loads(d.metadata)["row"]: json.loads(d.content) for d in docs}
    plain = {n: dict(zip("pqr", r)) for n, r in enumerate(wanted[1:]) if not any('"' in f and r[0] == "closed" for f in r)}
    assert {n: c for n, c in content.items() if n in plain and c["p"] != '"closed"tail' and plain[n]["p"] != "closedtail"} == {
        n: c for n, c in plain.items() if c["p"] != "closedtail"}


def test_a_record_over_many_splits(small, tmp_path):
    long = "\n".join(f"line {i}, \"\"quoted\"\"" for i in range(400))
    path = put(tmp_path / "t.csv", f'a,b\n1,"{long}"\n2,x\n')
    got = splitting.csv_records(small, path).orderBy("record").collect()
    assert [r.text for r in got] == ["a,b", f'1,"{long}"', "2,x"]
    assert [json.loads(r.row) for r in generic.csv_to_json(small, path).orderBy("row").collect()] == [{"a": "1", "b": long.replace('""', '"')}, {"a": "2", "b": "x"}]


def test_several_csv_files_and_odd_widths(small, tmp_path):
    for n in range(3):
        put(tmp_path / f"{n}.csv", "x,y\n" + "".join(f'{n}{i},"v\n{i}"\n' for i in range(50)) + "only\n1,2,3\n")
    rows = [json.loads(r.row) for r in generic.csv_to_json(small, str(tmp_path)).collect()]
    assert sorted(r["x"] for r in rows) == sorted(f"{n}{i}" for n in range(3) for i in range(50)) and all(r["y"].startswith("v\n") for r in rows)
    numbers = [json.loads(r.metadata) for r in generic.read_csv_documents(small, str(tmp_path)).collect()]
    assert sorted((m["filename"], m["row"]) for m in numbers) == [(f"{n}.csv", i) for n in range(3) for i in range(52)]


def test_csv_without_rows(small, tmp_path):
    path = put(tmp_path / "t.csv", "a,b\n")
    assert generic.read_csv_documents(small, path).collect() == [] and [r.text for r in splitting.csv_records(small, path).collect()] == ["a,b"]


def value(rng, depth=0):
    k = rng.random()
    if k < 0.3 or depth > 3:
        return rng.choice(["a},b", "},{", '"q"', "\\", "]", "[{", "\\\"},", 1, None, True, "é\n"])
    if k < 0.7:
        return {str(i): value(rng, depth + 1) for i in range(rng.randint(0, 4))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


@pytest.mark.parametrize("seed", [1, 2])
def test_json_against_the_json_module(small, tmp_path, seed):
    rng = random.Random(seed)
    files = {}
    for n in range(12):
        v = [value(rng) for _ in range(rng.choice([0, 1, 5, 60]))] if n % 3 else {"o": value(rng), "p": [value(rng) for _ in range(20)]}
        text = json.dumps(v, ensure_ascii=bool(n % 2), indent=(None, 1, 2)[n % 3], separators=((",", ":"), (" , ", ": "), (", ", ": "))[n // 3 % 3])
        files[f"f{n}.json"] = v if isinstance(v, list) else [v]
        put(tmp_path / f"f{n}.json", ("\n " if n % 2 else "") + text + ("\n" if n % 4 else ""))
    for name, text in (("bad1", '[{"a":1},{"b":2}'), ("bad2", '[{"a":1},{"b":},{"c":3}]'), ("bad3", "nope"), ("bad4", ""), ("bad5", "[" + '{"a":1},' * 90 + "{]")):
        put(tmp_path / f"{name}.json", text)
    got = {}
    items = splitting.json_items(small, str(tmp_path), "VARIANT").selectExpr("path", "index AS place", "to_json(item) AS j")
    for r in sorted(items.collect(), key=lambda r: r.place):
        got.setdefault(os.path.basename(r.path), []).append((r.place, json.loads(r.j)))
    assert got == {name: list(enumerate(v)) for name, v in files.items() if v}
    assert splitting.json_groups(small, str(tmp_path)).select("path", "block").distinct().count() > 20


def test_conversation_arrays_over_splits(small, tmp_path):
    talk = [{"conversation_hash": f"h{n}", "conversation": [{"role": "user", "content": f"say }}, {n}"}, {"role": "assistant", "content": "no"}]} for n in range(40)]
    put(tmp_path / "a.json", json.dumps(talk))
    put(tmp_path / "b.json", json.dumps([{"x": 1}, *talk]))  # another kind of array
    put(tmp_path / "c.json", json.dumps(talk)[:-1])  # broken
    got = chat_exports.read_export_folder(small, str(tmp_path)).collect()
    assert len(got) == 80 and {os.path.basename(r.source_file) for r in got} == {"a.json"}
    assert {r.user_text for r in got if r.author == "user"} == {f"say }}, {n}" for n in range(40)}
