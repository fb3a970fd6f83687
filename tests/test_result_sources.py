"""Large JSON documents by their two ends, and members of zip archives."""

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scorewright.sources import files, results


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return {rng.choice(["a", 'b"', "c\\", "d,{", "é]"]) + str(i): random_value(rng, depth + 1) for i in range(rng.randrange(4))}
    return rng.choice([1, -2.5e3, True, None, "", 'q"uote', "back\\slash", "}{][,:", "\\\\", "tail\\\"", "é東"])


def lookup(body, path):
    for key in path:
        body = body.get(key) if isinstance(body, dict) else None
    return body


def members(body, path=()):
    for key, value in body.items():
        yield (*path, key), value
        if isinstance(value, dict):
            yield from members(value, (*path, key))


def test_heads_and_tails_hold_only_what_is_there():
    rng = random.Random(4)
    for _ in range(300):
        body = {f"k{i}": random_value(rng) for i in range(rng.randrange(1, 8))}
        text = json.dumps(body, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        for _ in range(8):
            cut = rng.randrange(len(text) + 1)
            head, _ = results.head_members(text[:cut])
            for path, value in members(head):
                if not isinstance(value, dict):
                    assert lookup(body, path) == value
            tail = results.tail_members(text[cut:])
            for path, value in members(tail[0]) if tail else ():
                assert lookup(body, path) == value
        assert results.head_members(text)[0] == body
        assert results.tail_members(text)[0] == body


def test_numbers_at_the_edge_are_left_out():
    assert results.head_members('{"a": 1, "b": 23') == ({"a": 1}, ["b"])
    assert results.head_members('{"a": {"b": 1, "c": [1, 2') == ({"a": {"b": 1}}, ["a", "c"])
    assert results.tail_members('y", "b": 3}, "m": {"x": 1}}') == [{"m": {"x": 1}}, {"b": 3}]
    assert results.joined_ends('{"id": 7, "evaluation": {"n": 2, "records": [{"t": "', '"}], "metrics": {"f1": 0.5}}, "done": true}') == {"id": 7, "evaluation": {"n": 2, "metrics": {"f1": 0.5}}, "done": True}
    assert results.head_members("[1]") == ({}, []) and results.tail_members("") == []


def test_a_large_file_gives_its_metrics_from_two_ranges(spark, tmp_path):
    record = json.dumps({"text": 'a "quoted" }{ text \\ ' * 40})
    path = tmp_path / "model" / "bench__gen.json"
    path.parent.mkdir()
    with open(path, "w") as file:
        file.write('{"config": {"model": "m"}, "evaluation": {"task_name": "t", "records": [')
        for i in range(40_000):
            file.write(("," if i else "") + record)
        file.write('], "latency": 0.5, "num_samples": 40000, "metrics": {"f1": 0.25}}, "meta": {"x": "y"}}')
    assert os.path.getsize(path) > 35_000_000
    row = results.read_ends(spark, str(path)).first()
    assert row.size == os.path.getsize(path) and not row.whole and len(row.body) < 200_000
    df = results.read_ends(spark, str(tmp_path)).select(files.first_path(F.col("body"), "$.evaluation.metrics.f1").alias("f1"), *[c.alias(n) for n, c in files.derived_figures(F.col("body")).items()])
    got = df.first()
    assert (got.f1, got.benchmark_time) == ("0.25", 20_000.0)


def test_small_odd_and_missing_files(spark, tmp_path):
    for name, text in (("a.json", '{"x": 1}'), ("b.json", "[1]"), ("c.json", "{broken"), ("d.json", ""), ("e.txt", '{"x": 2}')):
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[-1]: (r.whole, r.body) for r in results.read_ends(spark, str(tmp_path)).collect()}
    assert got == {"a.json": (True, '{"x": 1}'), "b.json": (True, None), "c.json": (True, None), "d.json": (True, None)}
    (tmp_path / "none").mkdir()
    assert results.read_ends(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        results.read_ends(spark, str(tmp_path / "nowhere")).count()


def test_later_archives_and_members_count(spark, tmp_path):
    for n, (name, content) in enumerate({"one.zip": [("m/a__x.json", '{"v": 1}'), ("m/b__x.json", '{"v": 2}'), ("m/readme.txt", "no")], "two.zip": [("m/a__y.json", '{"v": 3}'), ("m/a__z.json", '{"v": 4}'), ("n/a.json", '{"v": 5}')]}.items()):
        with zipfile.ZipFile(tmp_path / name, "w") as archive:
            for member, body in content:
                archive.writestr(member, body)
        os.utime(tmp_path / name, (1_700_000_000 + n, 1_700_000_000 + n))
    rows = results.read_archives(spark, str(tmp_path), members=1)
    assert rows.count() == 5 and rows.rdd.getNumPartitions() == 6
    last = {(r.model, r.benchmark): json.loads(r.body)["v"] for r in results.last_results(rows).collect()}
    assert last == {("m", "a"): 4, ("m", "b"): 2, ("n", "a"): 5}
    assert results.read_archives(spark, str(tmp_path), bytes=3).where("body is not null").count() == 0
    (tmp_path / "bad.zip").write_text("no archive")
    assert results.read_archives(spark, str(tmp_path), skip_damaged="true").count() == 5
    with pytest.raises(Exception):
        results.read_archives(spark, str(tmp_path)).count()


# --- records of deep arrays


def test_records_equal_a_full_parse(tmp_path, monkeypatch):
    import io

    from scorewright.sources import json_arrays

    rng = random.Random(7)
    for size in (1, 3, 17, 1 << 20):
        monkeypatch.setattr(json_arrays, "PIECE", size)
        for _ in range(60):
            records = [random_value(rng) for _ in range(rng.randrange(6))]
            body = {"a": random_value(rng), "deep": {"x": random_value(rng), "records": records, "y": random_value(rng)}, "runs": [{"records": records[:2]}, random_value(rng), {"records": records[2:]}], "z": 1}
            raw = json.dumps(body, ensure_ascii=False, indent=rng.choice([None, 2])).encode()
            read = lambda path: [json.loads(r) for r in json_arrays.records_of(json_arrays._Text(io.BytesIO(raw)), path)]  # noqa: B023, E731
            assert read(["deep", "records"]) == records == read(["runs", "records"])
            assert read(["none"]) == [] == read(["z", "records"])


def test_nth_record_and_faults(spark, tmp_path):
    from scorewright.sources.json_arrays import read_json_records

    (tmp_path / "a.json").write_text(json.dumps({"meta": {"records": 5}, "evaluation": {"records": [{"i": i, "t": "é" * i} for i in range(300)]}, "records": [1]}))
    (tmp_path / "b.json").write_text('{"samples": [{"i": 1}, NaN, {"i"')
    (tmp_path / "c.json").write_text("")
    rows = read_json_records(spark, str(tmp_path))
    by_file = {p.rsplit("/", 1)[-1]: n for p, n in rows.groupBy("path").count().collect()}
    assert by_file == {"a.json": 300, "b.json": 2}
    one = read_json_records(spark, str(tmp_path / "a.json"), nth=123).collect()
    assert [(r.array, r.ordinal, json.loads(r.record)["i"]) for r in one] == [("evaluation.records", 123, 123)]
    assert read_json_records(spark, str(tmp_path / "a.json"), nth=300).count() == 0
    assert read_json_records(spark, str(tmp_path / "a.json"), arrays="records").first().record == "1"
    with pytest.raises(Exception):
        read_json_records(spark, str(tmp_path / "b.json"), strict="true").count()
