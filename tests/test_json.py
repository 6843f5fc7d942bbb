"""JSON read file by file."""

import json
import random

import pytest

from tabulens.sources import json_documents, readers
from tabulens.sources.readers import CORRUPT, read_json

ROWS = [{"id": i, "v": {"w": i * 2}} for i in range(10)]


def write(path, text):
    path.write_text(text)
    return str(path)


def ids(df):
    return sorted(r["id"] for r in df.collect() if r["id"] is not None)


@pytest.mark.parametrize("first", ['{"id": 1, "v', "[1]", "]", "nonsense"])
def test_a_bad_first_line_costs_one_line(spark, tmp_path, first):
    path = write(tmp_path / "a.json", first + "\n" + "\n".join(map(json.dumps, ROWS)))
    assert ids(read_json(spark, path, on_bad="skip")) == list(range(10))
    kept = read_json(spark, path, on_bad="keep")
    assert ids(kept) == list(range(10)) and kept.count() == 11
    assert [r[CORRUPT] for r in kept.cache().where(f"{CORRUPT} IS NOT NULL").collect()] == [first]
    with pytest.raises(Exception):
        read_json(spark, path).collect()


def test_a_folder_of_lines_and_documents(spark, tmp_path):
    write(tmp_path / "lines one.json", "\n".join(map(json.dumps, ROWS[:3])) + "\n\n")
    write(tmp_path / "array.json", json.dumps(ROWS[3:6], indent=1))
    write(tmp_path / "flat.json", json.dumps(ROWS[6:8]))
    write(tmp_path / "object.json", json.dumps({**ROWS[8], "extra": 1.5}, indent=2))
    got = read_json(spark, str(tmp_path))
    assert ids(got) == list(range(9)) and set(got.columns) == {"id", "v_w", "extra"}
    assert got.where("id = 8").first()["extra"] == 1.5


def test_types_that_differ_between_files(spark, tmp_path):
    write(tmp_path / "a.json", '{"id": 1, "x": 2}')
    write(tmp_path / "b.json", '[\n{"id": 2, "x": 2.5}\n]')
    assert sorted(r["x"] for r in read_json(spark, str(tmp_path)).collect()) == [2.0, 2.5]


def test_schema_and_explicit_kind(spark, tmp_path):
    path = write(tmp_path / "a.json", "\n".join(map(json.dumps, ROWS)))
    assert ids(read_json(spark, path, schema="id long")) == list(range(10))
    assert ids(read_json(spark, path, lines=True, on_bad="skip")) == list(range(10))
    empty = tmp_path / "none"
    empty.mkdir()
    write(empty / "e.json", "")
    assert read_json(spark, str(empty), schema="id long").count() == 0


# ---- files cut by many tasks ---------------------------------------------------------------------


@pytest.fixture
def tiny_splits(spark):
    """Every file is many splits."""
    names = {"spark.sql.files.maxPartitionBytes": "90", "spark.sql.files.openCostInBytes": "90"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


TEXTS = ["", "plain", 'quote " and \\ back', "} ] { [ , :", '\\"}', "line\nbreak", "ünï 😀", "\\", '"', "]}"]


def nested(turn, depth=0):
    kind = turn.randint(0, 5 if depth < 3 else 2)
    if kind == 3:
        return [nested(turn, depth + 1) for _ in range(turn.randint(0, 3))]
    if kind > 3:
        return {turn.choice(["a", 'k"', "}", "b"]): nested(turn, depth + 1) for _ in range(turn.randint(0, 3))}
    return [turn.choice(TEXTS), turn.randint(-5, 10**12), turn.choice([True, None, 0.5])][kind]


@pytest.mark.parametrize("seed", range(2))
def test_documents_are_cut_into_their_records(spark, tmp_path, tiny_splits, seed):
    turn, want = random.Random(seed), {}
    for k in range(5):
        rows = [{"x": nested(turn)} for _ in range(turn.randint(1, 6))]
        style = {"indent": turn.choice([None, 0, 2]), "ensure_ascii": turn.random() < 0.5}
        doc = rows if k % 4 else rows[0]
        write(tmp_path / f"{k}.json", turn.choice(["", " \n"]) + json.dumps(doc, **style) + turn.choice(["", "\n", "  \n\n"]))
        want[f"{k}.json"] = rows if k % 4 else rows[:1]
    ends = json_documents.file_ends(spark, str(tmp_path))
    single, *cut = json_documents.documents_of(spark, ends, None)
    assert [f.rsplit("/", 1)[1] for f in single] == sorted(want)
    for f in single:
        got = json_documents.records(*cut, [f]).collect()
        assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in got) == sorted(json.dumps(r, sort_keys=True) for r in want[f.rsplit("/", 1)[1]])


def test_what_is_no_single_document(spark, tmp_path, tiny_splits):
    texts = ["[1][2]", '[{"a": 1}]\n[{"a": 2}]', '[{"a": 1}', '{"a": 1}} {"b": 2}', "[]]", '["]', '{"a": {"b": 1}', "[{]", '{"a": "}']
    for i, t in enumerate(texts):
        write(tmp_path / f"bad{i}.json", t)
    for i, t in enumerate(['[{"a": "[1]"}]', "[]", '{"a": "\\\\"}', '[1, {"a": 2}, "x"]', "[[1], [2]]"]):
        write(tmp_path / f"good{i}.json", t)
    ends = json_documents.file_ends(spark, str(tmp_path))
    single, *cut = json_documents.documents_of(spark, ends.where("(first = '[' AND last = ']') OR (first = '{' AND last = '}')"), None)
    assert [f.rsplit("/", 1)[1] for f in single] == [f"good{i}.json" for i in range(5)]
    mixed = json_documents.records(*cut, [f for f in single if "good3" in f])
    assert sorted(r.value.replace(" ", "") for r in mixed.collect()) == ["1", "x", '{"a":2}']


def test_a_large_lines_file_with_one_bad_line_is_split(spark, tmp_path):
    rows = [json.dumps({"id": i, "text": "x" * 200}) for i in range(4000)]
    rows[1234] = '{"id": 1234, "text": "no end'
    path = write(tmp_path / "large.json", "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(100_000))
    try:
        got = read_json(spark, path, on_bad="skip")
        assert got.rdd.getNumPartitions() >= 8 and got.count() == 3999
        assert ids(got) == [i for i in range(4000) if i != 1234]
        one_line = write(tmp_path / "array.json", "[" + ",".join(json.dumps({"id": i, "text": "x" * 200}) for i in range(4000)) + "]")
        assert ids(read_json(spark, one_line)) == list(range(4000))
        ends = json_documents.file_ends(spark, one_line)
        _, _, starts = json_documents.documents_of(spark, ends, None)
        assert starts.count() >= 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_bad_element_costs_one_record(spark, tmp_path):
    path = write(tmp_path / "a.json", '[\n{"id": 1},\n{bad},\n{"id": 2},\n 7,\n{"id": 3}\n]')
    assert ids(read_json(spark, path, on_bad="skip")) == [1, 2, 3]
    kept = read_json(spark, path, on_bad="keep").cache()
    assert sorted(r[CORRUPT] for r in kept.where(f"{CORRUPT} IS NOT NULL").collect()) == ["7", "{bad}"]
    with pytest.raises(Exception):
        read_json(spark, path).collect()


@pytest.mark.parametrize("how", ["lines", "arrays", "both"])
def test_partition_columns_are_kept(spark, tmp_path, how):
    for day in (1, 2):
        folder = tmp_path / f"day={day}" / "kind=a b"
        folder.mkdir(parents=True)
        rows = [{"id": 10 * day + i} for i in range(3)]
        if how == "lines" or how == "both" and day == 1:
            write(folder / "x.json", "\n".join(map(json.dumps, rows)) + "\nnonsense\n")
        else:
            write(folder / "x.json", json.dumps(rows, indent=1))
    got = read_json(spark, str(tmp_path), on_bad="skip")
    assert sorted((r.day, r.kind, r.id) for r in got.collect()) == [(d, "a b", 10 * d + i) for d in (1, 2) for i in range(3)]
    one = read_json(spark, str(tmp_path / "day=1" / "*"), on_bad="skip")
    assert ids(one) == [10, 11, 12]


def test_records_of_many_folders_are_few_files(spark, tmp_path, monkeypatch):
    """The records of a folder stay together: files grow with folders, not with folders times tasks."""
    n = 12
    for k in range(n):
        (tmp_path / "in" / f"part={k}").mkdir(parents=True)
        rows = [{"id": 100 * k + i, "t": "x]}," * (i % 3)} for i in range(60)]
        (tmp_path / "in" / f"part={k}" / "a.json").write_text(json.dumps(rows))
    monkeypatch.setattr(readers, "scratch_path", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = readers.read_json(spark, str(tmp_path / "in")).collect()
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["part"], r["id"], r["t"]) for r in got) == [(k, 100 * k + i, "x]}," * (i % 3)) for k in range(n) for i in range(60)]
    assert len(list((tmp_path / "records").rglob("part-*.txt"))) <= n + tasks
