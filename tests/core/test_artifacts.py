import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from accordant.sources.artifacts import ArtifactError, canonical_config, commit, decoded_config, faults, manifest, record_of, rows_of


def test_configuration_is_strict():
    assert decoded_config('{"a": {"b": 1}}') == {"a": {"b": 1}} and canonical_config('{"b": 1, "a": 2.50}') == canonical_config('{"a":2.5,"b":1}')
    for text in ('{"a": 1, "a": 1}', '{"x": [{"a": 1, "a": 2}]}', '{"a": NaN}', '{"a": Infinity}', "[]", "{", "[" * 90_000, '{"a": "' + "x" * (1 << 20) + '"}'):
        with pytest.raises(ArtifactError):
            decoded_config(text)


@pytest.fixture
def rows(spark):
    return spark.range(1_000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("té\n"), "id")).alias("text"), (F.col("id") / 3).alias("a.b")).repartition(5, "id")


def test_what_is_written_is_read(spark, tmp_path, rows):
    folder = f"file://{tmp_path}/a"
    told = commit(rows, folder, '{"seed": 1}')
    assert told == record_of(folder) and told["rows"] == 1_000 and told["files"] == manifest(spark, folder).count()
    assert sorted(map(tuple, rows_of(spark, folder).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(ArtifactError, match="already"):
        commit(rows, folder, "{}")


def test_leavings_of_lost_tasks_are_no_rows(spark, tmp_path, rows):
    folder = f"file://{tmp_path}/a"
    commit(rows, folder, "{}")
    one = next(Path(tmp_path, "a", "data").glob("part-*"))
    (one.parent / (one.name.rsplit("-", 1)[0] + "-999999.jsonl")).write_bytes(one.read_bytes()[:50])
    assert rows_of(spark, folder).count() == 1_000 and faults(spark, folder).count() == 0


def test_damage_is_told(spark, tmp_path, rows):
    for i, (fault, change) in enumerate((("digest", lambda b: b[:-3] + b"9" + b[-2:]), ("size", lambda b: b[:-1]), ("missing", None))):
        folder = f"file://{tmp_path}/{i}"
        commit(rows, folder, "{}")
        one = max(Path(tmp_path, str(i), "data").glob("part-*"), key=lambda p: p.stat().st_size)
        one.write_bytes(change(one.read_bytes())) if change else one.unlink()
        assert [tuple(r) for r in faults(spark, folder).collect()] == [(one.name, fault)]
        with pytest.raises(ArtifactError, match=fault):
            rows_of(spark, folder)


def test_without_a_record_there_is_nothing(spark, tmp_path, rows):
    folder = f"file://{tmp_path}/a"

    def fails(batches):
        raise RuntimeError("lost")
        yield

    with pytest.raises(Exception, match="lost"):
        commit(rows.select("id").mapInArrow(fails, "id long"), folder, "{}")
    with pytest.raises(ArtifactError, match="no committed"):
        rows_of(spark, folder)
    commit(rows, f"{folder}2", "{}")
    record = Path(tmp_path, "a2", "artifact.json")
    told = json.loads(record.read_text())
    record.write_text(json.dumps(told | {"config": '{"seed":2}'}))
    with pytest.raises(ArtifactError, match="configuration"):
        rows_of(spark, f"{folder}2")
    record.write_text(json.dumps(told | {"manifest_sha256": "0" * 64}))
    with pytest.raises(ArtifactError, match="manifest"):
        rows_of(spark, f"{folder}2")


def test_an_empty_table(spark, tmp_path, rows):
    folder = f"file://{tmp_path}/a"
    assert commit(rows.filter("id < 0"), folder, "{}")["rows"] == 0 and rows_of(spark, folder).count() == 0
