"""Members of zip archives as a source."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from routeloom.sources.archives import ZipMembers, inferred_datasets


def parquet(rows):
    out = io.BytesIO()
    pq.write_table(pa.Table.from_pylist(rows), out)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.dataSource.register(ZipMembers)
    top = tmp_path_factory.mktemp("zips")
    (top / "deep").mkdir()

    def write(name, members):
        with zipfile.ZipFile(top / name, "w", zipfile.ZIP_DEFLATED) as z:
            for k, v in members.items():
                z.writestr(k, v)

    write("gsm.zip", {"main/": "", "main/train.jsonl": "\n".join(json.dumps({"question": f"é {i}?", "answer": f"#### {i}"}) for i in range(2500)) + "\nnot json\n[1]\n\n", "main/test.csv": 'Question,answer\n"two\nlines",3\nb,4\n', "notes.txt": "no"})
    write("deep/set_MATH500.zip", {"a.json": json.dumps({"records": [{"problem": "$\\frac{1}{2}$", "solution": r"\boxed{1}", "level": 3, "x": {"y": [1]}}, 5]}), "validation.parquet": parquet([{"problem": "p", "answer": "q"}, {"problem": None, "answer": "r"}])})
    write("other.zip", {"empty.jsonl": "", "bad.json": "{", "dev.parquet": b"PAR1 not really", "plain.json": '{"a": 1}', "list.json": "[]"})
    whole = (top / "gsm.zip").read_bytes()
    (top / "torn.zip").write_bytes(whole[: len(whole) // 2])
    # a member whose bytes are damaged
    with zipfile.ZipFile(top / "gsm.zip") as z:
        at = z.getinfo("main/train.jsonl").header_offset
    (top / "flipped.zip").write_bytes(whole[: at + 300] + bytes(40) + whole[at + 340 :])
    return str(top)


def test_members(spark, folder):
    rows = spark.read.format("zip_members").load(folder)
    assert rows.rdd.getNumPartitions() >= 9  # a partition a member, and one for the torn archive
    by = {}
    for r in rows.collect():
        by.setdefault((r.archive.rsplit("/", 1)[1], r.member), []).append(r)
    train = by["gsm.zip", "main/train.jsonl"]
    assert [r.ord for r in train] == list(range(2501)) and train[0].split == "train" and train[2500].record is None and train[2500].error.startswith("line")
    assert json.loads(train[7].record) == {"question": "é 7?", "answer": "#### 7"}
    assert [json.loads(r.record) for r in by["gsm.zip", "main/test.csv"]] == [{"Question": "two\nlines", "answer": "3"}, {"Question": "b", "answer": "4"}]
    assert [json.loads(r.record)["x"] for r in by["set_MATH500.zip", "a.json"]] == [{"y": [1]}]
    assert [(json.loads(r.record), r.split) for r in by["set_MATH500.zip", "validation.parquet"]] == [({"problem": "p", "answer": "q"}, "validation"), ({"problem": None, "answer": "r"}, "validation")]
    assert by["torn.zip", None][0].error.startswith("archive") and all(by["other.zip", m][0].error.startswith("member") for m in ("bad.json", "dev.parquet"))
    assert ("other.zip", "empty.jsonl") not in by and ("other.zip", "list.json") not in by and json.loads(by["other.zip", "plain.json"][0].record) == {"a": 1}
    assert by["flipped.zip", "main/train.jsonl"][-1].error is not None and len(by["flipped.zip", "main/test.csv"]) == 2
    one = spark.read.format("zip_members").load(f"file://{folder}/other.zip")
    assert {r.member for r in one.collect()} == {"bad.json", "dev.parquet", "plain.json"}


def test_inferred_datasets(spark, folder):
    got = {r.archive.rsplit("/", 1)[1]: r for r in inferred_datasets(spark.read.format("zip_members").load(folder)).collect()}
    g = got["gsm.zip"]
    assert (g.inferred, g.n, g.gsm_signals, g.math_signals, g.uncertain) == ("gsm8k", 2502, 3, 0, False) and g.fields == ["Question", "answer", "question"] and g.splits == ["test", "train"]
    m = got["set_MATH500.zip"]
    assert (m.inferred, m.math_signals, m.gsm_signals) == ("math500", 5, 0)
    assert got["other.zip"].inferred == "unknown" and got["other.zip"].uncertain and got["torn.zip"].n == 0 and got["torn.zip"].uncertain
