"""Records of JSON, JSON lines, CSV and Parquet members of zip archives, as a data source whose partitions are members.

    spark.dataSource.register(ZipMembers)
    spark.read.format("zip_members").load(path)   # an archive, or a folder that is searched for *.zip

Members are read in place: a task seeks to its member in the archive and streams it (JSON and Parquet members are held
whole, as their formats need). The path is one that the driver and all executors can open, such as a shared folder.
"""

from __future__ import annotations

import csv
import io
import json
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member_no int, member string, split string, ord long, record string, error string"
# What a member's name says of its split, in the order in which it is looked for, and keys that hold records.
SPLITS = ("train", "test", "validation", "dev")
HOLDERS = ("data", "records", "examples", "items")
KINDS = (".jsonl", ".json", ".csv", ".parquet")


class Member(InputPartition):
    def __init__(self, archive: str, number: int | None, name: str | None, error: str | None = None):
        self.archive, self.number, self.name, self.error = archive, number, name, error


def _plain(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def archives(path: str) -> list[str]:
    """The archive, or all *.zip below the folder, by name."""
    path = _plain(path)
    if not os.path.isdir(path):
        return [path]
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.lower().endswith(".zip"))


def member_split(name: str) -> str | None:
    return next((s for s in SPLITS if s in name.lower()), None)


def _records(raw, name: str) -> Iterator[tuple[str | None, str | None]]:
    """(record as JSON, error) of an open member: objects only, one error row for a line or member that can't be read."""
    kind = os.path.splitext(name.lower())[1]
    text = lambda: io.TextIOWrapper(raw, "utf-8", errors="ignore", newline="")
    if kind == ".jsonl":
        for line in text():
            if line.strip():
                try:
                    value = json.loads(line)
                except ValueError as e:
                    yield None, f"line: {e}"
                    continue
                if isinstance(value, dict):
                    yield json.dumps(value, ensure_ascii=False), None
    elif kind == ".json":
        value = json.loads(text().read())
        if isinstance(value, dict):
            value = next((value[k] for k in HOLDERS if isinstance(value.get(k), list)), [value])
        for x in value if isinstance(value, list) else []:
            if isinstance(x, dict):
                yield json.dumps(x, ensure_ascii=False), None
    elif kind == ".csv":
        for x in csv.DictReader(text()):
            yield json.dumps({k: v for k, v in x.items() if k is not None}, ensure_ascii=False), None
    else:
        for batch in pq.ParquetFile(pa.BufferReader(raw.read())).iter_batches(1024):
            for x in batch.to_pylist():
                yield json.dumps(x, ensure_ascii=False, default=str), None


class MemberReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Member]:
        out = []
        for a in archives(self.path):
            try:
                with zipfile.ZipFile(a) as z:
                    names = [i.filename for i in z.infolist() if not i.is_dir()]
            except (OSError, zipfile.BadZipFile) as e:
                out.append(Member(a, None, None, f"archive: {e}"))
                continue
            out += [Member(a, i, n) for i, n in enumerate(names) if n.lower().endswith(KINDS)]
        return out

    def read(self, partition: Member):
        a, i, name = partition.archive, partition.number, partition.name
        if name is None:
            yield a, None, None, None, None, None, partition.error
            return
        n = 0
        try:
            with zipfile.ZipFile(a) as z, z.open(name) as raw:
                for record, error in _records(raw, name):
                    yield a, i, name, member_split(name), n, record, error
                    n += 1
        except Exception as e:  # a damaged member is a row, and the others are read
            yield a, i, name, member_split(name), n, None, f"member: {e}"


class ZipMembers(DataSource):
    """Rows as SCHEMA has them: a record is a JSON object; error says what couldn't be read instead. Empty members, and
    those of other kinds, give no row. Null bytes, odd encodings: what isn't UTF-8 is left out of the text."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options["path"])


def inferred_datasets(records: DataFrame, first: int = 40) -> DataFrame:
    """(archive, n, fields, splits, gsm_signals, math_signals, inferred, uncertain) of the members' records: "gsm8k" for
    word problems with numeric answers, "math500" for symbolic ones, else "unknown", by counting signals in the archive's
    name, its fields and its first records' questions and answers. Archives without records are unknown and uncertain."""
    r = records.withColumn("m", F.from_json("record", "map<string,string>"))
    pairs = F.transform(F.map_entries("m"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    r = r.withColumn("pairs", pairs).withColumn("at", F.row_number().over(W.partitionBy("archive").orderBy(F.col("record").isNull(), "member_no", "ord")))
    value = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(F.filter("pairs", lambda e: e["key"] == k), F.lit(1))["value"], F.lit("")) for k in keys], F.lit(""))  # noqa: B023, E731
    said = F.when((F.col("at") <= first) & F.col("record").isNotNull(), F.lower(F.concat(F.substring(value("question", "problem"), 1, 400), F.lit(" "), F.substring(value("answer", "solution"), 1, 200))))
    r = r.select("archive", "split", F.col("record").isNotNull().cast("long").alias("one"), said.alias("said"), F.map_keys("m").alias("keys"))
    has = lambda what: F.coalesce(F.bool_or(F.contains("said", F.lit(what))), F.lit(False))
    fields = r.select("archive", F.explode("keys").alias("k")).groupBy(F.col("archive").alias("of")).agg(F.array_sort(F.collect_set("k")).alias("fields"))
    g = r.groupBy("archive").agg(F.sum("one").alias("n"), F.array_sort(F.collect_set("split")).alias("splits"), *[has(w).alias(n) for n, w in (("school", "grade school"), ("hashes", "####"), ("boxed", "boxed"), ("slash", "\\"))])
    g = g.join(fields, F.col("archive") == F.col("of"), "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))
    low, name = F.transform("fields", lambda k: F.lower(k)), F.lower(F.element_at(F.split("archive", "/"), -1))
    any_of = lambda *keys: F.arrays_overlap(low, F.array(*map(F.lit, keys)))
    question, answer = any_of("question", "problem"), any_of("answer", "gold_answer", "solution", "final_answer", "solution_text")
    count = lambda *c: sum((x.cast("int") for x in c), F.lit(0))
    g = g.withColumns({
        "gsm_signals": count(F.contains(name, F.lit("gsm")), F.col("school"), F.col("hashes"), question & answer & ~F.col("boxed")),
        "math_signals": count(F.contains(name, F.lit("math500")) | F.contains(name, F.lit("math-500")), F.col("boxed"), F.col("slash"), any_of("problem") & answer, any_of("subject", "level")),
        "both": question & answer})
    some, gsm, math = F.col("n") > 0, F.col("gsm_signals"), F.col("math_signals")
    inferred = F.when(some & (math >= 2) & (math > gsm), "math500").when(some & (gsm >= 2) & (gsm >= math), "gsm8k").otherwise("unknown")
    g = g.withColumn("inferred", inferred)
    return g.select("archive", "n", "fields", "splits", "gsm_signals", "math_signals", "inferred", ((F.col("inferred") == "unknown") & ~F.col("both")).alias("uncertain"))
