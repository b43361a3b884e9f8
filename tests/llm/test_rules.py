"""Quality rules against a plain Python version."""

from __future__ import annotations

import random
import re

import pytest

from routeloom.llm import rules

SPACES = " \t\n\x0b\f\r"


def plain(text):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    stops = {f for ws in rules.STOP_WORDS.values() for w in ws.split() for f in (w, w.capitalize(), w.upper())}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_stop_words": sum(w in stops for w in words), "n_lines": len(lines), "n_bullet_lines": sum(x.lstrip(SPACES)[0] in "-*•" for x in lines),
        "n_ellipsis_lines": sum(x.rstrip(SPACES).endswith(("...", "…")) for x in lines),
    }


def texts():
    rng = random.Random(4)
    pick = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    out = [None, "", " \t\r\n", "one", "a b", "a b c", "a a a", "a a a a", "x y z x y z", "the of\n\nthe of\n the of\n", "- item\n* other\n• third\nplain...\nmore…  \r\n", "\n\n\n", "a b c d", "Ünïcödé 😀 😀 😀 😀", "#*$%&|<>" * 9, "end", "A B C a b c"]
    out += [pick(n, k) for n in (2, 3, 4, 50, 51, 300) for k in (1, 2, 5, 40)]
    out += ["\n".join(rng.choice(["the line of a", "- b", "c ...", "", " "]) for _ in range(60)) for _ in range(5)]
    out += [pick(30_000, 9), pick(30_000, 20_000), "long" * 100_000]
    return out


def test_counts(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(texts())] + [(None, "a b c a b c", "y", 8), (3, "again", "z", 9), (3, "again", "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int")
    got = rules.counted(docs).collect()
    assert sorted((repr(r.doc_id), repr({c: r[c] for c in rules.COUNTS})) for r in got) == sorted((repr(i), repr({c: plain(t)[c] for c in rules.COUNTS})) for i, t, *_ in rows)


def test_verdicts(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    for r in rules.judged(docs).collect():
        p = plain(texts()[r.doc_id]) | {"one": 1}
        failed = [x.name for x in (*rules.BASE, *rules.RULES) if not ((x.least is None or 100 * p[x.count] >= x.least * p[x.per]) and (x.most is None or 100 * p[x.count] <= x.most * p[x.per]))]
        base = {"words", "repeated_words"} & set(failed)
        assert (r.base_failed, r.kept, r.failed_rules) == (bool(base), not failed, ",".join(failed))
        assert r.base_failed == (p["n_words"] < 50 or 100 * p["n_repeat_words"] > 50 * p["n_words"])
    assert rules.judged(docs, rules=(), base=()).where("not kept").count() == 0


def test_tables_of_rules(spark):
    table = spark.createDataFrame([("short", "n_words", "one", None, 300), ("symbols", "n_symbols", "n_words", 10, 900)], "name string, count string, per string, least int, most int")
    got = rules.rule_table(table)
    assert got == [rules.Rule("short", "n_words", "one", None, 300), rules.Rule("symbols", "n_symbols", "n_words", 10, 900)]
    docs = spark.createDataFrame([(1, "a b # d"), (2, "a b # d"), (3, "# b"), (4, "a b")], "doc_id long, text string")
    assert {r.doc_id: r.failed_rules for r in rules.judged(docs, got, ()).collect()} == {1: "short", 2: "short", 3: "", 4: "symbols"}
    with pytest.raises(ValueError, match="unknown count"):
        rules.rule_table(spark.createDataFrame([("r", "n_cats", "one", 1, 2)], "name string, count string, per string, least int, most int"))


def test_no_python_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert rules.judged(docs.limit(0)).count() == 0
