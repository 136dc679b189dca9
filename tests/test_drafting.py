"""Wording, generator code, and templates over time."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import generators as G
from foliant.functions import wording as W
from foliant.operators import templates as T


def cleaned(text: str) -> str:
    text = re.sub(r"(.{2,8}?)[。；，]\1", r"\1", text)
    for pattern, instead in ((r"术后[。]*术后", "术后"), (r"[。]{2,}", "。"), (r"。，", "，"), (r"，。", "，"), (r"，\s*，", "，")):
        text = re.sub(pattern, instead, text)
    return text


def test_repeats_are_those_of_the_back_reference(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab术后。；，\n ") for _ in range(rng.randrange(0, 60))) for _ in range(2000)] + ["ab，" * 200_000, "术后" * 100_000, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", W.without_repeats(F.col("t")).alias("t"))
    assert {r.id: r.t for r in rows.collect()} == {i: cleaned(t) for i, t in enumerate(texts)}


def test_numbers_dates_fields_and_values_in_words(spark):
    rows = [(0, "2023年4月5日立案"), (7, "2023年12月30日"), (10, "2023年10月20日"), (20, "XXXX年1月1日"), (39, "二〇二三"), (40, ""), (None, None), (-1, "2023年99月1日")]
    out = spark.createDataFrame(rows, "n int, d string").select("n", W.number_in_words(F.col("n")).alias("w"), W.date_in_words(F.col("d")).alias("d")).collect()
    assert [r.w for r in out] == ["〇", "七", "十", "二十", "三十九", "40", None, "-1"]
    assert [r.d for r in out] == ["二〇二三年四月五日", "二〇二三年十二月三十日", "二〇二三年十月二十日", "XXXX年1月1日", "二〇二三", "", None, "二〇二三年99月一日"]
    data = ['{"a": null, "b": 1}', '{"b": 1}', "[1]", "no", None]
    got = spark.createDataFrame([(x,) for x in data], "d string").select(W.first_missing(F.col("d"), ("a", "b")).alias("m")).collect()
    assert [r.m for r in got] == [None, "a", "a", "a", "a"]
    values = spark.createDataFrame([(" x ",), ("",), (None,), ("[待补充]",), (" null",)], "v string").select(W.known(F.col("v")).alias("v")).collect()
    assert [r.v for r in values] == ["x", *["________"] * 4]


def test_code_may_import_what_is_listed(spark):
    code = "import json, re, datetime\nfrom collections.abc import Mapping\nimport collections.abc\nfrom decimal import Decimal\ndef generate(d):\n    assert isinstance(d, Mapping) and isinstance(d, collections.abc.Mapping)\n    return re.sub('a', 'b', json.dumps(d)) + str(datetime.date(2024, 1, int(Decimal('2'))))"
    assert G.violations(code) == []
    assert G.maker_of(code)({"a": 1}) == '{"b": 1}2024-01-02'
    for bad in ("import os", "import numpy", "from os import path", "from . import x", "import json.tool", "open('x')", "().__class__", "__import__('os')"):
        assert G.violations(bad), bad


@pytest.mark.parametrize("body", ["__builtins__['open']('/etc/passwd')", "f = __builtins__['__import__']; return f('os').getcwd()", "return json.codecs.open('/etc/passwd').read()", "return getattr(d, 'x')", "return str(vars())", "return random.random()"])
def test_what_the_check_does_not_see_is_not_there_at_run_time(body):
    code = f"import json\ndef generate(d):\n    {body if 'return' in body else 'return ' + body}"
    assert G.violations(code) == []
    with pytest.raises((NameError, KeyError, ImportError, AttributeError, TypeError)):
        G.maker_of(code)({})


def test_generators_of_several_texts(spark):
    rows = spark.createDataFrame([(1, '{"n": 2}'), (2, '{"n": 0}'), (3, "{"), (4, None), (5, '{"n": -1}')], "id int, data string")
    code = "def generate(d):\n    if d['n'] < 0:\n        return 'one'\n    return many(d['n'])\ndef many(n):\n    for k in range(n):\n        yield str(k)\n    if n == 2:\n        yield 7"
    got = [(r.id, r.part, r.document, r.error and r.error.split(":")[0]) for r in G.generated_rows(rows, code, trusted=True).orderBy("id", "part").collect()]
    assert got == [(1, 0, "0", None), (1, 1, "1", None), (1, 2, None, "int instead of str"), (2, None, None, None), (3, 0, None, "JSONDecodeError"), (4, 0, None, "KeyError"), (5, 0, "one", None)]
    with pytest.raises(ValueError):
        G.generated_rows(rows, code)


def walk(changes):
    """Versions of one template, change by change."""
    out, here, made, fields = [], False, False, {}

    def close(at):
        if out and out[-1]["valid_to"] is None and out[-1]["open"]:
            out[-1]["valid_to"], out[-1]["open"] = at, False

    for at, _, action, said in changes:
        if action == "create":
            if not here:
                fields = dict.fromkeys(T.FIELDS)
            here = made = True
            fields = {f: said[f] if said[f] is not None else fields[f] for f in T.FIELDS}
        elif action == "restore" and made and not here:
            here = True
        elif action == "update" and here:
            fields = {f: said[f] if said[f] is not None else fields[f] for f in T.FIELDS}
        elif action == "clear" and here:
            fields = fields | {"reference": None}
        elif action == "delete" and here:
            close(at)
            here = False
            continue
        else:
            continue
        close(at)
        out.append({"valid_from": at, "valid_to": None, "open": True, **fields})
    return [(n + 1, v["valid_from"], v["valid_to"], *[v[f] for f in T.FIELDS], v["open"]) for n, v in enumerate(out)]


def test_versions_and_lookups_equal_a_walk(spark):
    rng = random.Random(2)
    rows, by_key = [], {}
    for seq in range(600):
        key = (rng.choice([None, 1, 2]), rng.choice("ab"))
        said = {f: rng.choice([None, f"{f}{seq}"]) for f in T.FIELDS}
        change = (rng.randrange(100), seq, rng.choice(["create", "update", "update", "clear", "delete", "restore"]), said)
        by_key.setdefault(key, []).append(change)
        rows.append((*key, change[0], seq, change[2], *said.values()))
    df = spark.createDataFrame(rows, "tenant_id int, name string, ts long, seq long, action string, " + ", ".join(f"{f} string" for f in T.FIELDS))
    versions = T.versions(df)
    got: dict = {}
    for r in versions.orderBy("version").collect():
        got.setdefault((r.tenant_id, r.name), []).append(tuple(r)[2:])
    want = {k: walk(sorted(c, key=lambda c: c[:2])) for k, c in by_key.items()}
    assert got == want and sum(map(len, want.values())) > 100
    asked = [(i, rng.choice([None, 1, 2, 3]), rng.choice("abc"), rng.randrange(-5, 110)) for i in range(300)]
    found = {r.id: r for r in T.as_of(versions, spark.createDataFrame(asked, "id long, tenant_id int, name string, ts long")).collect()}
    for i, tenant, name, ts in asked:
        best = None
        for owner in (tenant, None):
            fits = [v for v in want.get((owner, name), []) if v[1] <= ts and (v[2] is None or v[2] > ts)]
            best = best or (fits and (owner, fits[-1]))
        r = found[i]
        assert (r.version, r.valid_from, r.code) == ((best[1][0], best[1][1], best[1][5]) if best else (None, None, None))
        assert r.tenant_id == (best[0] if best else None)
    assert T.versions(df.limit(0)).collect() == []
