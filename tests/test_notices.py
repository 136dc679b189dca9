"""Notices against a plain walk over their lines."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from foliant.operators import notices as N

PIECES = (
    "一、总则", "二，安排", "三、", "1、时间", "2. 地点", "3,人员", "关于", "关于开展", "学习活动的", "的通知", "关于召开会议的报告", "某某大学某学院团总支", "共青团某校委员会", "学院", "2023年4月5日", "2023 年 5 月 6 日 印发",
    "抄送：各单位", "抄报：校团委", "通报：各支部", "此页无正文", "附件1 名单", "附件：无", "附 件", "“学习精神”", "奋进新征程", "校团字〔2023〕9号", "5", "", "  ", "　正文一　", "正文二", "昆明某地", "信息大学第一学院", "时间为2022年1月2日和2022年1月3日",
)
WEIGHTS = [6 if p in ("关于召开会议的报告", "“学习精神”", "奋进新征程") else 1 for p in PIECES]


def walk(raw: list[str]) -> dict:
    lines = [x for x in (line.strip(" \t\n\x0b\f\r　") for line in raw) if x and x not in N.PAGE_DIGITS]
    out = {"header": None, "ref": None, "title": None, "subtitle": None, "sections": [], "attachments": []}
    header, ref = re.compile("([一-龥]+(?:大学|学院)[一-龥]*学院[一-龥]*)"), re.compile(r"([一-龥]+字\s*[〔\[]?\d{4}[〕\]]?\s*\d+\s*号)")
    title = re.compile(r"关于[\s\S]+?的(通知|通告|决定|函|报告|规定|办法)")
    out["header"] = next((m.group(1) for x in lines if (m := header.match(x))), None)
    out["ref"] = next((m.group(1) for x in lines if (m := ref.search(x))), None)
    for i in range(len(lines)):
        joined = next((j for k in (1, 2, 3) if i + k <= len(lines) and title.search(j := "".join(lines[i : i + k]))), None)
        if joined:
            out["title"] = joined
            break
    if out["title"] in lines and any(q in x for x in lines for q in "“”"):
        i = lines.index(out["title"])
        after = lines[i + 1 : i + 3]
        if after and any(w in after[0] for w in ("学习", "奋进", "永远")):
            out["subtitle"] = after[0]
        elif len(after) == 2 and any(w in after[1] for w in ("学习", "奋进")):
            out["subtitle"] = " ".join(after)
    now = None
    for x in lines:
        if re.match(r"^([一二三四五六七八九十]+)[、，,]\s*(.+)", x):
            now = [x, [], []]
            out["sections"].append(now)
        elif re.match(r"^(\d+)[、，,.]\s*(.+)", x) and now:
            now[2].append([x, []])
        elif now:
            if any(k in x for k in ("此页无正文", "印发", "团总支", "抄报", "抄送")):
                now = None
            elif now[2]:
                now[2][-1][1].append(x)
            else:
                now[1].append(x)
    kinds = [("cc" if re.match("抄[报送]", x) else "distribution" if "通报" in x and "支部" in x else "date" if re.match(r"\d{4}\s*年", x) else None) for x in lines]
    taken = {x for x, k in zip(lines, kinds) if k}
    signs = []
    for i, x in enumerate(lines):
        if re.match(r"\d{4}\s*年", x):
            near = next((lines[j] for j in range(i - 1, max(i - 6, -1), -1) if re.search("团总支|委员会|学院|学校", lines[j]) and len(lines[j]) > 4), None)
            if near and near not in taken:
                signs.append(near)
    out["organisation"] = signs[0] if signs else None
    dates = re.findall(r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日", "\n".join(lines))
    out["date"] = next((x for x, k in zip(lines, kinds) if k == "date"), dates[-1] if dates else None)
    out["copies"] = [x for x, k in zip(lines, kinds) if k == "cc"]
    out["distribution"] = next((x for x, k in reversed(list(zip(lines, kinds))) if k == "distribution"), None)
    for x in lines:
        if re.match(r"^附件\s*[一二三四五六七八九十\d]", x):
            out["attachments"].append([x, []])
        elif out["attachments"] and not re.match(r"(抄[报送]|通报|昆明|共青团|\d{4}\s*年)", x):
            out["attachments"][-1][1].append(x)
    return out


def test_equals_a_walk_over_the_lines(spark):
    rng = random.Random(5)
    documents = {d: rng.choices(PIECES, WEIGHTS if d % 2 else None, k=rng.randrange(0, 25)) for d in range(400)}
    rows = [(d, i, x) for d, lines in documents.items() for i, x in enumerate(lines)]
    got = {r.doc_id: r for r in N.documents(spark.createDataFrame(rows, "doc_id long, idx int, line string")).collect()}
    seen = dict.fromkeys(("header", "ref", "title", "subtitle", "organisation", "joined"), 0)
    for d, lines in documents.items():
        want = walk(lines)
        if d not in got:
            assert not any(x.strip(" 　") and x not in N.PAGE_DIGITS for x in lines)
            continue
        r = got[d]
        assert (r.header, r.ref_number, r.title, r.subtitle, r.organisation, r.date, r.copies, r.distribution) == (want["header"], want["ref"], want["title"], want["subtitle"], want["organisation"], want["date"], want["copies"], want["distribution"]), lines
        body = [[s.heading, s.content, [[x.heading, x.content] for x in s.subsections]] for s in r.body or []]
        assert body == [[s[0], "\n".join(s[1]), [[x[0], "\n".join(x[1])] for x in s[2]]] for s in want["sections"]], lines
        assert [[a.name, a.content] for a in r.attached or []] == [[a[0], "\n".join(a[1])] for a in want["attachments"]]
        assert (r.sections, r.attachments) == (len(want["sections"]), len(want["attachments"]))
        for k in seen:
            seen[k] += bool(want.get(k)) if k != "joined" else bool(want["title"]) and want["title"] not in [x.strip(" 　") for x in lines]
    assert all(seen.values()), seen


def test_one_exchange_serves_all_parts(spark):
    lines = spark.range(10).select((F.col("id") % 3).alias("doc_id"), F.lit(1).alias("idx"), F.lit("x").alias("line"))
    for part in (N.summaries, N.sections, N.attached):
        plan = part(N.marked(lines))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange") == 1
