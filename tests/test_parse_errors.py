"""Failed lines against a character-by-character reader."""

import random
import re

from matchlake.operators.parse_errors import classified, failed_lines, loaded_lines

SCHEMA = "line_id bigint, file_name string, line_no int, line string, sep string"


def split(line, sep):
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                text += line[j:k]
                if line[k : k + 2] == '""':
                    text, j = text + '"', k + 2
                    continue
                break
            i = k + 1
            if i < len(line) and line[i] != sep:
                return None
            out.append(text)
        else:
            k = line.find(sep, i)
            k = len(line) if k < 0 else k
            if '"' in line[i:k]:
                return None
            out.append(line[i:k])
            i = k
        if i >= len(line):
            return out
        i += 1
        if i == len(line):
            return [*out, ""]


def reason(line, header):
    sep = ";" if ";" in header else ","
    if line is None or not line.strip():
        return None
    cols, got = header.lstrip("﻿").split(sep), split(line, sep)
    if got is None:
        return "quoting"
    got = [x.strip() for x in got]
    if not any(got):
        return None
    if len(got) != len(cols):
        return "column_count"
    d, point = dict(zip(cols, got)), re.escape("," if sep == ";" else ".")
    if not d["home_goals"] and not d["away_goals"]:
        return None
    fine = d["home"] and d["away"] and all(re.fullmatch(rf"[0-9]+(?:{point}0+)?", d[c]) for c in ("home_goals", "away_goals"))
    fine = fine and all(not v or re.fullmatch(rf"[0-9]+(?:{point}[0-9]+)?", v) for c, v in d.items() if c.startswith(("odds", "home_shots")))
    return None if fine else "bad_value"


def test_random_lines(spark):
    r = random.Random(3)
    heads = ["date,home,away,home_goals,away_goals,home_shots,odds_home", "﻿away_goals;home;odds_home;away;home_goals;date"]
    pieces = ["", " ", "A", "B x", '"C"', '"D ""E"""', '"F, G"', '"F; G"', "1", "2.0", "2,0", " 3 ", "-1", "1.5", "inf", '"4"', '"x', 'x"y', '"z"w', '"line\nbreak"', "été"]
    rows = []
    for f, h in enumerate(heads):
        rows.append((len(rows), f"f{f}", 1, h, "clash"))
        sep = ";" if ";" in h else ","
        for n in range(2, 900):
            k = h.count(sep) + 1 + r.choice([0, 0, 0, 0, 0, 1, -1])
            good = ["2024-01-01", "A", "B", "1", "2", "3", "1,5" if sep == ";" else "1.5"]
            line = sep.join(r.choice(good if r.random() < 0.6 else pieces) for _ in range(k)) if r.random() < 0.95 else r.choice(["", "  ", sep * 5, None])
            rows.append((len(rows), f"f{f}", n, line, "clash"))
    df = spark.createDataFrame(rows, SCHEMA)
    want = {i: reason(line, heads[int(f[1])]) for i, f, n, line, _ in rows if n > 1}
    got = {x["line_id"]: x["reason"] for x in failed_lines(df).collect()}
    assert got == {i: v for i, v in want.items() if v}


def test_loaded_values(spark):
    rows = [(1, "f", 1, "home;away;home_goals;away_goals;odds_home", ""), (2, "f", 2, '"A ""x""; y";B ;2,0; 0 ;1,75', ""), (3, "f", 3, '"' + "q" * 100_000 + '";B;1;1;', ""), (4, None, 2, "x", ""), (5, "g", 2, "x,y", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x["line_id"]: x for x in loaded_lines(df).collect()}
    assert (got[2]["home"], got[2]["away"], got[2]["home_goals"], got[2]["odds_home"], got[2]["home_shots"]) == ('A "x"; y', "B", 2, 1.75, None)
    assert len(got[3]["home"]) == 100_000 and got[3]["odds_home"] is None
    assert {x["line_id"] for x in classified(df).where("verdict = 'no_header'").collect()} == {4, 5}
    assert failed_lines(df.limit(0)).count() == 0 and loaded_lines(df.limit(0)).count() == 0


def test_first_broken_field(spark):
    rows = [(1, "f", 1, "home,away,home_goals,away_goals", ""), (2, "f", 2, "A,B,x,1", ""), (3, "f", 3, 'A,"B,1,1', "")]
    got = {x["line_id"]: (x["verdict"], x["broken_field"]) for x in classified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {2: ("bad_value", "home_goals"), 3: ("quoting", "away")}


def test_failures_name_the_first_broken_field(spark, tmp_path):
    from matchlake.plans.data_queries import QUERIES

    lines = ["home,away,home_goals,away_goals,odds_home", "A,B,1,0,2.5", "A,B,1,x,y", 'A,B"c,1,0,', "A,B,1", "A,B,1,0,2.5,9", 'A,B,1,0,2.5,9"', " ,B,1,0,", '"A,B,1,0,1']
    rows = [(i, "f", i + 1, x) for i, x in enumerate(lines)]
    spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, line string").write.parquet(f"{tmp_path}/raw_results.parquet")
    got = {r["line_id"]: (r["reason"], r["broken_field"]) for r in QUERIES["p2_failures"](spark, str(tmp_path)).collect()}
    assert got == {2: ("bad_value", "away_goals"), 3: ("quoting", "away"), 4: ("column_count", "away_goals"), 5: ("column_count", None), 6: ("quoting", None), 7: ("bad_value", "home"), 8: ("quoting", "home")}
