import csv
import random
import re

import pytest

from tidegrid.operators.dirty_rows import QuotingError, assemble, failed_rows, parse_lines, read_fields, valid_rows

A = "CollectDate,Domoic Result"
B = "Harvest Month,Harvest Date,Harvest Year,Domoic Acid"
SCHEMA = "line_id long, delivery_id long, line_no int, raw_line string, reason string, header string"


def frame(spark, *deliveries):
    rows = []
    for number, lines in enumerate(deliveries, 1):
        for at, line in enumerate(lines, 1):
            rows.append((len(rows) + 1, number, at, line, "clash", "clash"))
    return spark.createDataFrame(rows, SCHEMA), {r[3]: r[0] for r in rows}


CASES = {
    "1/2/2003,5": None, "01/02/03,<1": None, '"1/2/2003" , "1,200"': None, "1/2/2003,": None, "1/2/2003,< 1\r": None, " 1/2/2003\t, 5.50 ": None,
    '1/3/2003,""': None, "1/4/2003,12,5": "columns", "1/4/2003": "columns", ",1/4/2003,5": "columns",
    '1/5/2003,"5': "quoting", '1/5/2003,5"': "quoting", '"1/5/2003" x,5': "quoting", '1/5/2003,"5" ppm': "quoting", '1/5/2003,"5""': "quoting", '1/5,"/2003,5,6"x': "quoting",
    "2/30/2003,5": "values", "13/1/2003,5": "values", "1/2/203,5": "values", "1/2/2003,.5": "values", "1/2/2003,5.": "values", "1/2/2003,NaN": "values",
    "1/2/2003,1e3": "values", "1/2/2003,-1": "values", "1/2/2003,１": "values", '1/2/2003,"1,20"': "values", '1/2/2003,"12,34,567"': "values", "1-2-2003,5": "values", "1/2/2003,5\r6": "values", "1/2/2003,<": "values",
    A + " ": "values",
}


def test_reasons(spark):
    lines, ids = frame(spark, ["﻿" + A, *CASES, "", " \t\r", None])
    got = {r["line_id"]: r["reason"] for r in parse_lines(lines).collect()}
    assert got == {ids[line]: reason for line, reason in CASES.items()}
    assert {(r[0], r[1]) for r in failed_rows(parse_lines(lines)).collect()} == {(ids[x], y) for x, y in CASES.items() if y}


def test_named_months_and_values(spark):
    lines, ids = frame(spark, [B + "\r", "january,08,2002,1.5", "JUNE,1,2004,\"10,746\"", "Apr,1,2004,1", "June,1,04,1", "June,31,2004,1"])
    rows = {r["line_id"]: r for r in parse_lines(lines).collect()}
    assert str(rows[ids["january,08,2002,1.5"]]["measured_on"]) == "2002-01-08"
    assert rows[ids['JUNE,1,2004,"10,746"']]["result"] == 10746.0
    assert [rows[ids[x]]["reason"] for x in ("Apr,1,2004,1", "June,1,04,1", "June,31,2004,1")] == ["values"] * 3
    assert valid_rows(parse_lines(lines)).count() == 2


def test_unknown_header_missing_header_null_delivery_and_blocks(spark):
    rows = [(1, 1, 1, "a,b", "", ""), (2, 1, 2, "1/1/2003,5", "", ""), (3, 2, 2, "1/1/2003,5", "", ""), (4, None, 2, "1/1/2003,5", "", ""), (5, 3, 1, A, "", "")]
    rows += [(10 + n, 3, n, "1/1/2003,5", "", "") for n in range(2, 40)]
    got = {r["line_id"]: r["reason"] for r in parse_lines(spark.createDataFrame(rows, SCHEMA), block_lines=7).collect()}
    assert [got[i] for i in (2, 3, 4)] == ["header"] * 3
    assert all(got[10 + n] is None for n in range(2, 40))


def test_empty_and_long(spark):
    assert parse_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    lines, _ = frame(spark, [A, "1/1/2003," + "9" * 300_000, '1/1/2003,"' + "x" * 300_000])
    assert [r["reason"] for r in parse_lines(lines).orderBy("line_id").collect()] == [None, "quoting"]


def test_assembly():
    assert read_fields('a , "b ""c"", d" ,e') == ["a", 'b "c", d', "e"]
    assert assemble(' a , "b"\t,c\r') == 'a ,"b",c'
    for line in ('a"b,c', '"a" b', '"a', '"a"b', 'a,"b""', 'a, "b'):
        with pytest.raises(QuotingError):
            read_fields(line)


def by_characters(line):
    """The fields of a line, or None for bad quotes, read character by character after the statement."""
    fields, at, line = [], 0, line.strip(" \t\r")
    while True:
        begin = at
        while begin < len(line) and line[begin] in " \t\r":
            begin += 1
        if begin < len(line) and line[begin] == '"':
            text, at = "", begin + 1
            while True:
                if at >= len(line):
                    return None
                if line[at] == '"' and line[at + 1 : at + 2] == '"':
                    text, at = text + '"', at + 2
                elif line[at] == '"':
                    at += 1
                    break
                else:
                    text, at = text + line[at], at + 1
            while at < len(line) and line[at] in " \t\r":
                at += 1
            if at < len(line) and line[at] != ",":
                return None
        else:
            end = line.find(",", at)
            text, at = line[at : end if end >= 0 else len(line)], end if end >= 0 else len(line)
            if '"' in text:
                return None
        fields.append(text.strip(" \t\r"))
        if at >= len(line):
            return fields
        at += 1


def test_random_lines_are_decided_by_the_strict_reader():
    rng = random.Random(3)
    raised = afterwards = sound = 0
    for _ in range(60_000):
        line = "".join(rng.choice('"",, \t\rab1') for _ in range(rng.randrange(1, 14)))
        expected = by_characters(line) if line.strip(" \t\r") else []
        try:
            got = read_fields(line)
            sound += 1
        except QuotingError as error:
            got = None
            raised += isinstance(error.__cause__, csv.Error)
            afterwards += error.__cause__ is None
        assert (got and [x.replace("\r", "\t") for x in got]) == (expected and [x.replace("\r", "\t") for x in expected]) or blanks_apart(got, expected), line
    assert raised > afterwards > 0 and sound > 0


def blanks_apart(got, expected):
    """Blanks between a comma and a quote inside a quoted field may go."""
    squeeze = lambda fields: [re.sub(r"[ \t\r]", "", x) for x in fields]
    return got is not None and expected is not None and squeeze(got) == squeeze(expected)


def test_more_deliveries_than_are_broadcast(spark):
    lines, ids = frame(spark, [A, *CASES], ["no header", "1/1/2003,5"])
    few, many = (sorted(map(tuple, parse_lines(lines, broadcast_deliveries=n).collect()), key=repr) for n in (1, 1000))
    assert few == many and len(few) == len(CASES) + 1
