"""License scans against brute force and SQL."""

import os
import re
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest import SF, read, write_tables  # noqa: E402

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_found(w):
    from tillpoint.llm.license_scan import rules
    from tillpoint.llm.license_rules import SPAN
    out = []
    for i, word in enumerate(w):
        snippet = " " + "  ".join(w[i:i + SPAN]) + " "
        for r in rules():
            if word in r.first and r.keyword in snippet and (m := re.match(r.regex, snippet)):
                out.append((i, r.cls, -m[0].count(" ") // 2, r.place, r.label))
    return sorted(out)


def brute(doc_id, text):
    w = words(text)
    base = [(i, name) for i in range(len(w)) for p, name in BASE.items() if w[i:i + len(p.split())] == p.split()]
    kept, now = [], None
    for x in brute_found(w):
        if now is None or x[0] >= now[0] - now[2]:
            kept.append(x)
            now = x
        elif x[1:4] < now[1:4]:
            kept[-1] = now = x
    own = {n for _, n in base}
    score = max([{1: 1.0, 2: 0.9, 3: 0.75, 4: 0.4}[x[1]] for x in kept] + [0.7] * bool(own) + [0.0])
    places = [i for i, _ in base]
    return (doc_id, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)),
            ",".join(sorted(own | {x[4] for x in kept})), score)


TEXTS = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
         "This work is licensed under the GNU General Public License, version 3.", "mit license apache license MIT\nLICENSE general public license",
         "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: Foo-1", "GPLv3 or GPL v3 or GPL-2.0+", "the mitlicense, mit licenses, MIT_License",
         "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
         "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "Creative Commons Attribution Non Commercial", "All rights reserved. Copyright (c) 2019",
         "dual-licensed: MIT license / Apache License 2.0", "K MIT Lİcense MIT License", "licensed", "public domain " * 400, "mit license " * 300, "mit\x00license\x7fé mit license"]


def check(spark, queries, path, rows):
    got = sorted(map(tuple, queries["op13_license_scan"](spark, path).collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t in rows), key=repr)
    return {r[0]: r for r in got}


def test_by_brute_force(spark, queries, tricky, empty):
    check(spark, queries, tricky, read(tricky))
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None, None, None), (0, TEXTS[4], None, None, None), (99, None, None, None, None)]
    got = check(spark, queries, write_tables(rows), [r[:2] for r in rows])
    assert got[1][5:] == ("apache", "apache,apache-2.0", 0.9)
    assert got[2][5:] == ("", "cc-by-nc-4.0", 0.9)
    assert got[3][6] == "gpl,gpl-3.0" and got[4][2:5] == (4, 0, 6) and got[8][2] == 1
    assert got[5][6] == "gpl-3.0-or-later" and got[6][6] == "spdx-other" and got[10][7] == 1.0 and got[99][1:] == (0, 0, None, None, "", "", 0.0)
    assert queries["op13_license_scan"](spark, empty).collect() == []


def test_sql_twin(spark, queries):
    from tillpoint.llm.queries import QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(QUERIES["op13_license_scan"][1])
    got = queries["op13_license_scan"](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert any(r[5] for r in got)


def test_no_python_in_the_plan(spark, queries):
    plan = queries["op13_license_scan"](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "Exchange"))


def test_rules_are_well_formed():
    from tillpoint.llm.license_scan import rules
    rs = rules()
    assert len(rs) > 200 and len({(r.label, r.regex) for r in rs}) == len(rs)
    for r in rs:
        re.compile(r.regex)
        assert r.cls in (1, 2, 3, 4) and r.keyword.isalnum() and "," not in r.label
    # every rule's keyword is a word that stands in its pattern, or in each choice of it
    assert all(any(r.keyword in part for part in (r.regex.replace("[cs]", "s"), " ".join(r.first))) for r in rs)


def test_detections_before_the_sweep_and_other_columns(spark):
    from tillpoint.llm.license_scan import classify, detections
    docs = spark.createDataFrame([(1, "under the GNU General Public License version 2 or later", 3, "x")], "key int, body string, n_words int, labels string")
    got = [(r.start, r.stop, r.label) for r in detections(docs, "key", "body").collect()]
    assert got == [(i, i - n, label) for i, _, n, _, label in brute_found(words("under the GNU General Public License version 2 or later"))]
    assert classify(docs, "key", "body").first().labels == "gpl,gpl-2.0-or-later"
