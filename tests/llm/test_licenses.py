from __future__ import annotations

import re

import pytest

from codeloom.llm import licenses as li

from .helpers import DOCS, documents, prose, rows


def value(text):
    return li.evaluate(li.postfix(text.lower())[0])


@pytest.mark.parametrize(
    ("text", "expression", "category"),
    [
        ("MIT", "MIT", 0),
        ("mit OR gpl-3.0", "MIT OR GPL-3.0-only", 0),
        ("MIT AND GPL-3.0-only", "MIT AND GPL-3.0-only", 2),
        ("MIT OR Apache-2.0 AND GPL-2.0-only", "MIT OR Apache-2.0 AND GPL-2.0-only", 0),
        ("(MIT OR Apache-2.0) AND GPL-2.0-only", "(MIT OR Apache-2.0) AND GPL-2.0-only", 2),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0", 1),
        ("GPL-2.0-only WITH no-such-thing", "GPL-2.0-only WITH no-such-thing", 2),
        ("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", 1),
        ("((MIT))", "MIT", 0),
        ("never-heard-of", "never-heard-of", 3),
        ("MIT. Then", "MIT", 0),
    ],
)
def test_expressions(text, expression, category):
    name, _, found = value(text)
    assert (name, found) == (expression, category)


@pytest.mark.parametrize("text", ["", "OR MIT", "(MIT", "MIT AND", "()", "MIT WITH (MIT)", "(MIT OR ISC) WITH llvm-exception"])
def test_bad_expressions(text):
    with pytest.raises(li.ExpressionError):
        value(text)


def test_an_expression_has_no_length_limit(spark):
    long = " OR ".join(["(GPL-3.0-only AND MPL-2.0)"] * 400 + ["MIT"])
    r = li.licenses(documents(spark, [f"SPDX-License-Identifier: {long}\nMIT AND GPL-3.0-only"])).first()
    assert r["category"] == "permissive" and r["expression"].endswith("OR MIT")


def test_tags_notices_and_both(spark):
    texts = [
        "// SPDX-License-Identifier: MIT OR GPL-3.0-only\ncode",
        "Released under the\nMIT License, " + prose(1, 200_000),
        "SPDX-License-Identifier: MIT\n... licensed under CC BY-NC 4.0",
        "SPDX-License-Identifier: AND\n",
        "license-expression: (MIT\nreleased under the mit license",
        prose(2, 50), None, "",
        "Licensed under the Apache License, Version 2.0 (the License)",
    ]
    got = {r["doc_id"]: r for r in li.licenses(documents(spark, texts)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 9]
    assert (got[1]["category"], got[1]["allowed"], got[1]["n_tags"], got[1]["licenses"]) == ("permissive", True, 1, "GPL-3.0-only,MIT")
    assert (got[2]["expression"], got[2]["n_notices"]) == ("MIT", 1)
    assert (got[3]["expression"], got[3]["category"], got[3]["allowed"]) == ("CC-BY-NC-4.0; MIT", "restricted", False)
    assert got[4]["expression"] is None and got[4]["problem"] and not got[4]["allowed"]
    assert got[5]["expression"] == "MIT" and got[5]["problem"] and not got[5]["allowed"]
    assert (got[9]["expression"], got[9]["n_notices"]) == ("Apache-2.0", 1)


def test_nulls_repeats_clashing_names_and_no_rows(spark):
    data = [(None, "@license MIT", "x"), (None, "@license MIT", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, expression string").selectExpr("*", "1 AS n_tags", "true AS allowed")
    assert rows(li.licenses(docs), "doc_id", "expression") == [(None, "MIT")] * 2
    assert li.licenses(spark.createDataFrame([], DOCS)).count() == 0


def brute(text):
    """(tags, notices) by regular expressions; longer phrases before those that they hold."""
    low = re.sub(r"[\t\n\v\f\r]", " ", (text or "").lower())
    phrases = "|".join(re.escape(p) for p in sorted(li.PHRASES, key=len, reverse=True))
    return sum(low.count(t) for t in li.TAGS), [li.PHRASES[m] for m in re.findall(phrases, low)]


def test_whole_query_agrees_with_brute_force(spark):
    from codeloom.llm.queries import op5_licenses

    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in op5_licenses(spark, sf_dir).collect()}
    want = {i: brute(t) for i, t in texts.items()}
    assert set(got) == {i for i, (tags, notices) in want.items() if tags or notices} and got
    for i, r in got.items():
        tags, notices = want[i]
        assert (r["n_tags"], r["n_notices"]) == (tags, len(notices))
        assert set(notices) <= set((r["licenses"] or "").split(","))


GPL = "under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"


@pytest.mark.parametrize("begin", ["", "    ", "\t", " * ", "# ", "// ", ";; ", "-- ", "dnl ", "REM ", "% ", "> "])
@pytest.mark.parametrize("end", ["\n", "\r\n", " \n\n", " *\n"])
def test_notices_over_several_lines(begin, end):
    finder = li.automaton()
    for text, name in ((GPL, "GPL-2.0-or-later"), (BSD, "BSD-3-Clause"), ("the  MIT \t License (MIT)", "MIT")):
        found = li.scan_text("".join(begin + line + end for line in ["x", *text.split("\n"), "SPDX-License-Identifier:  ISC", "y"]), finder, 0)
        assert found[:2] == (1, 1) and found[3] == ",".join(sorted([name, "ISC"]))
