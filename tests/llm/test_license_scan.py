"""Licence scan: canonical forms and odd rows; the whole table is compared with its SQL in test_queries.py."""

import os
import re

import pytest
from pyspark.sql import functions as F

from chargeload.llm import license_scan as lic


def scan(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, digest int")
    return {r.doc_id: (r.license, r.notices) for r in lic.scan_licenses(df, **options).collect()}


MIT = next(t for i, t in lic.KNOWN if i == "MIT" and len(t) > 500)


@pytest.mark.parametrize("change", [
    lambda t: t, str.upper, lambda t: re.sub(" ", "\n  ", t), lambda t: t.replace("\"", "“").replace(",", " ,"), lambda t: "Copyright (c) 2019 Some Body\n\n" + t,
    lambda t: "© 2001-2003 The Authors. All rights reserved.\n" + t, lambda t: t.replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS"), lambda t: "/*\n * (C) 1999 X\n * " + t.replace(". ", ".\n * ") + "\n */",
])
def test_whole_licences_in_other_dress(spark, change):
    assert scan(spark, [(1, change(MIT), None, 1)])[1][0] == "MIT"


def test_other_texts_stay_clear(spark):
    rows = [(1, MIT[:-1] + " and more words", "x", 1), (2, "We talked about the Apache License, Version 2.0.", "x", 1), (3, "A story. Released under the MIT License. The end.\nLicensed under CC BY-NC 4.0.", "x", 1)]
    got = scan(spark, rows)
    assert got[1][0] is None and got[2] == (None, "") and got[3] == (None, "CC-BY-NC-4.0,MIT")


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "", None, 1), (None, "Released under the MIT licence!", None, 1), (3, "word " * 200_000 + "\nLicensed under CC BY 4.0.", None, 1), (4, "Licensed under CC BY 4.0.", None, 1), (4, "Released under the MIT License.", None, 1)]
    got = scan(spark, rows)
    assert got[1] == got[2] == (None, "")
    assert got[None] == ("MIT", "MIT")
    assert got[3] == (None, "CC-BY-4.0")
    assert got[4] == ("CC-BY-4.0", "CC-BY-4.0,MIT")
    assert scan(spark, []) == {}


def test_known_table_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(lic, "MAX_KNOWN", 2)
    with pytest.raises(ValueError, match="more than 2"):
        scan(spark, [(1, "x", None, 1)])


def test_own_table(spark):
    known = spark.createDataFrame([("own", "Our License text.")], "license_id string, text string")
    assert scan(spark, [(1, "our LICENCE text", None, 1)], known=known)[1] == ("own", "own")
    assert F


def test_full_texts_and_notices_of_several_paragraphs(spark):
    if not os.path.exists("/usr/share/common-licenses/GPL-3"):
        pytest.skip("no licence texts on this machine")
    with open("/usr/share/common-licenses/GPL-3") as f:
        gpl = f.read()
    lines = re.sub(r"(.{60}\S*) ", r"\1\n", MIT.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE"))
    inside = f"A readme of some project.\n\nCopyright (c) 2020 Some Body\n\n{lines}\n\nAnd more words follow."
    rows = [(1, gpl, None, 1), (2, inside, None, 1), (3, "int x;\n/*\n" + "".join(f" * {x}\n" for x in inside.split("\n")) + " */", None, 1), (4, inside.replace("free of charge", "for a fee"), None, 1)]
    got = scan(spark, rows)
    assert got[1][0] == "GPL-3.0"
    assert got[2] == got[3] == (None, "MIT")
    assert got[4] == (None, "")
