"""Licence rules on a small fixture, wrapped and listed texts, and the empty cases."""

import textwrap

from lintlake.llm import licenses as L

MIT = "\n\n".join(textwrap.fill(L.SENTENCES[k], 70) for k in ("mit-grant", "mit-notice")) + "\n\n" + textwrap.fill(L.SENTENCES["mit-as-is"] + " " + L.SENTENCES["mit-liable"], 70)


def test_scan(spark):
    rows = [
        (1, "Words.\n" + MIT + "\nMore words"), (2, None), (3, ""), (4, "junk | junk |\nLicensed under CC BY-NC 4.0."),
        (5, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (6, L.SENTENCES["gpl-free"] + " " + L.SENTENCES["gpl-hope"] + " " + L.SENTENCES["gpl-see"]),
        (7, L.SENTENCES["mit-notice"] + " " + L.SENTENCES["mit-grant"] + " x"), (8, "We discuss the MIT License. at length version 2.0."), (8, "All rights reserved."),
        (None, "x " * 200_000 + ". Licensed under CC BY 4.0."),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rules string, n_known int")
    got = sorted(((r.doc_id or 0, r.doc_id is None, list(r.licenses), r.n_known) for r in L.scan_licenses(docs).collect()), key=repr)
    assert got == sorted([
        (1, False, ["MIT"], 4), (2, False, [], 0), (3, False, [], 0), (4, False, ["CC-BY-NC-4.0"], 1), (5, False, ["Apache-2.0", "MIT"], 3),
        (6, False, ["GPL-3.0-or-later"], 5), (7, False, [], 2), (8, False, [], 0), (8, False, ["LicenseRef-All-Rights-Reserved"], 1), (0, True, ["CC-BY-4.0"], 1),
    ], key=repr)
    rules = {r.doc_id: r.rules for r in L.scan_licenses(docs).collect()}
    assert rules[6] == ["GPL-3.0-or-later:gpl-free+gpl-hope+gpl-see"]


def test_plan_is_native_and_narrow(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = L.license_digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_every_rule_matches_its_own_sentences(spark):
    docs = spark.createDataFrame([(i, " ".join(L.SENTENCES[x] for x in ids)) for i, (_, ids) in enumerate(L.RULES)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in L.scan_licenses(docs).collect()}
    for i, (licence, _) in enumerate(L.RULES):
        assert licence in got[i], (licence, got[i])
