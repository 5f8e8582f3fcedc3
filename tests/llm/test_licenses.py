import random

import numpy as np
import pytest

from seriesmill.llm import licenses as lic
from seriesmill.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return lic.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def expected(text, model):
    out = []
    for i, p in enumerate((text or "").split("\n")):
        family, probability = lic.predict(p, model)
        if family != lic.NONE:
            out.append((i, family, round(probability, 6)))
    return out


def compare(docs, model):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id or -1, [(m.paragraph, m.family, round(m.probability, 6)) for m in r.matches]) for r in lic.scan(docs, model).collect()), key=str)
    assert got == sorted(((i or -1, expected(t, model)) for i, t in texts), key=str)


def test_table(spark, model):
    compare(spark.read.parquet(f"{SF}/documents.parquet"), model)


def test_altered_notices_and_odd_rows(spark, model):
    rng = random.Random(3)
    rows = [(None, "Released under the MIT License."), (1, None), (1, ""), (1, ""), (2, " \n \n"), (3, "É\nLicensed under the Apache License, Version 2.0.\n" + "x " * 3000)]
    sources = [t for own in lic.TEMPLATES.values() for t in own] + list(lic.OTHER_TERMS) + list(lic.NO_TERMS)
    for i in range(300):
        own = [w for w in rng.choice(sources).split() if rng.random() > 0.15]
        rows.append((10 + i, "Some words before\n" + " ".join(own) + rng.choice(["", " and more of the text", "\nlast line"])))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, matches string, words int").repartition(4)
    compare(docs, model)
    assert lic.scan(docs.limit(0), model).count() == 0


def test_families_are_found(model):
    for family, own in lic.TEMPLATES.items():
        for text in own:
            assert lic.predict(text, model)[0] == family
            assert lic.predict(text.upper() + " Some words of another kind follow.", model)[0] == family
    for text in lic.OTHER_TERMS:
        assert lic.predict(text, model)[0] == lic.UNKNOWN
    for text in (*lic.NO_TERMS, "", "plain words of a text"):
        assert lic.predict(text, model)[0] == lic.NONE


def test_unconfirmed_family_is_unknown(model):
    family, _ = lic.predict("Mozilla Public License", model)
    assert family in (lic.UNKNOWN, lic.NONE)


def test_planted_lines_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    wanted = {"Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache"}
    for r in queries.op1_licenses(spark, SF).collect():
        for line, family in wanted.items():
            assert (line in docs[r.doc_id].split("\n")) == (family in r.families.split(","))


def test_plan_has_no_python(spark):
    plan = queries.op1_licenses(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_no_background(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lic.predict("Released under the MIT License.", lic.fit(docs))[0] == "mit"


@pytest.mark.parametrize("line, family", [("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("All rights reserved.", lic.UNKNOWN)])
def test_frequent_notices_are_found(spark, line, family):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["river", "stone", "green", "walks", "often", "the", "of"]) for _ in range(12)) + ("\n" + line if i % 3 == 0 else "")) for i in range(90)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, line if i < 2 else "plain words") for i in range(50)], "doc_id long, text string")):
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in lic.scan(docs, lic.fit(docs)).collect():
            assert [m.family for m in r.matches] == ([family] if line in texts[r.doc_id] else [])


def test_pairs_without_their_words_pass_the_filters(spark):
    """A model may keep a pair and drop both its words."""
    weights = np.zeros((1, len(lic.CLASSES)))
    weights[0, lic.CLASSES.index("mit")] = 50
    offset = np.zeros(len(lic.CLASSES))
    offset[lic.CLASSES.index(lic.NONE)] = 20
    model = {"grams": ["mit license"], "weights": weights, "offset": offset}
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "plain")], "doc_id long, text string")
    compare(docs, model)
    assert [len(r.matches) for r in sorted(lic.scan(docs, model).collect())] == [1, 0]


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.",
    "mit": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software\nand associated documentation files.",
    "mpl": "This Source Code Form is subject\nto the terms of the Mozilla\nPublic License, v. 2.0.",
}


def test_wrapped_notices(spark, model):
    rows, wanted = [], {}
    for k, (family, notice) in enumerate(WRAPPED.items()):
        for j, mark in enumerate(["", "# ", " * ", "// ", "-- "]):
            lines = "\n".join(mark + p for p in notice.split("\n"))
            for i, text in enumerate([lines, f"river stone green\nwalks often\n{lines}\nriver stone green\n" * 3, f"/*\n{lines}\n*/\nint main()"]):
                rows.append((k * 100 + j * 10 + i, text))
                wanted[rows[-1][0]] = family
    rows += [(1000, "\n".join("of the river by the stone in the sun" for _ in range(40))), (1001, None), (1002, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = lic.scan(docs, model)
    for r in found.select("*", lic.all_matches(found["matches"], found["notices"]).alias("all")).collect():
        got = [(n.paragraph, n.family, round(n.probability, 6)) for n in r.notices]
        plain = [(i, *lic.predict(p, model)) for i, p in lic.notice_runs(texts[r.doc_id] or "")]
        assert got == [(i, f, round(p, 6)) for i, f, p in plain if f != lic.NONE]
        assert {m.family for m in r["all"]} == ({wanted[r.doc_id]} if r.doc_id in wanted else set()), texts[r.doc_id]


def test_wrapped_notices_of_the_sample(spark):
    """Lines of wrapped notices in the corpus are no examples of text without a licence."""
    docs = spark.createDataFrame([(i, f"river stone green\n\n{WRAPPED['gpl' if i % 2 else 'bsd']}\n\nwalks often") for i in range(60)], "doc_id long, text string")
    for r in lic.scan(docs, lic.fit(docs)).collect():
        assert [n.family for n in r.notices] == ["gpl" if r.doc_id % 2 else "bsd"]
