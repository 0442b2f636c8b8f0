import pytest
from helpers import frame, odd_rows

from canopy.llm import licenses
from canopy.llm.queries import op8_licenses


@pytest.fixture(scope="module")
def model():
    return licenses.train()


def test_templates_are_known(model):
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            found, p, cover = model.judge(t)
            assert found == family and p >= licenses.LEAST and cover == pytest.approx(1)


def test_others_are_unknown(model):
    for t in [*licenses.ALIKE, "", "nothing of the kind", "the version of the work", "a licensed driver may use the public road under any condition"]:
        assert model.judge(t)[0] == licenses.UNKNOWN


def test_in_context(model):
    assert model.judge("foo bar Licensed under the Apache License, Version 2.0. baz qux")[0] == "apache-2.0"
    assert model.judge("copyright (c) x. released under the MIT license; see file")[0] == "mit"


def test_spark_agrees_with_the_model(spark, model):
    lines = [t for texts in licenses.TEMPLATES.values() for t in texts] + list(licenses.ALIKE)
    rows = [*odd_rows(), *[(100 + i, f"first line\n\n{t}\nlast", "en", "a", 1) for i, t in enumerate(lines)]]
    rows += [(300, lines[0] + "\n" + lines[2], "en", "a", 1), (301, lines[2] + "\n" + lines[2], "en", "a", 1)]
    found = {(r.doc_id, r.pos, r.family): (r.score, r.cover, r.confirmed) for r in licenses.paragraphs(frame(spark, rows, True), model).collect()}
    wanted = {}
    for doc_id, text, *_ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            family, p, cover = model.judge(line)
            if family != licenses.UNKNOWN:
                wanted[doc_id, pos, family] = (p, cover, cover >= licenses.COVERED)
    assert found.keys() == wanted.keys()
    for k in found:
        assert found[k] == pytest.approx(wanted[k])
    per = {r.doc_id: r for r in licenses.scan(frame(spark, rows), model=model).collect()}
    assert (per[300].licenses, per[300].n_paragraphs) == ("agpl,apache-2.0", 2) and (per[301].licenses, per[301].n_paragraphs) == ("apache-2.0", 2)
    assert (per[4].licenses, per[4].n_paragraphs, per[4].score) == ("", 0, 0.0)
    assert licenses.scan(frame(spark, rows), model=model).count() == len(rows)


def test_repeated_rows_count_once(spark, model):
    text = "Released under the MIT License."
    found = licenses.scan(frame(spark, [(1, text, "en", "a", 1), (1, text, "en", "a", 1)]), model=model).collect()
    assert [(r.licenses, r.n_paragraphs) for r in found] == [("mit", 1)] * 2


def test_empty(spark, model):
    assert licenses.scan(frame(spark, odd_rows()).limit(0), model=model).count() == 0


def test_planted_lines(spark, sf):
    sf = sf.replace("0.001", "0.01")
    planted = {"gpl": "GNU General Public License, version 3", "cc-by-nc": "Licensed under CC BY-NC 4.0", "mit": "Released under the MIT License", "apache-2.0": "Licensed under the Apache License, Version 2.0", "proprietary": "All rights reserved."}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_licenses(spark, sf).collect():
        assert r.licenses == ",".join(sorted(k for k, v in planted.items() if v in texts[r.doc_id]))


MIT = """MIT License

Copyright (c) 2020 A. Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""

GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""


def test_wrapped_notices(spark, model):
    narrow = MIT.replace(", ", ",\n").replace("any person", "any\nperson")
    texts = {
        1: (MIT, "mit", 1), 2: (GPL, "gpl", 1), 3: (f"{GPL}\n\nsome words\n\n{MIT}", "gpl,mit", 2), 4: (narrow, "mit", 1),
        5: (f"Released under the MIT License.\n\n{MIT}", "mit", 2), 6: ("one\ntwo\n\nthe software\nof any person", "", 0),
        7: ("word " * 400 + GPL.replace("/*\n * ", "").replace("\n */", "") + " word" * 400, "gpl", 1), 8: ("a line\n\n\n" * 50, "", 0), 9: (MIT.replace("\n", "\n\n"), "", 0),
    }
    rows = [(i, t, "en", "a", 1) for i, (t, _, _) in texts.items()] + [(1, MIT, "en", "a", 1)] + [r for r in odd_rows() if r[0] is None]
    found = licenses.scan(frame(spark, rows), model=model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.licenses, r.n_paragraphs) == (texts[r.doc_id][1:] if r.doc_id else ("", 0)), r


def test_documents_are_judged_by_their_own_text(spark, model):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "Released under the MIT License."), (1, "nothing here at all"), (None, gpl), (None, "plain words"), (None, "Licensed under CC BY-SA 4.0."), (2, "one\nAll rights reserved.\ntwo")]
    found = licenses.scan(frame(spark, [(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)]), model=model).collect()
    got = sorted(((r.doc_id, r.licenses) for r in found), key=repr)
    assert got == sorted([(1, "mit"), (1, ""), (None, "gpl"), (None, ""), (None, "cc-by-sa"), (2, "proprietary")], key=repr)


def test_held_out_notices(model):
    """Notices in other words than the templates', one for each line of a usual file head."""
    held_out = {
        "mit": ["This project is licensed under the MIT License", "Distributed under the MIT license.", "Code released under the MIT License (MIT)."],
        "apache-2.0": ["Licensed to you under the Apache License, Version 2.0", "This code is released under the Apache License, Version 2.0.", "Apache License, Version 2.0, January 2004. Licensed under the Apache License"],
        "gpl": ["This file is licensed under the GNU General Public License, version 2.", "Licensed under the GPL v2 or any later version.", "The code is licensed under the GNU General Public License version 3"],
        "bsd": ["Released under the BSD 2-Clause License.", "The use of this source code is governed by a BSD-style license", "Redistribution and use in source and binary forms are permitted provided that the following conditions are met"],
        "cc-by": ["This text is licensed under a Creative Commons Attribution 4.0 International License", "Content licensed under CC BY 4.0"],
        "cc-by-sa": ["All text is available under the Creative Commons Attribution-ShareAlike License", "licensed under CC BY-SA 4.0, see below"],
        "mpl-2.0": ["This file is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the MPL 2.0 license"],
        "proprietary": ["Copyright 2020 Nobody. All rights reserved.", "This file is proprietary and confidential; copying of this file is strictly prohibited"],
    }
    judged = [(f, *model.judge(t)) for f, texts in held_out.items() for t in texts]
    assert sum(f == g and c >= licenses.COVERED for f, g, _, c in judged) >= 0.9 * len(judged), judged
