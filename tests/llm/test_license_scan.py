import random

import pytest

from lendlens.llm import license_scan as ls
from tests.llm.fixtures import awkward_docs, empty_docs, sentence


@pytest.fixture(scope="module")
def trained(spark):
    return ls.train(awkward_docs(spark, 60))


def test_held_out_accuracy(trained):
    _, figures = trained
    assert figures["held_out"] > 150 and figures["accuracy"] > 0.95 and figures["least"] >= 0.5


def test_templates_are_named_and_other_sentences_are_not(trained):
    model, _ = trained
    for family, texts in ls.TEMPLATES.items():
        for t in texts:
            assert {s[1] for s in model.scan("first line\n" + t)} == {family}, t
            assert all(s[0] == 1 for s in model.scan("first line\n" + t))
    for t in ls.OTHERS:
        assert model.scan(t) == []
    rng = random.Random(2)
    for family, texts in ls.TEMPLATES.items():  # inside a long paragraph
        found = model.scan(sentence(rng, 200) + ". " + texts[0] + " " + sentence(rng, 200))
        assert {s[1] for s in found} == {family}, (family, found)


def test_awkward_documents(spark, trained):
    model, _ = trained
    docs = awkward_docs(spark)
    rows = docs.collect()
    got = ls.scan_licenses(docs, model).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(r.doc_id) for r in rows)
    assert all(r.spans == [] for r in got)
    more = spark.createDataFrame([(1, "x\nReleased under the MIT License.\nAll rights reserved."), (1, None), (None, "Licensed under CC BY 4.0.")], "doc_id long, text string")
    spans = sorted((str(r.id), [(s.line_no, s.family) for s in r.spans]) for r in ls.scan_licenses(more, model).collect())
    assert spans == [("1", []), ("1", [(1, "mit"), (2, "all-rights-reserved")]), ("None", [(0, "cc-by")])]
    assert ls.scan_licenses(empty_docs(spark), model).collect() == []


def test_training_without_documents(spark):
    model, figures = ls.train(empty_docs(spark))
    assert model.scan("Released under the MIT License.")[0][1] == "mit" and figures["accuracy"] > 0.9


NOTICES = {  # wordings that are no templates
    "agpl": ["This program is free software; you may redistribute it under the terms of the GNU Affero General Public License as published by the Free Software "
             "Foundation, version 3 or later.", "SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the GNU Affero General Public License v3.0"],
    "apache": ["License: Apache License 2.0", "Apache License 2.0", "This project is licensed under the terms of the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Distributed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["CC-BY-4.0", "Photo licensed under Creative Commons Attribution 3.0", "Text is available under CC BY 3.0"],
    "cc-by-nc": ["CC-BY-NC-3.0", "Licensed under a Creative Commons Attribution-NonCommercial 3.0 license"],
    "cc-by-sa": ["Licensed CC-BY-SA 3.0", "Creative Commons Attribution-ShareAlike 2.0 license"],
    "cc0": ["CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"],
    "gpl": ["Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-2.0-or-later",
            "This file is part of Foo. It is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
             "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License v2.1"],
    "mit": ["MIT License", "This project is licensed under the terms of the MIT license.", "Code is distributed under the MIT License."],
    "mpl": ["Distributed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
}
PROSE = ["Their licence to sell beer expired in 2019.", "He has the right to remain silent and all rights are explained to him.", "The museum is free and open to the general public.",
         "She asked for permission to leave.", "The software version 2 was slower than version 1.", "Public domain films were shown every Sunday.",
         "The copyright holder could not be found.", "A commons is land for the creative use of all."]


def test_notices_in_other_words(trained):
    model, _ = trained
    for family, texts in NOTICES.items():
        for t in texts:
            assert {s[1] for s in model.scan(t)} == {family}, (family, t, model.name(ls.words(t)))
    for t in PROSE:
        assert model.scan(t) == [], (t, model.scan(t))


def test_wrapped_notices_are_paragraphs(trained):
    model, _ = trained
    body = ("Permission is hereby granted, free of\ncharge, to any person obtaining a copy of this software and\nassociated documentation files, to deal in the Software\n"
            "without restriction, including without limitation the rights to use, copy,\nmodify, merge, publish, distribute, sublicense, and/or sell copies")
    found = model.scan("Some words first.\n\n" + body + "\n\nLast words.")
    assert [(s[0], s[1]) for s in found] and {s[1] for s in found} == {"mit"}
    header = "This program is free software: you can\nredistribute it and/or modify it under the terms of the GNU\nAffero General Public License as published by the Free Software\nFoundation"
    assert {s[1] for s in model.scan(header)} == {"agpl"}
    assert ls.paragraphs("a\nb\n\n \nc\n") == [(0, ["a", "b"]), (4, ["c"])] and ls.paragraphs("") == []


def test_scan_equals_a_plain_reading(spark, trained):
    """Every notice planted in whole documents is found at its line, and nothing else is."""
    rng = random.Random(4)
    model, _ = trained
    planted, rows = {}, []
    every = [(f, t) for f, ts in NOTICES.items() for t in ts] + [(f, t) for f, ts in ls.TEMPLATES.items() for t in ts[:1]]
    for i, (family, notice) in enumerate(every):
        lines = [sentence(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(2, 12))]
        at = rng.randrange(len(lines))
        lines[at] = notice
        planted[i] = [(at, family)]
        rows.append((i, "\n\n".join(lines) if i % 2 else "\n".join(lines)))
        if i % 2:
            planted[i] = [(2 * at, family)]
    for j in range(40):
        rows.append((1000 + j, "\n".join(sentence(rng, 20) for _ in range(6)) + "\n" + rng.choice(PROSE)))
        planted[1000 + j] = []
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: [(s.line_no, s.family) for s in r.spans] for r in ls.scan_licenses(df, model).collect()}
    assert got == planted


def test_wrapped_notices_in_paragraphs_of_any_length(trained):
    """Every paragraph is judged, however many lines it has, and a long one may hold several notices."""
    model, _ = trained
    rng = random.Random(8)
    mit = ("Permission is hereby granted, free of\ncharge, to any person obtaining a copy of this software and\nassociated documentation files, to deal in the Software\n"
           "without restriction, including without limitation the rights to use, copy,\nmodify, merge, publish, distribute, sublicense, and/or sell copies")
    agpl = "This program is free software: you can\nredistribute it and/or modify it under the terms of the GNU\nAffero General Public License as published by the Free Software\nFoundation"

    def prose(n):
        return "\n".join(sentence(rng, 8) for _ in range(n))
    for before, after in ((30, 30), (0, 36), (37, 0), (500, 300)):
        found = model.scan(f"{prose(before)}\n{mit}\n{prose(after)}".strip("\n"))
        assert [s[1] for s in found] == ["mit"] and found[0][0] <= before <= found[0][0] + ls.PARAGRAPH, (before, after, found)
    assert [s[1] for s in model.scan("\n".join([prose(50), mit, prose(90), agpl, prose(50)]))] == ["mit", "agpl"]
    for line in PROSE:
        assert model.scan("\n".join([prose(60), line, prose(60)])) == [] == model.scan(sentence(rng, 200) + " " + line + " " + sentence(rng, 200))
