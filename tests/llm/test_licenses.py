import re

from corpusloom.llm import licenses

from .conftest import awkward_rows

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def brute(rows):
    out = []
    for i, text in rows:
        w, places = words(text or ""), []
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
        base, more, share = {x for _, x in places}, set(), 0.0
        for label, value in windows(text or "").items():
            more.add(label)
            share = max(share, value)
        starts = [k for k, _ in places]
        out.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | more), 1.0 if places else share))
    return sorted(out, key=repr)


MORE = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License\nx",
        "x\nPermission is hereby granted free of charge, to any person obtaining a copy of this program", "MIT\nLicense", "mit license mit mit license cc by cc",
        "redistribution and use in source or binary form with modification are permitted", "permitted are modification without with forms binary and source in use redistribution or",
        "ＭIT license K gnu general public licenſe", "you may not use this file except in compliance with the License", "licensed under cc by nc 4"]


def test_against_brute_force(spark, awkward, no_rows):
    rows = [r[:2] for r in awkward_rows()] + [(1000 + i, t) for i, t in enumerate(MORE)]
    df = awkward.unionByName(spark.createDataFrame(rows[-len(MORE):], "doc_id long, text string"), allowMissingColumns=True)
    assert sorted((tuple(r) for r in licenses.scan(df).collect()), key=repr) == brute(rows)
    assert licenses.scan(no_rows).count() == 0


def test_functions_only(awkward, capsys):
    licenses.scan(awkward).explain()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", capsys.readouterr().out)


WRAPPED = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")",
            "/*\n * Permission is hereby\n * granted, free of charge,\n * to any person\r\n * obtaining a copy\n * of this software\n */"],
    "bsd": ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"],
}


def windows(text):
    """Largest share of each template in any window of as many words, over line breaks."""
    w, out = words(text), {}
    for label, template in licenses.TEMPLATES:
        t = template.split()
        n = max(len(set(t) & set(w[i:i + len(t)])) for i in range(max(len(w) - len(t), 0) + 1))
        if 100 * n >= licenses.PERCENT * len(set(t)):
            out[label] = max(out.get(label, 0.0), n / len(set(t)))
    return out


def test_wrapped_sentences(spark):
    """A sentence is found wherever its lines break and wherever it starts; its words scattered over lines are none."""
    cases = [(t, label) for label, texts in WRAPPED.items() for t in texts]
    rows = [(" ".join(f"w{j}" for j in range(n)) + "\n" + t + "\nend " * n, label) for t, label in cases for n in (0, 1, 20, 21, 22, 23, 43, 150)]
    rows += [("\n".join(f"{x} and more words here" for x in t.split()), None) for t, _ in cases]
    # The words of several templates on one long line, far apart, are none either.
    rows += [(" ".join(f"{x} " + "word " * 300 for _, t in licenses.TEMPLATES[-6:] for x in t.split() if x not in ("mit", "license", "gnu")), None)]
    # One word lost of sixteen is tolerated, two are not.
    rows += [("Permission is hereby granted free of charge to any\nperson obtaining a copy of this program", "mit"),
             ("Permission is hereby granted free of charge to any\nperson obtaining a copy of the program", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    for i, (text, label) in enumerate(rows):
        want = windows(text)
        assert sorted(want) == ([label] if label else [])
        assert got[i] == (sorted(want), max(want.values(), default=0.0)), text
