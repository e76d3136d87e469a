import textwrap

import duckdb

from loomtext.llm import license_scan as ls

TEXTS = [
    "Words.\nReleased under the MIT License.\nMore words",
    "LICENSED UNDER the apache license, version 2.0!",
    "a b c. This work is licensed under\nthe GNU General Public License,\nversion 3. End",
    "Permission to use.\n" + "\n".join(ls.TEXTS["ISC"][0].split(", ")),
    ls.TEXTS["MPL-2.0"][0] + "\n" + ls.TEXTS["MPL-2.0"][1],
    ls.TEXTS["MPL-2.0"][1] + " " + ls.TEXTS["MPL-2.0"][0],
    " ".join(ls.TEXTS["BSD-3-Clause"]) + " Then. Licensed under CC BY-NC 4.0.",
    "released under the mit license", "Unreleased under the MIT License.", "", None, "word " * 50_000,
]


def licenses(spark, texts):
    return {r["id"]: (r["licenses"], r["sentence_ids"]) for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_rules_and_their_order(spark):
    got = {i: x[0] for i, x in licenses(spark, TEXTS).items()}
    assert got[0] == ["MIT"] and got[1] == ["Apache-2.0"] and got[2] == ["GPL-3.0"] and got[7] == ["MIT"]
    assert got[4] == ["MPL-2.0"] and got[5] == [] and got[6] == ["BSD-3-Clause", "CC-BY-NC-4.0"]
    assert got[8] == got[9] == got[10] == got[11] == []


def test_oracle_agrees(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, n_known, sentences, licenses FROM ({ls.oracle()})").fetchall())
    assert sorted(tuple(r) for r in ls.op9_licenses(spark, str(tmp_path)).collect()) == want


def test_wrapped_texts_below_lines_without_a_full_stop(spark):
    wrap = lambda text, mark="": "\n".join(mark + x for x in textwrap.wrap(text, 70))
    mit = wrap(ls.TEXTS["MIT"][0].split(" The above")[0]) + "\n\n" + wrap("The above" + ls.TEXTS["MIT"][0].split(" The above")[1]) + "\n\n" + wrap(ls.TEXTS["MIT"][1])
    texts = [
        "MIT License\n\nCopyright (c) 2024 Jane Roe\n\n" + mit,
        "The MIT License (MIT)\nCopyright (c) 2024 Jane Roe\n" + mit,
        "ISC License\n\nCopyright (c) 2024, Jane Roe\n\n" + wrap(ls.TEXTS["ISC"][0]) + "\n\n" + wrap(ls.TEXTS["ISC"][1]),
        " * roe - a program\n * Copyright (C) 2024 Jane Roe\n *\n" + wrap(" ".join(ls.TEXTS["GPL-3.0"]), " * "),
        "Heading\nThis work is licensed under\nthe MIT License.",
        "Heading\nThis work is licensed under\nthe MIT License\n\nand more words follow",
        "Heading\nThis work is licensed under\nthe MIT Licensees", "This work is licensed under\n" * 20_000,
    ]
    got = licenses(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == [["MIT"], ["MIT"], ["ISC"], ["GPL-3.0"], ["MIT"], ["MIT"], [], []]


def test_every_text_and_preamble_names_its_licence_alone(spark):
    wrap = lambda parts: "Heading\n\n" + "\n".join(textwrap.wrap(" ".join(parts) + " Next.", 70))
    want = [(licence, [p if p[-1] in ".;" else p + "." for p in parts]) for group in (ls.TEXTS, ls.PREAMBLES) for licence, parts in group.items()]
    want += [(licence, (f"To view a copy of this license, visit https://creativecommons.org/{path}/.",)) for licence, path in ls.DEEDS.items()]
    got = licenses(spark, [wrap(parts) for _, parts in want] + [" ".join(parts) + " Next." for _, parts in want])
    assert [got[i][0] for i in range(2 * len(want))] == 2 * [[licence] for licence, _ in want]


def test_every_notice_is_found(spark):
    known, rules = ls.rules()
    texts = [n.format(name) + "." for names in ls.NAMES.values() for name in names for n in ls.NOTICES]
    assert all(x[0] for x in licenses(spark, texts).values())
    assert max(i for _, seq in rules for i in seq) == len(known)


def test_odd_documents(odd, empty):
    assert sorted(str(r["id"]) for r in ls.scan(odd).collect()) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert ls.scan(empty).collect() == []
