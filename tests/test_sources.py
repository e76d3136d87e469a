import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators import catalogue_match
from loomtext.operators import concordance as cc
from loomtext.params import ConcordanceParams
from loomtext.sources import catalogs, html, references, sinks, tei

TEXT = "如是我聞一時佛在舍衛國祇樹給孤獨園與大比丘眾千二百五十人俱"
DOC = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:cb="http://www.cbeta.org/ns/1.0" xml:id="T01n0001"><teiHeader><title xml:lang="zh-Hant" level="m">長阿含</title><author>某</author><extent>22卷</extent>
<char xml:id="C1"><charProp><localName>normalized form</localName><value>甲</value></charProp><mapping type="unicode">U+4E01</mapping></char>
<char xml:id="C2"><mapping type="unicode">U+20000</mapping></char></teiHeader>
<text><body><cb:docNumber>No. 1 [Nos. 5-7, 9]</cb:docNumber><cb:div type="xu"><p>序文<note>註</note>後<g ref="#C1">x</g></p></cb:div><cb:div type="other"></cb:div>
<cb:div type="jing"><p>%s<lb/>尾<app><lem>正</lem><rdg>異</rdg>失</app><!-- 評 -->末<g ref="#C2"/></p><p cb:type="dharani">唵嘛</p><p>呢</p></cb:div></body></text></TEI>"""


def corpus(tmp_path):
    (tmp_path / "T").mkdir()
    (tmp_path / "T" / "T01n0001_002.xml").write_text(DOC % ("第二" + TEXT))
    (tmp_path / "T" / "T01n0001_001.xml").write_text(DOC % TEXT)
    (tmp_path / "T" / "T01n0002_001.xml").write_text("<TEI><broken>")
    (tmp_path / "T" / "readme.xml").write_text("<a/>")
    return str(tmp_path / "T")


def test_tei(spark, tmp_path):
    files = tei.files(spark, corpus(tmp_path))
    assert files.count() == 3 and [r["path"][-16:] for r in tei.malformed(files).collect()] == ["T01n0002_001.xml"]
    chars = {r["id"]: r["ch"] for r in tei.character_table(files).collect()}
    assert chars == {"C1": "甲", "C2": "\U00020000"}
    (got,) = tei.texts(files, chars).collect()
    one = f"序文後甲{TEXT}尾正末\U00020000唵嘛呢"
    assert got["full_text"] == one + one.replace(TEXT, "第二" + TEXT)
    assert [s["div_type"] for s in got["segments"]] == ["xu", "jing", "xu", "jing"] and all(got["full_text"][s["start"] : s["end"]] == s["text"] for s in got["segments"])
    assert [got["full_text"][r["start"] : r["end"]] for r in got["dharani_ranges"]] == ["唵嘛", "唵嘛"]
    assert (got["title"], got["author"], got["extent_juan"], got["docnumber_refs"], got["file_count"], got["has_dharani"]) == ("長阿含", "某", 22, ["5", "6", "7", "9"], 2, True)
    main = spark.createDataFrame([got], tei.texts(files, chars).schema).select(tei.main_text()).first()[0]
    assert main == "".join(s["text"] for s in got["segments"] if s["div_type"] == "jing")
    assert tei.texts(files, chars, min_length=500).count() == 0


def test_code_points():
    assert [tei.code_point(x) for x in ("U+4E00", "U+20000", "4E00", None, "U+FFFFFF")] == ["一", "\U00020000", None, None, None]


def test_reference_fields(spark):
    df = spark.createDataFrame([("[Nos. 251-253]",), ("No. 7",), ("",)], "r string")
    assert [r[0] for r in df.select(references.numbers_in(F.col("r"))).collect()] == [[251, 252, 253], [7], []]
    got = spark.createDataFrame([("To. 45-47, (100), 7n3, 1-900",)], "f string").select(references.field_numbers(F.col("f"), "To").alias("x")).first()["x"]
    assert [(x["number"], x["secondary"]) for x in got] == [(45, False), (46, False), (47, False), (7, False), (3, False), (1, False), (900, False), (100, True)]
    whole = spark.createDataFrame([("To. 1-900",)], "f string").select(F.size(references.field_numbers(F.col("f"), "To", None))).first()[0]
    assert whole == 900


def test_catalogues(spark, tmp_path):
    xml = spark.createDataFrame([("<item><rkts>12</rkts><ref>D45</ref><ref>Q7,01</ref><ref>D45</ref></item><item><rkts>x</rkts><ref>D1</ref></item>",)], "text string")
    assert [tuple(r)[:2] for r in catalogs.collection_items(xml, "D").collect()] == [("12", "45")]
    assert [tuple(r)[:2] for r in catalogs.collection_items(xml, "Q").collect()] == [("12", "7,01")]
    refs = spark.createDataFrame([("ma26",), ("t1509",), ("mn69",), ("~sn1.1",), ("dnx",), ("sa-2.5",)], "r string").select(catalogs.classify_reference(F.col("r")))
    assert [r[0] for r in refs.collect()] == ["agama", "taisho", "pali", "pali", "other", "agama"]
    groups = spark.createDataFrame([(["ma26", "mn69", "~mn70"],), (["ma26", "mn69"],)], "refs array<string>")
    assert sorted(map(tuple, catalogs.parallel_groups(groups).collect())) == [("ma", "mn69", True, ["ma26"], 2), ("ma", "mn70", False, ["ma26"], 1)]
    (tmp_path / "T1-D2.tsv").write_text("a\tb\n1\t2\n\n3\t4\n")
    assert [tuple(r) for r in catalogs.sentence_pair_files(spark, str(tmp_path)).collect()] == [("T1-D2.tsv", 2)]
    assert catalogs.json_or_empty(spark, f"{tmp_path}/none.json", "a int").collect() == []
    (tmp_path / "bad.json").write_text('{"a": ')
    with pytest.warns(UserWarning, match="no JSON"):
        assert catalogs.json_or_empty(spark, f"{tmp_path}/bad.json", "a int", warn=True).collect() == []
    with pytest.warns(UserWarning, match="missing"):
        assert catalogs.json_or_empty(spark, f"{tmp_path}/none.json", "a int", warn=True).collect() == []
    body = spark.createDataFrame([("/x/toh12_toh13a.xml", "see Taishō 251 and taisho/t00223")], "path string, text string")
    assert sorted(map(tuple, catalogs.embedded_references(body).collect())) == [("12", "223"), ("12", "251"), ("13a", "223"), ("13a", "251")]
    cited = spark.createDataFrame([("silk2019", [("T1", "Toh 1", None, "n"), ("T2", "Toh 2", "li2021", None)])], "citation_key string, links array<struct<taisho:string,tohoku:string,source_key:string,note:string>>")
    assert [r["source"] for r in catalogs.citations(cited).collect()] == ["silk2019", "li2021"]
    page = spark.createDataFrame([("<table><tr><th>Title </th><td><b>Heart</b></td></tr></table>",)], "h string")
    assert page.select(html.labelled_cell(F.col("h"), "Title")).first()[0] == "Heart"


def test_stage_store(spark, tmp_path):
    store = sinks.StageStore(spark, str(tmp_path / "store"))
    df = spark.range(5)
    assert store.load("a", {"n": 1}, "f") is None
    store.save("a", df, {"n": 1}, "f")
    assert store.load("a", {"n": 1}, "f").count() == 5
    assert store.load("a", {"n": 2}, "f") is None and store.load("a", {"n": 1}, "g") is None


def test_exports(spark, tmp_path):
    links = spark.createDataFrame([("T1", "Toh 2", ["b", "a", "c"]), ("T1", "Toh 1", ["x<"])], "text_id string, ref_id string, sources array<string>")
    assert sinks.tei_links(links).first()["xml"] == '<linkGrp type="parallels"><link target="#T1 #Toh 1" cert="low" source="x&lt;"/><link target="#T1 #Toh 2" cert="high" source="a b c"/></linkGrp>'
    scores = spark.createDataFrame([("a", "b", "digest", 0.51234), ("c", "d", "no_relationship", 0.1)], "digest_id string, source_id string, classification string, confidence double")
    page = sinks.summary(scores, {"texts": 2})
    assert "- digest: 1" in page and "excerpt" not in page and "1. a from b: digest, 0.5123" in page and "c from d" not in page
    sinks.csv_export(scores, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    assert sinks.relationships(scores).first()["confidence"] == 0.5123


def test_link_classes(spark):
    rows = [("a", 1, "lancaster", None), ("a", 2, "mitra", 0.95), ("a", 3, "mitra", 0.5), ("a", 4, "rkts", None), ("b", 1, "mitra", 0.2), ("a", 5, "lancaster", None), ("c", 1, "lancaster", None), ("c", 1, "mitra", 0.9), ("f", 9, "rkts_concordance", None)]
    rows += [("e", i, "mitra", 0.95) for i in range(5)] + [("g", i, "mitra", 0.95) for i in range(4)]
    att = cc.merge(spark.createDataFrame([(*r, None, "1") for r in rows], "text_id string, ref_id int, source string, confidence double, note string, seq string"))
    errors = spark.createDataFrame([("a", 5, None, 6), ("c", 1, "lancaster", None)], "text_id string, ref_id int, source string, correct_ref int")
    rel = spark.createDataFrame([("b", "a")], "digest_id string, source_id string")
    got = {(r["text_id"], r["ref_id"]): r["link_class"] for r in cc.classify_links(cc.flag_errors(att, errors), rel, ConcordanceParams()).collect()}
    assert got[("a", 1)] == "parallel" and got[("a", 2)] == "parallel:computational" and got[("a", 3)] == "uncertain" and got[("a", 4)] == "chinese_to_tibetan"
    assert got[("b", 1)] == "indirect:inherited" and got[("a", 5)] == "error:flagged" and got[("c", 1)] == "parallel" and got[("f", 9)] == "uncertain"
    assert {got["e", i] for i in range(5)} == {"indirect:quotation"} and {got["g", i] for i in range(4)} == {"parallel:computational"}


ALL_PALI = "dn mn sn an dhp snp ud iti thag thig ja kp pv vv cp cnd mnd tha-ap thi-ap mil ne pe ds vb dt pp kv ya patthana".split()


def test_every_prefix_is_known(spark):
    kind = lambda refs: [r[0] for r in spark.createDataFrame([(r,) for r in refs], "r string").select(catalogs.classify_reference(F.col("r"))).collect()]
    assert set(kind([p for p in ALL_PALI] + [f"{p}1" for p in ALL_PALI] + [f"~{p}.2#3" for p in ALL_PALI] + ["pli-tv-kd1", "pli-tvx"])) == {"pali"}
    assert kind(["sa.5", "sa-2.180", "ea44", "da", "dax", "t9", "tx", "uv1", ""]) == ["agama"] * 3 + ["other"] * 2 + ["taisho"] + ["other"] * 3


def test_citation_errors(spark):
    df = spark.createDataFrame([("silk", [("T1", "121", "error", "wrong"), ("T2", "Toh 5", None, "")])], "citation_key string, errors array<struct<taisho:string,tohoku:string,status:string,note:string>>")
    assert [tuple(r) for r in catalogs.citation_errors(df).collect()] == [("T1", "Toh 121", "silk:error", "[error] wrong"), ("T2", "Toh 5", "silk:error", "[error]")]


SEGMENTS = [("d", "s", 0, 0, 4, 10, 14, "exact"), ("d", "s", 1, 4, 6, -1, -1, "novel"), ("d", "s", 2, 6, 9, 20, 23, "phonetic"), ("e", "s", 0, 0, 9, -1, -1, "novel")]
SEGMENT = "digest_id string, source_id string, segment int, digest_start int, digest_end int, source_start int, source_end int, match_type string"


def test_alignment_sinks(spark, tmp_path):
    seg = spark.createDataFrame(SEGMENTS, SEGMENT)
    scores = spark.createDataFrame([("d", "s", "digest", 0.5)], "digest_id string, source_id string, classification string, confidence double")
    mapping = spark.createDataFrame([("d", "s", 2, [("a", "x", "b")])], "digest_id string, source_id string, segment int, mapping array<struct<a:string,s:string,b:string>>")
    (row,) = sinks.alignment_rows(seg, scores, mapping).collect()
    assert [x["match_type"] for x in row["segments"]] == ["exact", "novel", "phonetic"] and [x["mapping"] is not None for x in row["segments"]] == [False, False, True]
    sinks.alignment_export(seg, scores, f"{tmp_path}/a")
    assert [r["digest_id"] for r in spark.read.json(f"{tmp_path}/a").collect()] == ["d"]
    page = sinks.visualised([x.asDict() for x in row["segments"]], "abcdefghi", "0123456789" * 3)
    assert page.split("\n")[0].startswith("[     0-     4] exact    abcd") and "0123" in page and "a~b(x)" in page and "novel    ef" in page
    texts = spark.createDataFrame([("T1", "text one", "title"), ("T2", "text two", "t")], "text_id string, full_text string, title string")
    sinks.text_export(texts, f"{tmp_path}/t")
    assert sorted(tuple(r) for r in spark.read.text(f"{tmp_path}/t/texts").collect()) == [("text one", "T1"), ("text two", "T2")]
    assert spark.read.json(f"{tmp_path}/t/metadata").count() == 2


def test_pages(spark):
    checks = spark.createDataFrame([("b", "PASS"), ("a", "FAIL")], "name string, status string")
    assert "Result: FAIL, 1 passed, 1 failed" in sinks.validation_page(checks) and "Result: PASS" in sinks.validation_page(checks.where("name = 'b'"))
    scores = spark.createDataFrame([("a", "b", "digest", 0.5), ("c", "b", "digest", 0.75)], "digest_id string, source_id string, classification string, confidence double")
    titles = spark.createDataFrame([("a", "One | two*"), ("b", "B")], "id string, title string")
    (page,) = [r["page"] for r in sinks.readable_pages(scores, titles).collect()]
    assert page.split("\n")[4:6] == ["| c | B | 0.7500 |", "| One \\| two\\* | B | 0.5000 |"]
    clusters = spark.createDataFrame([("b", 2, "a;c")], "source_id string, n long, digests string")
    multi = spark.createDataFrame([("a", 2, 0.4, 0.6)], "digest_id string, n_sources long, best_coverage double, combined_coverage double")
    text = sinks.summary(scores, {}, clusters=clusters, multi=multi, drawn=[("a from b", "x\n")])
    assert "- b: 2 (a;c)" in text and "- a: 2 sources, 0.6000 against 0.4000" in text and "### a from b" in text
    judged = spark.createDataFrame([(1, "T1", "MATCH", 95), (2, "T1", "MATCH", 70), (3, "T2", "NO_MATCH", 99)], "entry_id int, text_id string, verdict string, certainty int")
    counts = cc.verdict_summary(judged, spark.createDataFrame([("T1",)], "text_id string"))
    review = sinks.review_page(judged, counts)
    assert "- validated: 2" in review and "## High\n- 1 is T1: 95" in review and "3 is T2" not in review


def test_concordance_sinks(spark, tmp_path):
    att = spark.createDataFrame([("T1", "Toh 2", "mitra", 0.5, None), ("T1", "Toh 2", "lancaster", None, "n"), ("T1", "Otani 9", "rkts_concordance", None, None), ("T2", "mn1", "suttacentral_parallels", 0.9, None)], "text_id string, ref_id string, source string, confidence double, note string")
    classes = spark.createDataFrame([("T1", "Toh 2", "parallel"), ("T1", "Otani 9", "uncertain"), ("T2", "mn1", "parallel")], "text_id string, ref_id string, link_class string")
    parts = {"tibetan": "Toh ", "otani": "Otani "}
    sinks.concordance_export(sinks.concordance_rows(att, att, classes, parts), f"{tmp_path}/c")
    rows = {r["text_id"]: r for line in spark.read.text(f"{tmp_path}/c").collect() for r in [json.loads(line["value"])]}
    assert rows["T1"]["tibetan"] == ["Toh 2"] and rows["T1"]["otani"] == ["Otani 9"] and [x["source"] for x in rows["T1"]["link_provenance"]["Toh 2"]] == ["lancaster", "mitra"]
    assert rows["T1"]["link_classifications"] == {"Otani 9": "uncertain", "Toh 2": "parallel"} and rows["T2"]["tibetan"] == []
    (one, two) = sinks.verified_rows(att, classes, parts).orderBy("text_id").collect()
    assert [x["source"] for x in one["link_provenance"]["Toh 2"]] == ["lancaster"] and list(one["link_provenance"]) == ["Toh 2"] and two["text_id"] == "T2"
    links = spark.createDataFrame([("T2", "Toh 2", ["b"]), ("T1", "Toh 1", ["x"])], "text_id string, ref_id string, sources array<string>")
    sinks.tei_document(links, "Links", f"{tmp_path}/tei")
    text = "".join(r["value"] for r in spark.read.text(f"{tmp_path}/tei").collect())
    assert text.startswith("<TEI") and text.endswith("</standOff></TEI>") and text.index("#T1") < text.index("#T2")


def test_candidates_between_catalogues(spark):
    entries = [("e1", "sutra", "Nj 5", "佛說心經", None), ("e2", "sutra", None, "大般若經", "Vajra-cchedikā"), ("e3", "other", None, "甲乙丙丁", "completely different words"), ("e4", "vinaya", None, "心經", "Aṣṭasāhasrikā Prajñā"), ("e5", "sutra", None, None, "saddharma pundarika sutram")]
    texts = [("T08n0251", 8, "心經", "Hṛdaya"), ("T08n0220", 8, "般若經", "Vajracchedikā"), ("T22n1421", 22, "心經律", "prajna astasahasrika"), ("T30n0001", 30, "甲乙丙戊", "x"), ("T09n0262", 9, None, "saddharma pundarika sutra")]
    sections = [("sutra", 5, 9), ("vinaya", 22, 24)]
    numbers = [("Nj 5", "T30n0001"), ("Nj 6", "T08n0220")]
    got = catalogue_match.candidates(
        spark.createDataFrame(entries, "entry_id string, section string, number string, title string, other_title string"), spark.createDataFrame(texts, "text_id string, volume int, title string, other_title string"),
        spark.createDataFrame(sections, "section string, low int, high int"), spark.createDataFrame(numbers, "number string, text_id string"), ("佛說", "大"), "\\x{4E00}-\\x{9FFF}",
    )
    assert {(r["entry_id"], r["text_id"]): (r["signal"], r["score"]) for r in got.collect()} == {
        ("e1", "T30n0001"): ("number", 1.0), ("e1", "T08n0251"): ("title", 0.95), ("e2", "T08n0220"): ("title", 0.95), ("e3", "T30n0001"): ("title", 0.6),
        ("e4", "T22n1421"): ("title", 0.9), ("e5", "T09n0262"): ("token", 0.5),
    }


def test_merging_rules(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    frames = {
        "existing": make([("T1", "Toh 1")], "text_id string, ref_id string"), "mitra": make([("T1", "Toh 2", 0.89), ("T1", "Toh 3", 0.9), ("T1", "Toh 1", 0.1)], "text_id string, ref_id string, confidence double"),
        "sanskrit_title_match": make([("T1", "Toh 4", False), ("T1", "Toh 5", True)], "text_id string, ref_id string, active boolean"), "silk": make([("T1", "Toh 6", "silk:error")], "text_id string, ref_id string, source string"),
    }
    all_ = cc.enriched(cc.attestations_of(frames, 0.9), make([("Toh 1", "Otani 7"), ("Toh 2", "Otani 8")], "ref_id string, otani string"))
    assert {(r["ref_id"], r["n_sources"]) for r in cc.active_links(all_).collect()} == {("Toh 1", 2), ("Toh 3", 1), ("Toh 5", 1), ("Otani 7", 1)}
    pairs = make([(1, "T1")], "entry_id int, text_id string")
    assert [tuple(r) for r in cc.verdicts_or_uncertain(pairs).select("verdict", "certainty").collect()] == [("UNCERTAIN", 50)]
