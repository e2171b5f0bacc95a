"""Pages taken apart: each builder on a page made for it, and whole documents through Spark."""

import base64
import io
import json
import zipfile
from xml.etree import ElementTree

import pytest

from galley import api, cli, errors
from galley.layout import infer, ir
from galley.layout import page as P
from galley.sinks import docx
from galley.sources import backends, synthetic
from galley.sources import docx as source


def line(text, x0, y0, size=10.0, width=None, **more):
    return {"kind": "line", "text": text, "x0": x0, "y0": y0, "x1": x0 + (width or 5.0 * len(text)), "y1": y0 + size, "size": size, "baseline": y0 + 0.8 * size, "font": "Arial", "bold": False, "italic": False, "mono": False, "dir_y": 0.0, "link": None} | more


def drawing(shape, x0, y0, x1, y1, fill=None, stroke=None, thick=1.0):
    return {"kind": "drawing", "shape": shape, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "fill": fill, "stroke": stroke, "thick": thick}


def assembled(*objects):
    return P.Page(list(objects), 612.0, 792.0, 72.0, 540.0).assemble()


def texts(table):
    return [[c["text"] for c in r] for r in table["rows"]]


def test_grid():
    rules = [drawing("hline", 72, y, 372, y, stroke="000000") for y in (100, 120, 140)] + [drawing("vline", x, 100, x, 140, stroke="000000") for x in (72, 172, 372)]
    shade = drawing("rect", 73, 101, 171, 119, fill="dddddd")
    cells = [line("a", 80, 105), line("b", 180, 105), line("c", 80, 125), line("d", 180, 122, 6.0), line("e", 180, 130, 6.0)]
    (table,) = assembled(*rules, shade, *cells)
    assert (table["kind"], table["style"], texts(table)) == ("table", "grid", [["a", "b"], ["c", "d\ne"]])
    assert [[c["fill"] for c in r] for r in table["rows"]] == [["dddddd", None], [None, None]]


def test_cards_and_stripes():
    cards = [drawing("rect", x, 100, x + 98, 150, fill="eeeeee") for x in (72, 172, 272)]
    (table,) = assembled(*cards, line("one", 80, 110), line("two", 180, 110), line("three", 280, 110))
    assert (table["style"], texts(table)) == ("cards", [["one", "two", "three"]])
    stripes = [drawing("rect", 72, y, 400, y + 15, fill="eeeeee" if i % 2 else "ffffff") for i, y in enumerate((100, 115, 130))]
    cells = [line(f"{c}{i}", x, y + 3) for i, y in enumerate((100, 115, 130)) for c, x in (("l", 80), ("r", 250))]
    (table,) = assembled(*stripes, *cells)
    assert (table["style"], texts(table)) == ("stripes", [["l0", "r0"], ["l1", "r1"], ["l2", "r2"]])


def test_rules_table_needs_rows_of_several_cells():
    rules = [drawing("hline", 72, y, 400, y) for y in (100, 120, 180)]
    cells = [line(f"{c}{i}", x, y) for i, y in enumerate((105, 130, 150)) for c, x in (("l", 80), ("r", 250))]
    (table,) = assembled(*rules, *cells)
    assert (table["style"], texts(table)) == ("rules", [["l0", "r0"], ["l1", "r1"], ["l2", "r2"]])
    kinds = [e["kind"] for e in assembled(*rules, line("only one cell", 80, 105), line("and one more", 80, 130))]
    assert "table" not in kinds and kinds.count("rule") == 3


def test_boxes_quotes_and_rules():
    made = assembled(
        drawing("rect", 72, 100, 300, 130, fill="eeeeee"), line("plain box", 80, 108), drawing("rect", 72, 200, 300, 230, fill="eeeeee"), line("x = 1", 80, 208, mono=True),
        drawing("rect", 72, 300, 300, 330, fill="eeeeee"), drawing("vline", 70, 300, 72, 330), line("in a quote", 80, 308), drawing("vline", 72, 400, 74, 430), line("by a bar", 84, 408), drawing("hline", 72, 500, 540, 501, stroke="aa0000"),
    )
    assert [(e["kind"], e.get("style"), e.get("text")) for e in made] == [("box", "box", "plain box"), ("box", "code", "x = 1"), ("box", "quote", "in a quote"), ("box", "quote", "by a bar"), ("rule", None, None)]


def test_figures_take_their_labels_and_no_more():
    chart = [drawing("curve", 100, 100, 300, 250), drawing("complex", 120, 120, 200, 200)]
    body = [line("a long line of the body that goes on for its whole width and more", 72, y, width=468) for y in (400, 414, 428, 442, 456, 470, 484)]
    figure, *rest = assembled(*chart, line("10", 85, 150), line("axis", 180, 255), line("inside", 150, 180), *body)
    assert figure["kind"] == "figure" and sorted(figure["text"].split("\n")) == ["10", "axis", "inside"]
    assert figure["x0"] == 83 and figure["y1"] == 267 and [e["kind"] for e in rest] == ["para"]
    bars = [drawing("rect", 100 + 24 * i, 200 - h, 120 + 24 * i, 200, fill="4444aa") for i, h in enumerate((20, 50, 90))]
    assert [e["kind"] for e in assembled(*bars)] == ["figure"]
    much = assembled(*chart, line("a label that is most of all the text", 110, 150, width=180), line("x", 500, 700))
    assert much[0]["kind"] == "figure" and much[0]["text"] == "" and {e["kind"] for e in much[1:]} == {"para"}


def test_paragraphs():
    made = assembled(
        line("A heading", 72, 80, 16.0, bold=True), *[line("words that fill a line up to the column's edge hyphen-" if i == 0 else "ated and on", 72, 120 + 13 * i, width=468 if i < 7 else 200) for i in range(8)],
        line("•", 72, 260), line("first item", 90, 260), line("•", 72, 274), line("second item", 90, 274), line("12.", 72, 288), line("numbered", 90, 288), line("centred", 288.5, 340), line("right", 515, 390), line("left", 72, 440),
    )
    assert [(e["text"][:15], e["align"], e["marker"]) for e in made] == [
        ("A heading", "left", None), ("words that fill", "justify", None), ("• first item", "left", "•"), ("• second item", "left", "•"), ("12. numbered", "left", "12."), ("centred", "center", None), ("right", "right", None), ("left", "left", None),
    ]
    assert "hyphenated" in made[1]["text"] and made[1]["leading"] == 13 and made[1]["n_lines"] == 8
    assert assembled() == []


@pytest.fixture(scope="module")
def document(spark, tmp_path_factory):
    pages = []
    for p in range(1, 6):
        lines = [line(f"Report page {p}", 72, 30), line(f"{p} of 5", 280, 760)]
        drawings = [drawing("rect", 0, 0, 612, 792, fill="fafafa")]
        glyphs = []
        if p == 1:
            lines += [line("The title", 72, 80, 20.0, bold=True), line("draft", 300, 300, dir_y=0.7)]
            lines += [line(f"the body of the text, line {i}", 72, 110 + 13 * i, width=468 if i < 9 else 300) for i in range(10)]
            lines += [line(f"item {i}", 90, 300 + 20 * i) for i in range(3)]
            drawings += [drawing("rect", 80, 302 + 20 * i, 84, 306 + 20 * i, fill="000000") for i in range(2)]
            glyphs += [{"x0": 80, "y0": 342, "x1": 84, "y1": 346, "size": 10.0}]
        if p in (2, 3):
            top = 600 if p == 2 else 72
            drawings += [drawing("rect", 72, top + 20 * i, 400, top + 20 * i + 20, fill="eeeeee") for i in range(4)]
            lines += [line(("name" if c == 0 else "value") if i == 0 else f"{'ab'[c]}{p}{i}", 80 + 150 * c, top + 20 * i + 5) for i in range(4) for c in range(2)]
        if p == 2:
            lines += [line("text before the table", 72, 100)]
        if p == 5:
            drawings += [drawing("curve", 100, 100, 300, 300)]
            lines += [line(f"body of page five {i}", 72, 400 + 13 * i, width=468) for i in range(6)]
        pages.append({"doc_id": 1, "page": p, "page_w": 612.0, "page_h": 792.0, "lines": lines, "drawings": drawings, "images": [], "glyphs": glyphs})
    pages.append({"doc_id": 2, "page": 1, "page_w": 612.0, "page_h": 792.0, "lines": [line("alone", 72, 400)], "drawings": [], "images": [{"x0": 72, "y0": 100, "x1": 200, "y1": 200, "data": None}], "glyphs": []})
    path = tmp_path_factory.mktemp("ir") / "pages.json"
    path.write_text("\n".join(json.dumps(p) for p in pages))
    return str(path)


def test_documents_through_spark(spark, document):
    elements = infer.infer(ir.objects(ir.read_pages(spark, document)))
    rows = sorted((r.asDict() for r in elements.collect()), key=lambda r: (r["doc_id"], r["page"], r["kind"] == "footer", r["kind"] != "header", r["seq"]))
    one = [r for r in rows if r["doc_id"] == 1]
    assert [r["text"] for r in one if r["kind"] == "header"] == ["Report page {PAGE}"] * 5 and [r["text"] for r in one if r["kind"] == "footer"][0] == "{PAGE} of {NUMPAGES}"
    first = [(r["kind"], r["text"]) for r in one if r["page"] == 1 and r["kind"] not in ("header", "footer")]
    assert first[0] == ("heading", "The title") and [t for _, t in first if t.startswith("•")] == ["• item 0", "• item 1 item 2"] and not any("draft" in t for _, t in first)
    tables = [r for r in one if r["kind"] == "table"]
    assert len(tables) == 1 and tables[0]["page"] == 2
    detail = json.loads(tables[0]["detail"])
    assert detail["pages"] == 2 and [[c["text"] for c in r] for r in detail["rows"]] == [["name", "value"], *[[f"a{p}{i}", f"b{p}{i}"] for p in (2, 3) for i in (1, 2, 3)]]
    assert [r["kind"] for r in one if r["page"] == 5] == ["header", "figure", "para", "footer"]
    assert sorted(r["kind"] for r in rows if r["doc_id"] == 2) == ["image", "para"]


def test_empty_table_of_objects(spark):
    assert infer.infer(spark.createDataFrame([], ir.OBJECTS)).count() == 0


def test_margins(spark, document):
    got = {r.doc_id: (r.col_l, r.col_r) for r in infer.margins(ir.objects(ir.read_pages(spark, document))).collect()}
    assert got[1][0] == 72 and got[1][1] == 540 and got[2] == (72, 540)


def test_paragraph_packages_still_write():
    assert docx.package([{"runs": [{"text": "x"}]}])[:2] == b"PK"


def names(content):
    return zipfile.ZipFile(io.BytesIO(content)).namelist()


def part(content, name="word/document.xml"):
    return ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read(name))


def test_writer_of_elements():
    w = "{" + docx.W + "}"
    png = base64.b64encode(b"\x89PNG\r\n\x1a\n" + bytes(20)).decode()
    at = {"page": 1, "x0": 72.0, "x1": 540.0, "y0": 100.0, "y1": 120.0}
    elements = [
        {"kind": "heading", "style": "level 2", "text": "Head", "size": 16.0, **at}, {"kind": "para", "text": "see", "detail": {"dest_at": [2, 300.0]}, **at}, {"kind": "para", "text": "site", "detail": {"link": "https://a/?x=1&y=2", "first_indent": -10}, **at},
        {"kind": "table", "detail": {"pages": 2, "rows": [[{"text": "a", "fill": "eeeeee"}, {"text": "b"}], [{"text": ""}, {"text": ""}]]}, **at}, {"kind": "image", "detail": {"data": png}, **at}, {"kind": "figure", "text": "chart", "detail": {}, **at},
        {"kind": "rule", "detail": {"fill": "aa0000"}, **at}, {"kind": "box", "style": "code", "text": "x\ny", "detail": {"fill": "eeeeee"}, **at}, {"kind": "para", "text": "there \x00", "page": 2, "x0": 72.0, "x1": 540.0, "y0": 290.0, "y1": 310.0},
    ]
    content = docx.package(docx.planned_bookmarks(elements), headers=["Page {PAGE}"], footers=["{PAGE} of {NUMPAGES}"], columns=2)
    body = part(content)
    assert {"word/header1.xml", "word/footer1.xml", "word/media/image1.png"} <= set(names(content))
    assert [x.get(w + "val") for x in body.iter(w + "outlineLvl")] == ["1"] and [x.get(w + "name") for x in body.iter(w + "bookmarkStart")] == ["dest_2_300"]
    links = list(body.iter(w + "hyperlink"))
    assert links[0].get(w + "anchor") == "dest_2_300" and "https://a/?x=1&amp;y=2" in zipfile.ZipFile(io.BytesIO(content)).read("word/_rels/document.xml.rels").decode()
    tables = list(body.iter(w + "tbl"))
    assert len(tables) == 2 and len(list(tables[0].iter(w + "tblHeader"))) == 1 and [x.get(w + "hRule") for x in tables[0].iter(w + "trHeight")] == ["atLeast"]
    assert [x.text.strip() for x in part(content, "word/footer1.xml").iter(w + "instrText")] == ["PAGE", "NUMPAGES"] and body.find(f".//{w}cols").get(w + "num") == "2"
    assert "\x00" not in "".join(t.text or "" for t in body.iter(w + "t"))
    docx.validate(content)
    with pytest.raises(ValueError):
        empty = io.BytesIO()
        zipfile.ZipFile(empty, "w").close()
        docx.validate(empty.getvalue())


def test_convert_a_folder(spark, document, tmp_path):
    out = str(tmp_path / "out")
    assert cli.main(["convert", document, out], spark) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".docx") == ["1.docx", "2.docx"]
    text = source.live_text((tmp_path / "out" / "1.docx").read_bytes()) if hasattr(source, "live_text") else "".join(t.text or "" for t in part((tmp_path / "out" / "1.docx").read_bytes()).iter("{" + docx.W + "}t"))
    assert "The title" in str(text) and "the body of the text, line 9" in str(text)


def test_options_and_errors(spark, tmp_path, capsys):
    assert api.Options.of({"rounds": 2, "renderer": "libreoffice"}).refine_rounds == 2
    for bad in ({"target": "x"}, {"rounds": 2}, {"what": 1}, {"max_pages": 0}):
        with pytest.raises(errors.InvalidOptions):
            api.Options.of(bad)
    assert cli.main(["convert", str(tmp_path / "none.json"), str(tmp_path)], spark) == errors.EXIT_CODES["input_missing"]
    assert json.loads(capsys.readouterr().err.strip().split("\n")[-1])["code"] == "input_missing"
    (tmp_path / "bad.json").write_text("no json\n")
    assert cli.main(["convert", str(tmp_path / "bad.json"), str(tmp_path)], spark) == errors.EXIT_CODES["input_malformed"]
    assert errors.safe(KeyError("/secret/path")) == {"code": "internal", "message": "KeyError"}
    with pytest.raises(errors.RenderFailed):
        api.renderer("none at all")


def test_preflight(spark):
    page = lambda d, p, n: (d, p, 612.0, 792.0, [], [(0.0, 0.0, 1.0, 1.0, "rect", None, None, 1.0)] * n, [], [])
    rows = spark.createDataFrame([page(d, p, int(d != 3)) for d in range(1, 7) for p in range(1, 4 if d != 2 else 8)], ir.PAGE)
    got = {r.doc_id: r.status for r in api.preflight(rows, api.Options(max_pages=5, max_run_pages=7)).collect()}
    assert got == {1: "ready", 2: "refused", 3: "refused", 4: "ready", 5: "failed", 6: "skipped"}


def test_scans_of_objects(spark):
    cjk = line("ab 漢字 cd", 0.0, 0.0, width=80.0)
    rows = ir.objects(spark.createDataFrame([(1, 1, 612.0, 792.0, [tuple(x[c] for c in LINE) for x in (cjk, line("go", 10.0, 50.0, link="https://x"), line("on", 10.0, 62.0, link="https://x"))], [], [(0.0, 0.0, 612.0, 300.0, None)], [(1.0, 1.0, 3.0, 3.0, 4.0)])], ir.PAGE))
    got = [(w.word, w.x0, w.x1) for w in ir.words(rows).where("oid = 0").orderBy("k").collect()]
    assert got == [("ab", 0, 20), ("漢", 30, 40), ("字", 40, 50), ("cd", 60, 80)]
    assert [(r.uri, r.y0, r.y1) for r in ir.links(rows).collect()] == [("https://x", 50, 72)]
    assert [tuple(r[c] for c in ("n_lines", "n_images", "n_glyphs", "visual")) for r in ir.census(rows).collect()] == [(3, 1, 1, True)]
    assert ir.light_lines(rows).count() == 3


LINE = ("x0", "y0", "x1", "y1", "text", "size", "baseline", "font", "bold", "italic", "mono", "dir_y", "link")


def test_edge_cases_and_backends(spark, document):
    made = infer.infer(ir.objects(synthetic.edge_cases(spark)))
    assert sorted((r.doc_id, r.page, r.text) for r in made.collect() if r.kind != "header") == [(1, 1, "landscape"), (2, 1, "first"), (2, 2, "second"), (3, 1, "straight"), (4, 1, "t"), (5, 1, "HUGE")]
    assert backends.select("json")(spark, document).count() == 6
    with pytest.raises(errors.InvalidOptions):
        backends.select("none at all")


def test_pages_of_texts_against_the_fold(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(2300))), (2, "short"), (3, None), (4, "")], "doc_id bigint, text string")
    rows = ir.objects(synthetic.from_text(docs))
    made = {(r.doc_id, r.page, r.seq): r for r in infer.infer(rows).collect() if r.kind not in ("header", "footer")}
    edges = {r.doc_id: (r.col_l, r.col_r) for r in infer.margins(rows).collect()}
    pages = {}
    for r in rows.collect():
        if not (r.kind == "line" and (r.y0 < 62 or r.y0 > 750)) or r.doc_id == 2:
            pages.setdefault((r.doc_id, r.page), []).append(r.asDict())
    want = 0
    for (d, p), objects in pages.items():
        for seq, e in enumerate(P.Page(objects, 612.0, 792.0, *edges[d]).assemble()):
            want += 1
            got = made[d, p, seq]
            assert (got.kind if got.kind != "heading" else "para", got.x0, got.y0, got.text) == (e["kind"], e["x0"], e["y0"], e.get("text")), (d, p, seq)
    assert want == len(made) and {r.kind for r in made.values()} >= {"para", "table", "figure"}
