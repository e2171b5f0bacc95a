"""Word packages from elements of a layout, written with the standard library."""

from __future__ import annotations

import base64
import io
import json
import os
import re
import tempfile
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

# Names of the standard's namespaces, relations and content types.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELATION = f"{R}/{{}}"
NAMESPACES = (
    f'xmlns:w="{W}" xmlns:r="{R}" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
)
CONTENT = "application/vnd.openxmlformats-officedocument.wordprocessingml.{}+xml"
_ALIGN = {"left": "left", "right": "right", "center": "center", "justify": "both"}
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: English metric units in a point.
EMU = 12700


def _legal(text: str) -> str:
    return "".join(c for c in text if c in "\t\n\r" or 0x20 <= ord(c) < 0xD800 or 0xDFFF < ord(c) < 0xFFFE or ord(c) > 0xFFFF)


def twips(points: float | None) -> int:
    return round(20 * (points or 0))


class Parts:
    """The parts of a package under way: relations, pictures and bookmarks that its body refers to."""

    def __init__(self) -> None:
        self.relations: list[tuple[str, str, str, bool]] = []
        self.files: dict[str, bytes] = {}
        self.overrides: dict[str, str] = {}
        self.bookmarks: dict[str, int] = {}
        self.pictures = 0

    def relate(self, kind: str, target: str, outside: bool = False) -> str:
        for name, k, t, _ in self.relations:
            if (k, t) == (kind, target):
                return name
        self.relations.append((f"rId{len(self.relations) + 1}", kind, target, outside))
        return self.relations[-1][0]


def _field(code: str, props: str) -> str:
    mark = lambda kind: f'<w:r>{props}<w:fldChar w:fldCharType="{kind}"/></w:r>'
    return f'{mark("begin")}<w:r>{props}<w:instrText xml:space="preserve"> {code} </w:instrText></w:r>{mark("separate")}<w:r>{props}<w:t>1</w:t></w:r>{mark("end")}'


def _run(run: dict, parts: Parts | None = None) -> str:
    font = quoteattr(run.get("font") or "Arial")
    props = f"<w:rFonts w:ascii={font} w:hAnsi={font} w:cs={font}/>" + "<w:b/>" * bool(run.get("bold")) + "<w:i/>" * bool(run.get("italic"))
    if run.get("color"):
        props += f'<w:color w:val="{run["color"]}"/>'
    props += f'<w:sz w:val="{round(2 * (run.get("size") or 10))}"/>' + '<w:u w:val="single"/>' * bool(run.get("underline")) + '<w:vertAlign w:val="superscript"/>' * bool(run.get("sup"))
    props = f"<w:rPr>{props}</w:rPr>"
    out = ""
    for piece in re.split(r"(\{PAGE\}|\{NUMPAGES\})", _legal(run.get("text") or "")):
        if piece in ("{PAGE}", "{NUMPAGES}"):
            out += _field(piece[1:-1], props)
        elif piece:
            lines = ["<w:tab/>".join(f'<w:t xml:space="preserve">{escape(t)}</w:t>' if t else "" for t in line.split("\t")) for line in piece.split("\n")]
            out += f"<w:r>{props}{'<w:br/>'.join(lines)}</w:r>"
    if run.get("link") and parts is not None:
        return f'<w:hyperlink r:id="{parts.relate("hyperlink", run["link"], True)}">{out}</w:hyperlink>'
    return f'<w:hyperlink w:anchor={quoteattr(run["dest"])}>{out}</w:hyperlink>' if run.get("dest") else out


def _grouped(runs: list[dict]) -> list[dict]:
    """Neighbouring runs that differ in text alone as one."""
    out: list[dict] = []
    for r in runs:
        if out and {k: v for k, v in out[-1].items() if k != "text"} == {k: v for k, v in r.items() if k != "text"}:
            out[-1] = {**r, "text": (out[-1].get("text") or "") + (r.get("text") or "")}
        else:
            out.append(r)
    return out


def paragraph(para: dict, parts: Parts | None = None) -> str:
    props = "<w:keepNext/>" * bool(para.get("heading"))
    if para.get("border"):
        side = para.get("border")
        props += f'<w:pBdr><w:{side} w:val="single" w:sz="6" w:space="1" w:color="{para.get("color") or "auto"}"/></w:pBdr>'
    if para.get("fill"):
        props += f'<w:shd w:val="clear" w:color="auto" w:fill="{para["fill"]}"/>'
    if para.get("tab"):
        props += f'<w:tabs><w:tab w:val="left" w:pos="{twips(para["tab"])}"/></w:tabs>'
    props += f'<w:spacing w:before="{twips(para.get("space_before"))}" w:after="0"' + (f' w:line="{twips(para["leading"])}" w:lineRule="exact"' if para.get("leading") else "") + "/>"
    first = para.get("first_indent") or 0
    props += f'<w:ind w:left="{twips(para.get("indent"))}"' + (f' w:firstLine="{twips(first)}"' if first > 0 else f' w:hanging="{twips(-first)}"' if first < 0 else "") + f'/><w:jc w:val="{_ALIGN.get(para.get("align"), "left")}"/>'
    if para.get("heading"):
        props += f'<w:outlineLvl w:val="{min(9, para["heading"]) - 1}"/>'
    body = "".join(_run(r, parts) for r in _grouped(para["runs"]))
    if para.get("bookmark") and parts is not None:
        number = parts.bookmarks.setdefault(para["bookmark"], len(parts.bookmarks))
        body = f'<w:bookmarkStart w:id="{number}" w:name={quoteattr(para["bookmark"])}/>{body}<w:bookmarkEnd w:id="{number}"/>'
    return f"<w:p><w:pPr>{props}</w:pPr>{body}</w:p>"


def table(rows: list[list[dict]], width: float, heights: list[float] | None = None, repeat: int = 0, border: bool = True) -> str:
    """A table of fixed layout; a row has a height only where it has no text; repeat first rows are headers."""
    n = max(map(len, rows), default=0)
    if not n:
        return ""
    each = twips(width / n)
    edges = "".join(f'<w:{s} w:val="single" w:sz="4" w:color="808080"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV")) if border else ""
    out = f'<w:tbl><w:tblPr><w:tblW w:w="{each * n}" w:type="dxa"/><w:tblBorders>{edges}</w:tblBorders><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>{f"""<w:gridCol w:w="{each}"/>""" * n}</w:tblGrid>'
    for i, row in enumerate(rows):
        blank = not any(c.get("text") for c in row)
        props = (f'<w:trHeight w:val="{twips(heights[i] if heights else 12)}" w:hRule="atLeast"/>' if blank else "") + "<w:tblHeader/>" * (i < repeat)
        cells = ""
        for j in range(n):
            c = row[j] if j < len(row) else {"text": ""}
            shade = f'<w:shd w:val="clear" w:color="auto" w:fill="{c["fill"]}"/>' if c.get("fill") else ""
            cells += f'<w:tc><w:tcPr><w:tcW w:w="{each}" w:type="dxa"/>{shade}</w:tcPr>{paragraph({"runs": [{"text": c.get("text") or "", "size": c.get("size"), "bold": i < repeat}]})}</w:tc>'
        out += f"<w:tr><w:trPr>{props}</w:trPr>{cells}</w:tr>" if props else f"<w:tr>{cells}</w:tr>"
    return f"{out}</w:tbl>"


def picture(data: bytes | None, width: float, height: float, parts: Parts, label: str = "") -> str:
    """A picture in line; what has no bytes is a frame with its label."""
    if not data:
        return table([[{"text": label}]], width, [height])
    kind = "png" if data[:4] == b"\x89PNG" else "jpeg" if data[:2] == b"\xff\xd8" else None
    if kind is None:
        return table([[{"text": label}]], width, [height])
    parts.pictures += 1
    name = f"media/image{parts.pictures}.{kind}"
    parts.files[f"word/{name}"] = data
    at, cx, cy = parts.relate("image", name), round(width * EMU), round(height * EMU)
    blip = f'<pic:blipFill><a:blip r:embed="{at}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr>'
    inner = f'<pic:pic><pic:nvPicPr><pic:cNvPr id="{parts.pictures}" name="{kind}"/><pic:cNvPicPr/></pic:nvPicPr>{blip}</pic:pic>'
    return (
        f'<w:p><w:r><w:drawing><wp:inline><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{parts.pictures}" name="Picture {parts.pictures}" descr={quoteattr(_legal(label))}/>'
        f'<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture">{inner}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'
    )


def element(e: dict, parts: Parts, left: float = 72.0) -> str:
    """The body's XML for an element of a layout: kind, box, text, style and a detail of JSON or a dictionary."""
    d = e.get("detail") or {}
    d = json.loads(d) if isinstance(d, str) else d
    width, kind = (e.get("x1") or 540.0) - (e.get("x0") or left), e["kind"]
    run = {"text": e.get("text") or "", "size": e.get("size"), "bold": e.get("bold"), "link": d.get("link"), "dest": d.get("dest")}
    if kind == "table":
        return table(d.get("rows") or [], width, repeat=1 if (d.get("pages") or 1) > 1 else 0) + paragraph({"runs": [], "leading": 2})
    if kind == "image" or kind == "figure":
        return picture(base64.b64decode(d["data"]) if d.get("data") else None, width, (e.get("y1") or 0) - (e.get("y0") or 0), parts, e.get("text") or "") + ("" if d.get("data") else paragraph({"runs": [], "leading": 2}))
    if kind == "rule":
        return paragraph({"runs": [], "border": "bottom", "color": d.get("fill"), "space_before": d.get("space_before")})
    if kind == "box":
        style = e.get("style")
        lines = (e.get("text") or "").split("\n")
        return "".join(paragraph({"runs": [run | {"text": t, "font": "Courier New" if style == "code" else None, "italic": style == "quote"}], "fill": d.get("fill"), "border": "left" if style == "quote" else None, "indent": 12}, parts) for t in lines)
    level = int(e["style"].split()[-1]) if kind == "heading" and (e.get("style") or "").startswith("level") else None
    return paragraph({"runs": e.get("runs") or [run], "heading": level, "bookmark": d.get("bookmark")} | {k: d.get(k) for k in ("align", "indent", "first_indent", "leading", "space_before")}, parts)


def planned_bookmarks(elements: list[dict]) -> list[dict]:
    """Elements with a bookmark where a link of the document leads (dest: a page and a height): the first element at or below it, else the last above it."""
    wanted = sorted({tuple(e["detail"]["dest_at"]) for e in elements if isinstance(e.get("detail"), dict) and e["detail"].get("dest_at")})
    names = {}
    for page, y in wanted:
        below = [e for e in elements if (e["page"], e["y1"]) >= (page, y)] or elements[-1:]
        target = min(below, key=lambda e: (e["page"], e["y0"])) if below else None
        if target is not None:
            names[page, y] = target.setdefault("detail", {}).setdefault("bookmark", f"dest_{page}_{round(y)}")
    for e in elements:
        at = isinstance(e.get("detail"), dict) and e["detail"].get("dest_at")
        if at:
            e["detail"]["dest"] = names[tuple(at)]
    return elements


def package(paragraphs: list[dict], width: float = 612.0, height: float = 792.0, headers: list[str] = (), footers: list[str] = (), columns: int = 1, margin: float = 72.0) -> bytes:
    """A document of elements (those with a kind) and paragraphs (runs, align, leading, space_before, indent, heading), with the lines of a header and a footer."""
    parts = Parts()
    body = "".join(element(p, parts, margin) if p.get("kind") else paragraph(p, parts) for p in paragraphs)
    section = ""
    for kind, lines in (("header", headers), ("footer", footers)):
        if lines:
            tag, inner = {"header": "hdr", "footer": "ftr"}[kind], "".join(paragraph({"runs": [{"text": t}]}) for t in lines)
            parts.files[f"word/{kind}1.xml"] = f"{_HEAD}<w:{tag} {NAMESPACES}>{inner}</w:{tag}>".encode()
            parts.overrides[f"/word/{kind}1.xml"] = CONTENT.format(kind)
            section += f'<w:{kind}Reference w:type="default" r:id="{parts.relate(kind, f"{kind}1.xml")}"/>'
    m = twips(margin)
    section += f'<w:pgSz w:w="{twips(width)}" w:h="{twips(height)}"/><w:pgMar w:top="{m}" w:right="{m}" w:bottom="{m}" w:left="{m}" w:header="{m // 2}" w:footer="{m // 2}" w:gutter="0"/><w:cols w:num="{columns}" w:space="360"/>'
    parts.files["word/document.xml"] = f"{_HEAD}<w:document {NAMESPACES}><w:body>{body}<w:sectPr>{section}</w:sectPr></w:body></w:document>".encode()
    parts.overrides["/word/document.xml"] = CONTENT.format("document.main")
    relation = lambda name, kind, target, outside: f'<Relationship Id="{name}" Type="{RELATION.format(kind)}" Target={quoteattr(target)}{" TargetMode=" + quoteattr("External") if outside else ""}/>'
    relations = lambda rows: f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(relation(*r) for r in rows)}</Relationships>'.encode()
    types = "".join(f'<Default Extension="{e}" ContentType="{c}"/>' for e, c in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("png", "image/png"), ("jpeg", "image/jpeg")))
    types += "".join(f'<Override PartName="{name}" ContentType="{c}"/>' for name, c in sorted(parts.overrides.items()))
    files = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{types}</Types>'.encode(),
        "_rels/.rels": relations([("rId1", "officeDocument", "word/document.xml", False)]), "word/_rels/document.xml.rels": relations(parts.relations), **parts.files,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _clean(rows: list[dict]) -> list[dict]:
    for r in rows:
        r |= {k: None for k, v in r.items() if isinstance(v, float) and v != v or v is pd.NA}
    return rows


def packages(paras: DataFrame) -> DataFrame:
    """(doc_id, content): a package per document of paras (doc_id, seq, runs, align, leading, space_before, indent, heading)."""

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        rows = _clean(frame.sort_values("seq").to_dict("records"))
        for r in rows:
            r["runs"] = [x.asDict() if hasattr(x, "asDict") else dict(x) for x in r["runs"]]
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "content": [package(rows)]})

    return paras.groupBy("doc_id").applyInPandas(made, "doc_id bigint, content binary")


def layout_packages(elements: DataFrame) -> DataFrame:
    """(doc_id, content): a package per document of elements as layout.infer gives them; the first page's heads and feet are the document's."""

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        rows = _clean(frame.astype(object).where(frame.notna(), None).sort_values(["page", "seq"]).to_dict("records"))
        for r in rows:
            r["detail"] = json.loads(r["detail"]) if r["detail"] else {}
        ends = {k: [r["text"] for r in rows if r["kind"] == k and r["page"] == min((x["page"] for x in rows if x["kind"] == k), default=0)] for k in ("header", "footer")}
        body = planned_bookmarks([r for r in rows if r["kind"] not in ends])
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "content": [package(body, headers=ends["header"], footers=ends["footer"])]})

    return elements.groupBy("doc_id").applyInPandas(made, "doc_id bigint, content binary")


def validate(content: bytes) -> None:
    """Raises where a package is not whole."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if z.testzip() or "word/document.xml" not in z.namelist():
            raise ValueError("not a whole package")


def publish(content: bytes, path: str) -> None:
    """Writes one package on the driver's disk atomically: a checked temporary file beside the destination takes its place, or nothing changes."""
    validate(content)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def publish_all(spark, rows: DataFrame, folder: str) -> int:
    """Writes packages (doc_id, content) to a folder of any file system that Spark writes, one file each, a temporary name first; how many there were. Rows come one at a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    n = 0
    for r in rows.select("doc_id", "content").toLocalIterator():
        validate(bytes(r.content))
        part, final = path(f"{folder}/.{r.doc_id}.part"), path(f"{folder}/{r.doc_id}.docx")
        out = fs.create(part, True)
        out.write(bytearray(r.content))
        out.close()
        fs.delete(final, False)
        if not fs.rename(part, final):
            raise OSError(f"cannot publish {final}")
        n += 1
    return n
