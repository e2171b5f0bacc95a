"""Page-local assembly: lines from characters, blocks from lines, scripts, wraps and locks.

These are folds whose steps depend on what earlier ones consumed, so a page (at most a few thousand
objects) is one call of a pandas function; documents and pages are what is dealt out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_page(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(f, schema)


def rows_of(baseline: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The row of each character: the first row whose first member's baseline is within max(1, 0.12 size)."""
    firsts: list[float] = []
    out = np.zeros(len(baseline), np.int64)
    for i, (b, s) in enumerate(zip(baseline, size, strict=True)):
        for r, f in enumerate(firsts):
            if abs(b - f) <= max(1.0, 0.12 * s):
                out[i] = r
                break
        else:
            out[i] = len(firsts)
            firsts.append(b)
    return out


def build_lines(chars: pd.DataFrame) -> pd.DataFrame:
    """Lines of a page's characters (doc_id, page, i, u, x0, y0, x1, y1, baseline, size): rows by baseline, cut at gaps over 1.10 em, with a space at gaps over 0.24 em."""
    chars = chars.sort_values("i")
    chars = chars.assign(row=rows_of(chars["baseline"].to_numpy(), chars["size"].to_numpy())).sort_values(["row", "x0", "i"], kind="stable")
    out = []
    for _, row in chars.groupby("row", sort=True):
        gap = (row["x0"] - row["x1"].shift()) / row["size"]
        for _, line in row.groupby((gap > 1.10).cumsum()):
            g = ((line["x0"] - line["x1"].shift()) / line["size"]).fillna(0)
            text = "".join((" " if x > 0.24 else "") + u for x, u in zip(g, line["u"], strict=True))
            out.append((line["doc_id"].iloc[0], line["page"].iloc[0], text, line["x0"].min(), line["y0"].min(), line["x1"].max(), line["y1"].max(), line["baseline"].iloc[0], line["size"].max()))
    made = pd.DataFrame(out, columns=["doc_id", "page", "text", "x0", "y0", "x1", "y1", "baseline", "size"])
    return made.sort_values(["baseline", "x0"], kind="stable").assign(line=range(len(made)))


LINES_SCHEMA = "doc_id bigint, page int, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double, line int"


def build_blocks(lines: pd.DataFrame) -> pd.DataFrame:
    """Lines of a page with their block: a size change over 6 % breaks; else a pitch of at most 1.15 of the low pitch with x overlap, or a place on the same row, continues."""
    lines = lines.sort_values(["baseline", "x0"], kind="stable")
    gaps = np.diff(np.unique(lines["baseline"]))
    gaps = np.sort(gaps[(gaps > 0) & (gaps < 60)])
    ref = gaps[max(0, int(0.2 * len(gaps)) - 1)] if len(gaps) >= 3 else 12.0
    block, out, last = -1, [], None
    for row in lines.itertuples():
        joined = False
        if last is not None and abs(row.size / last.size - 1) <= 0.06:
            gap = row.baseline - last.baseline
            joined = row.x0 - last.x1 <= 1.2 * row.size if abs(gap) <= 0.6 else 0 < gap <= 1.15 * ref and min(row.x1, last.x1) > max(row.x0, last.x0)
        block += not joined
        out.append(block)
        last = row
    return lines.assign(block=out)


def absorb_scripts(lines: pd.DataFrame) -> pd.DataFrame:
    """Fragments smaller than 0.92 of a neighbour, within 0.75 of its size in height and adjacent, join it; superscript where raised over 0.12. The search starts anew after each."""
    rows = [dict(r, sup="") for r in lines.sort_values(["baseline", "x0"]).to_dict("records")]
    again = True
    while again:
        again = False
        for part in sorted(rows, key=lambda r: (r["size"], r["x0"])):
            hosts = [h for h in rows if h is not part and part["size"] < 0.92 * h["size"] and abs(part["baseline"] - h["baseline"]) <= 0.75 * h["size"] and h["x0"] - 2 <= part["x0"] <= h["x1"] + 0.5 * h["size"]]
            if hosts:
                h = min(hosts, key=lambda r: (abs(part["x0"] - r["x1"]), abs(part["baseline"] - r["baseline"])))
                raised = h["baseline"] - part["baseline"] > 0.12 * h["size"]
                h["text"], h["x1"], h["sup"] = h["text"] + part["text"], max(h["x1"], part["x1"]), h["sup"] + (part["text"] if raised else "")
                rows.remove(part)
                again = True
                break
    return pd.DataFrame(rows, columns=[*lines.columns, "sup"])


def lock_lines(paras: pd.DataFrame) -> pd.DataFrame:
    """Paragraphs of a page in order (source_lines, predicted, line_height, slack, capacity) with an outcome: a lock takes room, and later ones see what is left."""
    slack, out = float(paras["slack"].iloc[0]), []
    for p in paras.sort_values("seq").itertuples():
        if p.source_lines < 2:
            out.append("short")
        elif pd.isna(p.predicted):
            out.append("unpredictable")
        elif p.predicted == p.source_lines:
            out.append("flow")
        else:
            cost = (p.source_lines - p.predicted) * p.line_height
            if cost > 0 and slack - cost < 0.25 * p.capacity:
                out.append("no_page_room")
            else:
                slack -= max(0.0, cost)
                out.append("line-locked")
    return paras.sort_values("seq").assign(outcome=out)


def refine(layout, render: Callable, measure: Callable, apply: Callable, rounds: int = 3):
    """The best of the layouts that a closed loop passes through, by (page error, spill, |offset|); it stops at (0, 0, under 1), or when nothing changes.

    render(layout) gives a rendering, measure(rendering) the three figures, apply(layout, rendering) the next layout or None.
    """
    best, score = layout, None
    for _ in range(rounds + 1):
        rendering = render(layout)
        found = tuple(measure(rendering))
        if score is None or found < score:
            best, score = layout, found
        if found[:2] == (0, 0) and found[2] < 1:
            break
        layout = apply(layout, rendering)
        if layout is None:
            break
    return best, score
