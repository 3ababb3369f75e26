"""Reports for people: HTML with charts, narrative text, a table; a choice by format's name; and the
events a worker prints. What reaches the driver is aggregates and a stated number of findings."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reports
from .findings import SEVERITIES, severity_summary

COLOURS = {"critical": "#b3261e", "high": "#d9682b", "medium": "#c9a227", "low": "#4f7cac", "info": "#8a8f98"}


def shares(findings: DataFrame, top: int = 40) -> list[tuple[str, int, int]]:
    """(folder, findings, worst severity) of the folders with most findings."""
    folder = F.coalesce(F.nullif(F.regexp_extract("file", "^(.*)/", 1), F.lit("")), F.lit("."))
    g = findings.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("worst"))
    return [(r["folder"], r["n"], r["worst"]) for r in g.orderBy(F.desc("n"), "folder").limit(top).collect()]


def treemap(parts: list[tuple[str, int, int]], width: float = 720, height: float = 320) -> str:
    """Rectangles whose areas follow the counts, cut from the longer side in turn."""
    out, x, y, w, h = [], 0.0, 0.0, float(width), float(height)
    left = sum(n for _, n, _ in parts)
    for name, n, worst in parts:
        share = n / left if left else 0
        cw, ch = (w * share, h) if w >= h else (w, h * share)
        out.append(f'<g><title>{html.escape(name)}: {n}</title><rect x="{x:.1f}" y="{y:.1f}" width="{cw:.1f}" height="{ch:.1f}" fill="{COLOURS[SEVERITIES[worst]]}" stroke="#fff"/>' + (f'<text x="{x + 4:.1f}" y="{y + 14:.1f}" font-size="11" fill="#fff">{html.escape(name[: max(1, int(cw / 7))])}</text>' if cw > 40 and ch > 18 else "") + "</g>")
        x, y, w, h = (x + cw, y, w - cw, h) if w >= h else (x, y + ch, w, h - ch)
        left -= n
    return f'<svg viewBox="0 0 {width} {height}" role="img">{"".join(out)}</svg>'


def bars(counts: list[tuple[str, int]], width: float = 720) -> str:
    most = max((n for _, n in counts), default=0)
    rows = []
    for i, (name, n) in enumerate(counts):
        length = (width - 260) * n / most if most else 0
        rows.append(f'<text x="0" y="{20 * i + 14}" font-size="12">{html.escape(name)}</text><rect x="200" y="{20 * i + 3}" width="{length:.1f}" height="14" fill="#4f7cac"/><text x="{205 + length:.1f}" y="{20 * i + 14}" font-size="12">{n}</text>')
    return f'<svg viewBox="0 0 {width} {20 * len(counts) + 4}" role="img">{"".join(rows)}</svg>'


def architecture_map(edges: list[tuple[str, str, int]], size: float = 480) -> str:
    """Modules on a circle with a line for each pair that has edges."""
    import math

    names = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {m: (size / 2 + size * 0.4 * math.cos(2 * math.pi * i / max(1, len(names))), size / 2 + size * 0.4 * math.sin(2 * math.pi * i / max(1, len(names)))) for i, m in enumerate(names)}
    most = max((n for *_, n in edges), default=1)
    lines = [f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}" stroke="#8a8f98" stroke-width="{0.5 + 3 * n / most:.2f}"/>' for a, b, n in edges]
    dots = [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="5" fill="#4f7cac"/><text x="{x + 7:.1f}" y="{y + 4:.1f}" font-size="11">{html.escape(m)}</text>' for m, (x, y) in at.items()]
    return f'<svg viewBox="0 0 {size} {size}" role="img">{"".join(lines + dots)}</svg>'


def html_page(findings: DataFrame, score: float | None = None, grade: str | None = None, modules: DataFrame | None = None, top: int = 200) -> str:
    """One page: score, folders as a treemap, findings by detector, modules (src_module, dst_module, n)
    and the `top` worst findings."""
    by = severity_summary(findings).orderBy(F.desc("total"), "detector").limit(40).collect()
    worst = findings.orderBy(F.desc("severity"), "file", "line_start", "detector").limit(top).collect()
    out = ["<!doctype html><html><head><meta charset='utf-8'><title>Findings</title></head><body><h1>Findings</h1>"]
    if score is not None:
        out.append(f"<p>Score <b>{score:.1f}</b> ({html.escape(grade or '')})</p>")
    out += ["<h2>Folders</h2>", treemap(shares(findings)), "<h2>Detectors</h2>", bars([(r["detector"], r["total"]) for r in by])]
    if modules is not None:
        edges = [(r[0], r[1], r[2]) for r in modules.orderBy(F.desc("n"), "src_module", "dst_module").limit(200).collect()]
        out += ["<h2>Modules</h2>", architecture_map(edges)]
    out.append(f"<h2>Worst {top}</h2><table><tr><th>Severity</th><th>Place</th><th>Finding</th></tr>")
    for r in worst:
        out.append(f"<tr><td>{SEVERITIES[r['severity']]}</td><td>{html.escape(str(r['file']))}:{r['line_start'] or 1}</td><td>{html.escape(r['title'] or '')}</td></tr>")
    return "\n".join([*out, "</table></body></html>", ""])


def narrative(findings: DataFrame, score: float | None = None, grade: str | None = None) -> str:
    """A few sentences on the state of a project."""
    row = findings.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), F.sum((F.col("severity") >= 3).cast("int")).alias("bad"), F.sum((F.col("category") == "security").cast("int")).alias("security")).first()
    if not row["n"]:
        return "No findings. Nothing needs attention.\n"
    top = findings.groupBy("detector").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "detector").limit(3).collect()
    worst = findings.groupBy("file").agg(F.sum(F.col("severity") + 1).alias("w")).orderBy(F.desc("w"), "file").limit(1).first()
    out = [] if score is None else [f"The project scores {score:.1f} ({grade})."]
    out.append(f"There are {row['n']} findings in {row['files']} files, {row['bad'] or 0} of them severe and {row['security'] or 0} about security.")
    out.append("Most come from " + ", ".join(f"{r['detector']} ({r['n']})" for r in top) + ".")
    out.append(f"Start with {worst['file']}.")
    return " ".join(out) + "\n"


def table(findings: DataFrame, top: int = 50) -> str:
    rows = [(SEVERITIES[r["severity"]], f"{r['file']}:{r['line_start'] or 1}", r["detector"], r["title"] or "") for r in findings.orderBy(F.desc("severity"), "file", "line_start", "detector").limit(top).collect()]
    head = ("Severity", "Place", "Detector", "Finding")
    wide = [max(len(str(r[i])) for r in [head, *rows]) for i in range(4)]
    return "\n".join("  ".join(str(c).ljust(n) for c, n in zip(r, wide)).rstrip() for r in [head, *rows]) + "\n"


#: Formats by name; each takes findings and options.
FORMATS = {"text": reports.text, "txt": reports.text, "terminal": reports.text, "markdown": reports.markdown, "md": reports.markdown, "html": html_page, "table": table, "narrative": narrative}


def render(findings: DataFrame, form: str, path: str | None = None, **options) -> str | None:
    """A report in the named format: returned as text, or with json and sarif written to `path`."""
    form = form.lower()
    if form in ("json", "sarif"):
        if path is None:
            raise ValueError(f"{form} needs a path to write to")
        (reports.json_lines if form == "json" else reports.sarif)(findings, path)
        return None
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; there are {', '.join(sorted({*FORMATS, 'json', 'sarif'}))}")
    return FORMATS[form](findings, **options)


def event(kind: str, id: int | None = None, findings: DataFrame | None = None, fixed: DataFrame | None = None, most: int = 1000, **more) -> str:
    """A worker's event as one line of JSON: ready, progress, delta, unchanged or error."""
    def rows(df):
        return [json.loads(r) for r in df.orderBy("id").limit(most).toJSON().collect()]

    body = {"event": kind, "id": id, **more}
    if findings is not None:
        body["new_findings" if kind == "delta" else "findings"] = rows(findings)
    if fixed is not None:
        body["fixed_findings"] = rows(fixed)
    return json.dumps(body, sort_keys=True)
