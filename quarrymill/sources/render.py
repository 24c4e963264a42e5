"""Markdown to one HTML page: sections as details under a table of contents, tables, lists,
quotes, code, and images as data when asked."""

from __future__ import annotations

import base64
import html
import mimetypes
import re
from itertools import groupby
from pathlib import Path

STYLE = "body{font-family:sans-serif;margin:2em;max-width:70em}nav{position:sticky;top:0;background:#fff}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em}"


def embedded(markdown: str, folder: str) -> str:
    """Local images as data URIs; one that can't be read stays a link."""

    def one(m: re.Match) -> str:
        file = Path(folder, m[2])
        if "://" in m[2] or not file.is_file():
            return m[0]
        kind = mimetypes.guess_type(file.name)[0] or "application/octet-stream"
        return f"![{m[1]}](data:{kind};base64,{base64.b64encode(file.read_bytes()).decode()})"

    return re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", one, markdown)


def inline(text: str) -> str:
    out = html.escape(text, quote=False)
    for pattern, made in ((r"!\[([^\]]*)\]\(([^)]+)\)", r'<img alt="\1" src="\2">'), (r"\[([^\]]+)\]\(([^)]+)\)", r'<a href="\2">\1</a>'), (r"`([^`]+)`", r"<code>\1</code>"), (r"\*\*(.+?)\*\*", r"<b>\1</b>")):
        out = re.sub(pattern, made, out)
    return out


def _kind(line: str) -> str:
    s = line.strip()
    return "" if not s else "table" if s.startswith("|") else "quote" if s.startswith(">") else "list" if re.match(r"([-*]|\d+\.)\s", s) else "head" if s.startswith("#") else "text"


def _table(lines: list[str]) -> str:
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in lines]
    ruled = len(rows) > 1 and all(re.fullmatch(r":?-+:?", c) for c in rows[1])
    sides = ["right" if c.endswith(":") and not c.startswith(":") else "center" if c.endswith(":") else "left" for c in rows[1]] if ruled else []
    made = []
    for i, row in enumerate(rows):
        if not (ruled and i == 1):
            tag = "th" if ruled and i == 0 else "td"
            made.append("<tr>" + "".join(f'<{tag} style="text-align:{sides[k] if k < len(sides) else "left"}">{inline(c)}</{tag}>' for k, c in enumerate(row)) + "</tr>")
    return f"<table>{''.join(made)}</table>"


def blocks(text: str) -> str:
    out = []
    for k, part in enumerate(re.split(r"^```", text, flags=re.M)):
        if k % 2:
            name, _, code = part.partition("\n")
            out.append(f'<pre class="mermaid">{html.escape(code)}</pre>' if name.strip() == "mermaid" else f"<pre><code>{html.escape(code)}</code></pre>")
            continue
        for kind, group in groupby(part.split("\n"), _kind):
            lines = list(group)
            if kind == "table":
                out.append(_table(lines))
            elif kind == "list":
                tag = "ol" if re.match(r"\s*\d", lines[0]) else "ul"
                out.append(f"<{tag}>{''.join('<li>' + inline(re.sub(r'^\s*([-*]|\d+\.)\s+', '', x)) + '</li>' for x in lines)}</{tag}>")
            elif kind == "quote":
                out.append(f"<blockquote>{inline(' '.join(x.strip().lstrip('> ') for x in lines))}</blockquote>")
            elif kind == "head":
                out += [f"<h{min(6, len(x) - len(x.lstrip('#')))}>{inline(x.lstrip('# '))}</h{min(6, len(x) - len(x.lstrip('#')))}>" for x in (y.strip() for y in lines)]
            elif kind == "text":
                out.append(f"<p>{inline(' '.join(x.strip() for x in lines))}</p>")
    return "\n".join(out)


def page(markdown: str, folder: str | None = None) -> str:
    """The whole page; a Mermaid script only if a diagram is there."""
    if folder:
        markdown = embedded(markdown, folder)
    before, *sections = re.split(r"^## ", markdown, flags=re.M)
    title = next((x[2:].strip() for x in before.split("\n") if x.startswith("# ")), "Report")
    heads = [s.partition("\n")[0].strip() for s in sections]
    contents = "".join(f'<a href="#s{i}">{inline(h)}</a> ' for i, h in enumerate(heads))
    body = "".join(f'<details open id="s{i}"><summary>{inline(h)}</summary>{blocks(s.partition("\n")[2])}</details>' for i, (h, s) in enumerate(zip(heads, sections, strict=True)))
    script = '<script type="module">import m from "https://cdn.jsdelivr.net/npm/mermaid/+esm";m.initialize({startOnLoad:true})</script>' if "```mermaid" in markdown else ""
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body>{blocks(before)}<nav>{contents}</nav>{body}{script}</body></html>'
