"""Reports: sections as JSON, and as one HTML page that draws its charts itself."""

from __future__ import annotations

import html
import json

from . import charts


def merge(texts: list[str]) -> list[dict]:
    """Sections of several JSON reports, in order."""
    return [s for t in texts for s in json.loads(t)]


def to_json(sections: list[dict]) -> str:
    return json.dumps(sections, indent=2)


def vega(item: dict) -> dict:
    """A Vega-Lite specification of a chart item."""
    base = {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "width": 700, "height": 350}
    kind = item["kind"]
    if kind == "bar":
        data = [{"x": str(x), "y": y} for x, y in zip(item["labels"], item["values"], strict=True)]
        return base | {"data": {"values": data}, "mark": "bar", "encoding": {"x": {"field": "x", "type": "ordinal", "sort": None}, "y": {"field": "y", "type": "quantitative"}}}
    if kind == "multibar":
        data = [{"x": str(x), "y": y, "name": n} for n, ys in zip(item["names"], item["values"], strict=True) for x, y in zip(item["labels"], ys, strict=False)]
        return base | {"data": {"values": data}, "mark": "bar", "encoding": {"x": {"field": "x", "type": "ordinal", "sort": None}, "y": {"field": "y", "type": "quantitative", "stack": None}, "color": {"field": "name", "type": "nominal"}}}
    if kind == "line":
        data = [{"x": x, "y": y} for x, y in zip(item["x"], item["y"], strict=True) if (x > 0 or not item["log_x"]) and (y > 0 or not item["log_y"])]
        scale = {k: {"type": "log" if item[f"log_{k}"] else "linear"} for k in "xy"}
        return base | {"data": {"values": data}, "mark": "line", "encoding": {k: {"field": k, "type": "quantitative", "scale": scale[k]} for k in "xy"}}
    if kind == "heatmap":
        data = [{"x": x, "y": y, "v": v} for y, row in zip(item["y"], item["values"], strict=True) for x, v in zip(item["x"], row, strict=True)]
        return base | {"data": {"values": data}, "mark": "rect", "encoding": {"x": {"field": "x", "type": "nominal", "sort": None}, "y": {"field": "y", "type": "nominal", "sort": None}, "color": {"field": "v", "type": "quantitative"}}}
    if kind == "hexbin":
        data = [{"x": x, "y": y, "size": n} for x, y, n in item["bins"]]
        return base | {"data": {"values": data}, "mark": "point", "encoding": {"x": {"field": "x", "type": "quantitative"}, "y": {"field": "y", "type": "quantitative"}, "size": {"field": "size", "type": "quantitative"}}}
    raise ValueError(f"no chart for {kind}")


def unrepeated(rows: list[list[str]]) -> list[list[str]]:
    """Rows for reading: leading cells that equal those of the row above are blank."""
    out, above = [], []
    for row in rows:
        same = 0
        while same < min(len(row), len(above)) and row[same] == above[same]:
            same += 1
        out.append([""] * same + list(row[same:]))
        above = row
    return out


def shown(item: dict) -> str:
    kind = item["kind"]
    if kind == "table":
        head = "".join(f"<th>{html.escape(str(h))}</th>" for h in item["header"])
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in unrepeated(item["values"]))
        return f"<table><tr>{head}</tr>{body}</table>"
    if kind == "svg":
        return item["file"]
    if kind == "png":
        return f'<img src="data:image/png;base64,{item["file"]}">'
    if kind == "pdf":
        return f'<embed type="application/pdf" src="data:application/pdf;base64,{item["file"]}" width="700" height="900">'
    if kind == "json":  # a specification of one's own, as text
        return f"<pre>{html.escape(json.dumps(item['file'], indent=1))}</pre>"
    id_ = html.escape(str(item.get("id", "chart")))
    links = "".join(f'<button type="button" onclick="as{k.title()}(\'{id_}\')">{html.escape(label)}</button>' for k, label in charts.DOWNLOADS.items())
    spec = json.dumps(vega(item)).replace("</", "<\\/")
    nodes = ""
    if kind == "hexbin" and item.get("nodes"):
        listed = json.dumps(item["nodes"]).replace("</", "<\\/")
        nodes = f'<script type="application/json" id="{id_}-nodes">{listed}</script><button type="button" onclick="save(\'{id_}.txt\',\'text/plain\',document.getElementById(\'{id_}-nodes\').textContent)">nodes of each bin</button>'
    return f'<figure>{charts.chart(item)}<figcaption>{links}{nodes}</figcaption><script type="application/vega-lite+json">{spec}</script></figure>'


def to_html(sections: list[dict]) -> str:
    """One page: a list of runs and analyses, a section for each, tables to copy."""
    tree, body, used = [], [], {}
    for k, s in enumerate(sections):
        tree.append(f'<li><a href="#s{k}">{html.escape(s.get("run", ""))}: {html.escape(s["title"])}</a></li>')
        items = []
        for i in s["items"]:
            if "id" in i:  # ids are unique in a page
                used[i["id"]] = used.get(i["id"], 0) + 1
                i = i | {"id": f"{i['id']}-{used[i['id']]}" if used[i["id"]] > 1 else i["id"]}
            items.append(shown(i))
        text = f"<details><summary>table</summary><pre>{html.escape(s['table'])}</pre></details>" if s.get("table") else ""
        body.append(f'<section id="s{k}"><h2>{html.escape(s["title"])}</h2>{"".join(items)}{text}</section>')
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>report</title><script>{charts.SCRIPT}</script></head><body><nav><ul>{"".join(tree)}</ul></nav>{"".join(body)}</body></html>'
