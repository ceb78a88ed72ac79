"""Charts of report items as SVG, drawn here, so that a page needs nothing from elsewhere.

Each chart is an element of its own; ``log_toggle`` items carry a second drawing with a logarithmic
axis and a button that changes between the two.
"""

from __future__ import annotations

import html
import math
from collections.abc import Callable

WIDTH, HEIGHT = 760, 380
LEFT, RIGHT, TOP, BOTTOM = 76, 16, 14, 64
COLORS = ("#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#ff8ab7", "#a463f2", "#97bbf5")
#: Labels that fit under an axis.
MOST_LABELS = 24


def humanize(value: float, precision: int = 0) -> str:
    """A number in thousands, millions and so on."""
    order = min(int(math.log10(abs(value))) // 3, 4) if abs(value) >= 1 else 0
    return f"{value / 10 ** (3 * order):,.{precision}f}{('', 'K', 'M', 'B', 'D')[order]}"


def short(value: float) -> str:
    return humanize(value, 0 if abs(value) < 1000 else 1) if abs(value) >= 1 and float(value).is_integer() or abs(value) >= 1000 else f"{value:g}"


def ticks(low: float, high: float, log: bool) -> list[float]:
    if log:
        return [10.0**k for k in range(math.floor(math.log10(low)), math.ceil(math.log10(high)) + 1)]
    step = 10 ** math.floor(math.log10(max(high - low, 1e-12)))
    step *= next((m for m in (0.2, 0.5, 1, 2) if (high - low) / (step * m) <= 8), 2)
    return [k * step for k in range(math.floor(low / step), math.ceil(high / step) + 1)]


class Axis:
    """Values to places; ``size`` may be negative for an axis that grows upwards."""

    def __init__(self, low: float, high: float, start: float, size: float, log: bool = False):
        self.log, self.start, self.size = log, start, size
        self.ticks = ticks(low, high if high > low else low + 1, log)
        self.low, self.high = self.ticks[0], self.ticks[-1]

    def __call__(self, v: float) -> float:
        a, b, x = (math.log10(z) for z in (self.low, self.high, v)) if self.log else (self.low, self.high, v)
        return self.start + self.size * (x - a) / ((b - a) or 1)


def text(x: float, y: float, words: str, anchor: str = "middle", turn: int = 0) -> str:
    spin = f' transform="rotate({turn} {x:.1f} {y:.1f})"' if turn else ""
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}"{spin}>{html.escape(words)}</text>'


def rect(x: float, y: float, w: float, h: float, color: str, title: str) -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(w, 0.5):.1f}" height="{max(h, 0):.1f}" fill="{color}"><title>{html.escape(title)}</title></rect>'


def frame(axis: Axis) -> str:
    """Grid lines and labels of the upright axis."""
    out = []
    for t in axis.ticks:
        y = axis(t)
        out.append(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{y:.1f}" y2="{y:.1f}" class="grid"/>' + text(LEFT - 6, y + 4, short(t), "end"))
    return "".join(out)


def svg(body: str, id_: str, hidden: bool = False) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" width="{WIDTH}" height="{HEIGHT}" id="{html.escape(id_)}"{" hidden" if hidden else ""}><style>text{{font:11px sans-serif;fill:#333}}.grid{{stroke:#ddd}}</style>{body}</svg>'


def bars(labels: list, series: list[tuple[str, list[float]]], log: bool) -> str:
    """Bars beside each other for each label. On a logarithmic axis bars of zero are left out."""
    shown = [v for _, ys in series for v in ys if not math.isnan(v) and (v > 0 or not log)]
    low, high = (min(shown, default=1), max(shown, default=1)) if log else (min([0, *shown]), max([1e-9, *shown]))
    axis = Axis(low, high, HEIGHT - BOTTOM, -(HEIGHT - TOP - BOTTOM), log)
    slot = (WIDTH - LEFT - RIGHT) / max(1, len(labels))
    width, base = 0.84 * slot / max(1, len(series)), axis(axis.low if log else 0)
    out = [frame(axis)]
    for k, (name, ys) in enumerate(series):
        for i, v in enumerate(ys):
            if not math.isnan(v) and (v > 0 or not log):
                y = axis(v)
                out.append(rect(LEFT + i * slot + 0.08 * slot + k * width, min(y, base), width, abs(base - y), COLORS[k % len(COLORS)], f"{name} {labels[i]}: {v:,.10g}".strip()))
    every = -(-len(labels) // MOST_LABELS)
    out += [text(LEFT + (i + 0.5) * slot, HEIGHT - BOTTOM + 14, str(x)[:24], "end", -40) for i, x in enumerate(labels) if i % every == 0]
    if len(series) > 1:
        out += [rect(LEFT + 8, TOP + 16 * k, 10, 10, COLORS[k % len(COLORS)], name) + text(LEFT + 22, TOP + 9 + 16 * k, name, "start") for k, (name, _) in enumerate(series)]
    return "".join(out)


def line(item: dict) -> str:
    """Points that the axes can show: a logarithmic axis takes no zeros."""
    points = [(x, y) for x, y in zip(item["x"], item["y"], strict=True) if (x > 0 or not item["log_x"]) and (y > 0 or not item["log_y"])] or [(1, 1)]
    xs, ys = zip(*points, strict=True)
    ax = Axis(min(xs), max(xs), LEFT, WIDTH - LEFT - RIGHT, item["log_x"])
    ay = Axis(min(ys), max(ys), HEIGHT - BOTTOM, -(HEIGHT - TOP - BOTTOM), item["log_y"])
    path = " ".join(f"{ax(x):.1f},{ay(y):.1f}" for x, y in points)
    dots = "".join(f'<circle cx="{ax(x):.1f}" cy="{ay(y):.1f}" r="2.5" fill="{COLORS[0]}"><title>{x:g}: {y:g}</title></circle>' for x, y in points)
    return frame(ay) + "".join(text(ax(t), HEIGHT - BOTTOM + 16, short(t)) for t in ax.ticks) + f'<polyline points="{path}" fill="none" stroke="{COLORS[0]}"/>' + dots


def shade(share: float) -> str:
    """From white to a dark blue."""
    share = min(1.0, max(0.0, share))
    return "#" + "".join(f"{round(255 + (c - 255) * share):02x}" for c in (22, 56, 120))


def heatmap(item: dict) -> str:
    nx, ny = max(1, len(item["x"])), max(1, len(item["y"]))
    w, h = (WIDTH - LEFT - RIGHT) / nx, (HEIGHT - TOP - BOTTOM) / ny
    out = [rect(LEFT + i * w, TOP + j * h, w, h, shade(v), f"{item['y'][j]}, {item['x'][i]}: {v:.6g}") for j, row in enumerate(item["values"]) for i, v in enumerate(row)]
    out += [text(LEFT + (i + 0.5) * w, HEIGHT - BOTTOM + 14, str(x)[:16], "end", -40) for i, x in enumerate(item["x"]) if i % -(-nx // MOST_LABELS) == 0]
    out += [text(LEFT - 6, TOP + (j + 0.5) * h + 4, str(y)[:12], "end") for j, y in enumerate(item["y"]) if j % -(-ny // MOST_LABELS) == 0]
    return "".join(out)


def hexbin(item: dict) -> str:
    """Bins as hexagons, darker with the logarithm of their size."""
    bins = item["bins"] or [[0, 0, 1]]
    ax = Axis(min(b[0] for b in bins), max(b[0] for b in bins), LEFT + 14, WIDTH - LEFT - RIGHT - 28)
    ay = Axis(min(b[1] for b in bins), max(b[1] for b in bins), HEIGHT - BOTTOM - 14, -(HEIGHT - TOP - BOTTOM - 28))
    top = math.log10(max(b[2] for b in bins)) or 1
    out = [frame(ay), "".join(text(ax(t), HEIGHT - BOTTOM + 16, short(t)) for t in ax.ticks)]
    for x, y, n, *_ in bins:
        corners = " ".join(f"{ax(x) + 12 * math.sin(k * math.pi / 3):.1f},{ay(y) + 12 * math.cos(k * math.pi / 3):.1f}" for k in range(6))
        out.append(f'<polygon points="{corners}" fill="{shade(0.15 + 0.85 * math.log10(n) / top)}"><title>{x:g}, {y:g}: {n}</title></polygon>')
    return "".join(out)


DRAWN: dict[str, Callable[[dict], str]] = {"line": line, "heatmap": heatmap, "hexbin": hexbin}


def chart(item: dict) -> str:
    kind, id_ = item["kind"], str(item.get("id", "chart"))
    if kind in DRAWN:
        return svg(DRAWN[kind](item), id_)
    if kind not in ("bar", "multibar"):
        raise ValueError(f"no chart for {kind}")
    series = [("", item["values"])] if kind == "bar" else list(zip(item["names"], item["values"], strict=True))
    out = svg(bars(item["labels"], series, False), id_)
    if item.get("log_toggle"):
        out += svg(bars(item["labels"], series, True), id_ + "-log", hidden=True) + f'<button type="button" onclick="swap(\'{html.escape(id_)}\')">logarithmic</button>'
    return out


#: What a page's buttons call: change the axis, save a drawing, save a text.
SCRIPT = """
function swap(id){for(const x of [id,id+'-log']){const e=document.getElementById(x);e.toggleAttribute('hidden')}}
function save(name,kind,text){const a=document.createElement('a');a.href=URL.createObjectURL(new Blob([text],{type:kind}));a.download=name;a.click()}
function asSvg(id){const e=document.getElementById(id);save(id+'.svg','image/svg+xml',e.outerHTML)}
function asPng(id){const e=document.getElementById(id),i=new Image(),c=document.createElement('canvas');c.width=2*e.width.baseVal.value;c.height=2*e.height.baseVal.value;
i.onload=()=>{c.getContext('2d').drawImage(i,0,0,c.width,c.height);c.toBlob(b=>{const a=document.createElement('a');a.href=URL.createObjectURL(b);a.download=id+'.png';a.click()})};
i.src='data:image/svg+xml;charset=utf-8,'+encodeURIComponent(e.outerHTML)}
"""
#: The downloads that a chart offers, by their labels.
DOWNLOADS = {"png": "Download as png", "svg": "Download as svg"}
