"""Charts of the reports: one static page of SVG, without scripts.

All take the few rows that a report shows (authors, periods, links), never lines.
"""

from __future__ import annotations

import math
from html import escape

WIDTH, HEIGHT, EDGE = 760, 360, 40


def colour(i: int) -> str:
    """Hues a golden angle apart, so neighbours differ however many there are."""
    return f"hsl({i * 137.508 % 360:.0f} 55% 50%)"


def _svg(body: str, height: int = HEIGHT) -> str:
    return f'<svg viewBox="0 0 {WIDTH} {height}" width="{WIDTH}" height="{height}" xmlns="http://www.w3.org/2000/svg">{body}</svg>'


def _label(x: float, y: float, text: object, anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" font-size="11">{escape(str(text))}</text>'


def _legend(names: list[str], top: int) -> str:
    return "".join(f'<rect x="{EDGE}" y="{top + 18 * i}" width="10" height="10" fill="{colour(i)}"/>' + _label(EDGE + 16, top + 18 * i + 9, n) for i, n in enumerate(names))


def pie(shares: list[tuple[str, float]]) -> str:
    """A slice for each name; nothing for values of zero."""
    shares = [x for x in shares if x[1] > 0]
    total = sum(v for _, v in shares)
    cx, cy, r = WIDTH * 0.7, HEIGHT / 2, HEIGHT / 2 - EDGE
    out, at = "", 0.0
    for i, (name, value) in enumerate(shares):
        to = at + value / total
        (x0, y0), (x1, y1) = ((cx + r * math.sin(2 * math.pi * t), cy - r * math.cos(2 * math.pi * t)) for t in (at, to))
        # an arc can't be a whole circle
        shape = f'<circle cx="{cx}" cy="{cy}" r="{r}"' if len(shares) == 1 else f'<path d="M{cx} {cy}L{x0:.2f} {y0:.2f}A{r} {r} 0 {int(to - at > 0.5)} 1 {x1:.2f} {y1:.2f}Z"'
        out += f'{shape} fill="{colour(i)}"><title>{escape(name)}: {value:g}</title></{"circle" if len(shares) == 1 else "path"}>'
        at = to
    return _svg(out + _legend([f"{n}: {v:g} ({100 * v / total:.1f}%)" for n, v in shares], EDGE), max(HEIGHT, 2 * EDGE + 18 * len(shares)))


def dense(rows: list[dict], key: str, date: str, measure: str) -> tuple[list[str], dict[str, list[float]]]:
    """Dates, in the rows' order, and for each key a value at each of them, zero where it has no row."""
    dates = list(dict.fromkeys(r[date] for r in rows))
    at = {d: i for i, d in enumerate(dates)}
    series: dict[str, list[float]] = {}
    for r in rows:
        series.setdefault(r[key], [0] * len(dates))[at[r[date]]] += r[measure]
    return dates, dict(sorted(series.items()))


def _across(dates: list[str]) -> list[float]:
    return [EDGE + (WIDTH - 2 * EDGE) * (i / max(1, len(dates) - 1)) for i in range(len(dates))]


def _axis(dates: list[str], top: float) -> str:
    step = max(1, math.ceil(len(dates) / 6))
    return "".join(_label(x, HEIGHT - EDGE / 2, d, "middle") for x, d in list(zip(_across(dates), dates, strict=True))[::step]) + _label(2, EDGE - 6, f"{top:g}")


def lines(dates: list[str], series: dict[str, list[float]]) -> str:
    """A line for each series."""
    top = max((v for s in series.values() for v in s), default=0) or 1
    out = _axis(dates, top)
    for i, (name, values) in enumerate(series.items()):
        points = " ".join(f"{x:.1f},{HEIGHT - EDGE - (HEIGHT - 2 * EDGE) * v / top:.1f}" for x, v in zip(_across(dates), values, strict=True))
        out += f'<polyline points="{points}" fill="none" stroke="{colour(i)}" stroke-width="2"><title>{escape(name)}</title></polyline>'
    return _svg(out + _legend(list(series), HEIGHT), HEIGHT + EDGE + 18 * len(series))


def river(dates: list[str], series: dict[str, list[float]]) -> str:
    """Bands as thick as the values, stacked around the middle."""
    sums = [sum(s[i] for s in series.values()) for i in range(len(dates))]
    top = max(sums, default=0) or 1
    scale = (HEIGHT - 2 * EDGE) / top
    low, out = [HEIGHT / 2 - s * scale / 2 for s in sums], _axis(dates, top)
    for i, (name, values) in enumerate(series.items()):
        high = [y + v * scale for y, v in zip(low, values, strict=True)]
        edge = list(zip(_across(dates), low, strict=True)) + list(zip(_across(dates), high, strict=True))[::-1]
        out += f'<polygon points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in edge)}" fill="{colour(i)}"><title>{escape(name)}</title></polygon>'
        low = high
    return _svg(out + _legend(list(series), HEIGHT), HEIGHT + EDGE + 18 * len(series))


def sankey(links: list[tuple[str, str, float]]) -> str:
    """Flows (source, target, value) from left to right; a node lies one column right of its source."""
    column: dict[str, int] = {}
    for _ in links:
        for source, target, _value in links:
            column[target] = max(column.get(target, 1), column.setdefault(source, 0) + 1)
    size = {n: max(sum(v for s, _, v in links if s == n), sum(v for _, t, v in links if t == n)) for n in column}
    deepest = max(column.values(), default=0) or 1
    total = max((sum(size[n] for n in column if column[n] == c) for c in range(deepest + 1)), default=0) or 1
    scale, gap = (HEIGHT - 2 * EDGE - 60) / total, 18
    place, filled = {}, [EDGE] * (deepest + 1)
    for n, c in column.items():
        place[n] = EDGE + (WIDTH - 2 * EDGE - 90) * c / deepest, filled[c]
        filled[c] += size[n] * scale + gap
    out, leaves, enters = "", {n: y for n, (_, y) in place.items()}, {n: y for n, (_, y) in place.items()}
    for i, (source, target, value) in enumerate(links):
        h = value * scale
        (x0, y0), (x1, y1) = (place[source][0] + 10, leaves[source]), (place[target][0], enters[target])
        mid = (x0 + x1) / 2
        out += f'<path d="M{x0:.1f} {y0:.1f}C{mid:.1f} {y0:.1f} {mid:.1f} {y1:.1f} {x1:.1f} {y1:.1f}V{y1 + h:.1f}C{mid:.1f} {y1 + h:.1f} {mid:.1f} {y0 + h:.1f} {x0:.1f} {y0 + h:.1f}Z" fill="{colour(i)}" opacity="0.6"><title>{escape(source)} to {escape(target)}: {value:g}</title></path>'
        leaves[source], enters[target] = y0 + h, y1 + h
    for n, (x, y) in place.items():
        out += f'<rect x="{x:.1f}" y="{y:.1f}" width="10" height="{max(1, size[n] * scale):.1f}"/>' + _label(x, y - 4, f"{n}: {size[n]:g}")
    return _svg(out)


def page(title: str, charts: list[tuple[str, str]], report: str) -> str:
    """A page of headed charts and the report's text."""
    body = "".join(f"<h2>{escape(name)}</h2>{svg}" for name, svg in charts)
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body style="font-family:sans-serif"><h1>{escape(title)}</h1>{body}<pre>{escape(report)}</pre></body></html>\n'
