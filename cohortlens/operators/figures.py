"""Charts of bounded frames as SVG text: no drawing library is needed.

Every chart is a file of its own next to the report, and stands in it as well.
"""

from __future__ import annotations

import html
from pathlib import Path

import numpy as np
import pandas as pd

#: Nodes that are drawn at most, by degree; labels are left out of larger networks.
DRAWN, LABELLED = 300, 60
#: Colours by role, and of bars; readable in grey too.
COLOURS = {"phenotype": "#b5502c", "class": "#b5502c", "gene": "#2c6eb5"}
BAR, LINE = "#2c6eb5", "#999999"


def spring_layout(pairs: list[tuple[str, str]], k: float = 0.5, iterations: int = 50, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Places of nodes in [-1, 1]²: edges pull, all nodes push, and steps shrink to nothing."""
    ids = sorted({x for p in pairs for x in p})
    if not ids:
        return {}
    at = {x: i for i, x in enumerate(ids)}
    linked = np.zeros((len(ids), len(ids)))
    for a, b in pairs:
        linked[at[a], at[b]] = linked[at[b], at[a]] = a != b
    place = np.random.default_rng(seed).random((len(ids), 2))
    heat = 0.1 * float(np.ptp(place, axis=0).max() or 1.0)
    for step in range(iterations):
        apart = place[:, None] - place[None]
        far = np.maximum(np.linalg.norm(apart, axis=2), 0.01)
        force = (apart * (k * k / far**2 - linked * far / k)[:, :, None]).sum(1)
        length = np.maximum(np.linalg.norm(force, axis=1), 0.01)
        place = place + force / length[:, None] * heat * (1 - step / iterations)
    place = place - place.mean(0)
    place = place / max(float(np.abs(place).max()), 1e-9)
    return {x: (float(place[i, 0]), float(place[i, 1])) for x, i in at.items()}


def _svg(width: int, height: int, body: list[str], title: str) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img" font-family="sans-serif" font-size="11"><title>{html.escape(title)}</title>'
    return head + f'<text x="{width / 2:.0f}" y="18" text-anchor="middle" font-size="14">{html.escape(title)}</text>' + "".join(body) + "</svg>"


def network_svg(edges: pd.DataFrame, roles: dict[str, str], title: str) -> str:
    """Edges (src, dst, phi) between nodes as large as their degree; dashed where phi is negative."""
    degree = pd.concat([edges["src"], edges["dst"]]).value_counts()
    shown = set(sorted(degree.index, key=lambda x: (-degree[x], x))[:DRAWN])
    rows = [r for r in edges.itertuples(index=False) if r.src in shown and r.dst in shown]
    place = {x: (400 + 350 * a, 330 + 290 * b) for x, (a, b) in spring_layout([(r.src, r.dst) for r in rows]).items()}
    body = []
    for r in rows:
        (x1, y1), (x2, y2) = place[r.src], place[r.dst]
        dash = ' stroke-dasharray="4 3"' if r.phi < 0 else ""
        body.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="{LINE}" stroke-width="{0.5 + 3 * abs(r.phi):.2f}"{dash}><title>{html.escape(f"{r.src} and {r.dst}: {r.phi}")}</title></line>')
    for x in sorted(place):
        a, b = place[x]
        body.append(f'<circle cx="{a:.1f}" cy="{b:.1f}" r="{4 + 0.8 * float(degree[x]) ** 0.8:.1f}" fill="{COLOURS.get(roles.get(x, "gene"), BAR)}"><title>{html.escape(x)}</title></circle>')
        if len(place) <= LABELLED:
            body.append(f'<text x="{a + 8:.1f}" y="{b + 3:.1f}">{html.escape(x)}</text>')
    return _svg(800, 660, body, title)


def bars_svg(names: list[str], values: list[float], title: str, lower: list[float] | None = None, upper: list[float] | None = None) -> str:
    """Horizontal bars from zero, the first on top, with interval lines where limits are given."""
    top = max([*values, *(upper or []), 1e-9])
    body = []
    for i, (n, v) in enumerate(zip(names, values)):
        y, width = 34 + 20 * i, 480 * max(v, 0) / top
        body.append(f'<text x="240" y="{y + 11}" text-anchor="end">{html.escape(n if len(n) <= 38 else n[:37] + "…")}</text><rect x="248" y="{y}" width="{width:.1f}" height="14" fill="{BAR}"><title>{html.escape(f"{n}: {v:.3f}")}</title></rect>')
        body.append(f'<text x="{254 + 480 * max(v, upper[i] if upper else v, 0) / top:.1f}" y="{y + 11}">{v:.3g}</text>')
        if lower and upper:
            body.append(f'<line x1="{248 + 480 * lower[i] / top:.1f}" x2="{248 + 480 * upper[i] / top:.1f}" y1="{y + 7}" y2="{y + 7}" stroke="black"/>')
    return _svg(800, 44 + 20 * len(names), body, title)


def histogram_svg(bins: pd.DataFrame, title: str) -> str:
    """Bins (lo, hi, n) as columns of equal width."""
    top, many = max(bins["n"].max(), 1) if len(bins) else 1, max(len(bins), 1)
    body = []
    for i, r in enumerate(bins.itertuples(index=False)):
        tall = 240 * r.n / top
        body.append(f'<rect x="{60 + 680 / many * i:.1f}" y="{280 - tall:.1f}" width="{680 / many - 2:.1f}" height="{tall:.1f}" fill="{BAR}"><title>{r.lo:.3f} to {r.hi:.3f}: {r.n}</title></rect>')
    if len(bins):
        body.append(f'<text x="60" y="296">{bins["lo"].min():.3g}</text><text x="740" y="296" text-anchor="end">{bins["hi"].max():.3g}</text><text x="54" y="44" text-anchor="end">{top}</text>')
    return _svg(800, 310, body, title)


def save(figures: dict[str, tuple[str, str]], out: Path) -> list[tuple[str, str]]:
    """Write name -> (svg, what it shows) as files; (file, what it shows) of each."""
    done = []
    for name, (svg, what) in figures.items():
        (out / f"{name}.svg").write_text(svg)
        done.append((f"{name}.svg", what))
    return done
