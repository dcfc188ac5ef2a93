"""Figures of a profile as SVG, drawn from small results: bins, curves, boxes and matrices, never rows of data."""

from __future__ import annotations

from html import escape

from pyspark.sql import SparkSession

from ..catalog import Catalog
from ..sources.tables import write_text

BLUE, DARK, RED, ORANGE, GREEN, PALE = "#2196F3", "#0D47A1", "#e74c3c", "#FF9800", "#4caf50", "#bbdefb"
MARGIN = 50


def _line(x1, y1, x2, y2, color=DARK, more="") -> str:
    return f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="{color}" {more}/>'


def _box(x, y, width, height, color) -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(width, 0):.1f}" height="{max(height, 0):.1f}" fill="{color}"/>'


def _text(x, y, said, size=10, more="") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" font-family="sans-serif" {more}>{escape(str(said))}</text>'


def page(width: float, height: float, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:.0f} {height:.0f}">{_box(0, 0, width, height, "white")}{"".join(parts)}</svg>\n'


def _scale(low: float, high: float, start: float, end: float):
    """Places for values between ``low`` and ``high``; all in the middle if they are one."""
    span = high - low
    return lambda v: start + (end - start) * ((v - low) / span if span else 0.5)


def histogram(title: str, bins: list, curve: list, marks: dict[str, float], width: float = 480, height: float = 320) -> list[str]:
    """Bars of (low, high, n), a density curve of (x, density) as counts in a bin, and marked values."""
    if not bins:
        return [_text(MARGIN, MARGIN, f"{title}: no values")]
    total, each = sum(n for *_, n in bins), bins[0][1] - bins[0][0]
    scaled = [(x, d * total * each) for x, d in curve]
    x = _scale(bins[0][0], bins[-1][1], MARGIN, width - MARGIN)
    y = _scale(0, max([n for *_, n in bins] + [d for _, d in scaled]), height - MARGIN, MARGIN)
    parts = [_text(width / 2, 20, title, 12, 'text-anchor="middle" font-weight="bold"')]
    parts += [_box(x(a), y(n), x(b) - x(a) - 0.5, y(0) - y(n), BLUE) for a, b, n in bins]
    if scaled:
        parts.append(f'<polyline fill="none" stroke="{DARK}" stroke-width="2" points="{" ".join(f"{x(a):.1f},{y(d):.1f}" for a, d in scaled)}"/>')
    for k, (name, value) in enumerate(marks.items()):
        if value is not None:
            parts += [_line(x(value), y(0), x(value), MARGIN, (RED, GREEN)[k % 2], 'stroke-dasharray="4"'), _text(width - MARGIN - 110, 40 + 14 * k, f"{name} = {value:.2f}")]
    parts += [_line(MARGIN, y(0), width - MARGIN, y(0))]
    return parts + [_text(x(v), height - MARGIN + 16, f"{v:.4g}", 9, 'text-anchor="middle"') for v in (bins[0][0], (bins[0][0] + bins[-1][1]) / 2, bins[-1][1])]


def boxes(title: str, rows: list[dict], color: str = "black", width: float = 240, height: float = 320) -> list[str]:
    """Boxes with whiskers, one for each row (label, low, q1, median, q3, high, and fliers as (place, n)), beside each other."""
    rows = [r for r in rows if r["median"] is not None]
    parts = [_text(width / 2, 20, title, 11, f'text-anchor="middle" font-weight="bold" fill="{color}"')]
    ends = [v for r in rows for v in (r["low"], r["high"], *(p for p, _ in r.get("fliers", [])))]
    if not ends:
        return parts
    y = _scale(min(ends), max(ends), height - MARGIN, MARGIN)
    for k, r in enumerate(rows):
        middle, half = MARGIN + (width - 2 * MARGIN) * (k + 0.5) / len(rows), (width - 2 * MARGIN) / len(rows) / 3
        parts += [_line(middle, y(r["low"]), middle, y(r["high"])), _box(middle - half, y(r["q3"]), 2 * half, y(r["q1"]) - y(r["q3"]), PALE)]
        parts += [_line(middle - half, y(r["median"]), middle + half, y(r["median"]), RED, 'stroke-width="2"')]
        parts += [_line(middle - half / 2, y(r[end]), middle + half / 2, y(r[end])) for end in ("low", "high")]
        parts += [f'<circle cx="{middle:.1f}" cy="{y(p):.1f}" r="2.5" fill="#FF5722" fill-opacity="0.5"><title>{n}</title></circle>' for p, n in r.get("fliers", [])]
        parts.append(_text(middle, height - MARGIN + 16, r["label"], 9, 'text-anchor="middle"'))
    return parts + [_text(4, y(v), f"{v:.4g}", 8) for v in (min(ends), max(ends))]


def grid(title: str, cells: list[list[str]], columns: int, width: float = 240, height: float = 320) -> str:
    """Small figures in rows of ``columns``."""
    parts = [_text(columns * width / 2, 18, title, 14, 'text-anchor="middle" font-weight="bold"')]
    for k, cell in enumerate(cells):
        parts.append(f'<g transform="translate({k % columns * width:.0f},{k // columns * height + 24:.0f})">{"".join(cell)}</g>')
    return page(columns * width, -(-len(cells) // columns) * height + 24, parts)


def _shade(share: float) -> str:
    """White at 0, red towards 1, blue towards -1."""
    share = max(-1.0, min(1.0, share))
    fade = round(255 * (1 - abs(share)))
    return f"rgb(255,{fade},{fade})" if share >= 0 else f"rgb({fade},{fade},255)"


def heatmap(title: str, rows: list[str], columns: list[str], cells: dict[tuple[str, str], float | None], each: float = 18, told: bool = False) -> str:
    """A matrix of shades for values from -1 to 1; missing ones stay grey."""
    left, wide = 130, each if len(columns) < 100 else each / 3
    parts = [_text(left, 18, title, 13, 'font-weight="bold"')]
    for i, r in enumerate(rows):
        parts.append(_text(left - 4, 30 + (i + 0.7) * each, r, 8, 'text-anchor="end"'))
        for j, c in enumerate(columns):
            if (r, c) in cells:
                v = cells[r, c]
                parts.append(_box(left + j * wide, 30 + i * each, wide, each, "#ddd" if v is None else _shade(v)))
                if told and v is not None:
                    parts.append(_text(left + (j + 0.5) * wide, 30 + (i + 0.7) * each, f"{v:.2f}", 6, 'text-anchor="middle"'))
    if len(columns) < 100:
        parts += [_text(left + (j + 0.5) * wide, 40 + len(rows) * each, c, 8, f'transform="rotate(60 {left + (j + 0.5) * wide:.1f} {40 + len(rows) * each:.1f})"') for j, c in enumerate(columns)]
    return page(left + len(columns) * wide + 40, 30 + len(rows) * each + 110, parts)


def bars(title: str, counts: list[tuple[str, int]], width: float = 640) -> str:
    """Counts by label with their shares."""
    total, most = sum(n for _, n in counts) or 1, max((n for _, n in counts), default=1)
    parts = [_text(width / 2, 20, title, 13, 'text-anchor="middle" font-weight="bold"')]
    for k, (label, n) in enumerate(counts):
        parts += [_text(150, 50 + 26 * k, label, 10, 'text-anchor="end"'), _box(156, 36 + 26 * k, 340 * n / most, 20, BLUE), _text(160 + 340 * n / most, 50 + 26 * k, f"{n:,} ({n / total * 100:.1f}%)", 9)]
    return page(width, 60 + 26 * len(counts), parts)


def _square(pairs: list, names: list[str]) -> dict[tuple[str, str], float | None]:
    """The lower triangle of pairs, 1 on the diagonal."""
    place = {n: k for k, n in enumerate(names)}
    cells: dict[tuple[str, str], float | None] = {(n, n): 1.0 for n in names}
    for p in pairs:
        a, b = sorted((p["variable_1"], p["variable_2"]), key=place.__getitem__)
        cells[b, a] = p["r"]
    return cells


def figures(found, catalog: Catalog) -> dict[str, str]:
    """All figures of a profile by path. ``found`` holds small results alone, so they are collected here."""
    data = {name: [r.asDict() for r in df.collect()] for name, df in found.plots.items()}
    of = lambda name, variable: [r for r in data[name] if r["variable"] == variable]
    shapes = {r["variable"]: r for r in found.distributions.collect()}
    beyond = {r["variable"]: r for r in found.outliers.collect()}
    made, summary = {}, []
    for v, s in shapes.items():
        bins = [(r["low"], r["high"], r["n"]) for r in of("histograms", v)]
        curve = [(r["x"], r["density"]) for r in of("curves", v)]
        fliers = [(r["place"], r["n"]) for r in of("flier_bins", v)]
        own = [{"label": "", "low": r["whisker_low"], "high": r["whisker_high"], **{k: r[k] for k in ("q1", "median", "q3")}, "fliers": fliers} for r in of("boxes", v)]
        told = f"{v} | n={s['n_valid']:,} | skew={_number(s['skewness'])} | kurt={_number(s['kurtosis'])}"
        left = histogram(told, bins, curve, {"Mean": s["mean"], "Median": s["median"]})
        made[f"distributions/individual/{v}.svg"] = page(720, 320, [*left, f'<g transform="translate(480,0)">{"".join(boxes("Box plot", own))}</g>'])
        o = beyond.get(v)
        extreme = o["n_extreme_outliers"] if o else 0
        made[f"outliers/individual/{v}_boxplot.svg"] = page(400, 320, boxes(f"{v}: extreme {extreme}, suspicious {o['n_suspicious'] if o else 0}", own, width=400))
        color = RED if extreme > 20 else ORANGE if extreme > 5 else GREEN
        summary.append(boxes(f"{v} ext={extreme}", own, color))
    made["outliers/outliers_summary_grid.svg"] = grid("Outliers (red: many extremes, orange: some, green: few)", summary, 4)
    stretches = data["stretches"]
    measured = [c for c in (stretches[0] if stretches else {}) if c not in ("stretch", "n_rows")]
    names = [str(r["stretch"]) for r in stretches]
    made["missingness/missingness_heatmap.svg"] = heatmap("Share of missing cells, along the key", measured, names, {(c, str(r["stretch"])): r[c] for r in stretches for c in measured})
    met = [c for c in measured if any(c in (p["variable_1"], p["variable_2"]) for p in data["missing_correlations"])]
    made["missingness/missingness_correlation.svg"] = heatmap("Correlation of missingness", met, met, _square(data["missing_correlations"], met))
    features = list(catalog.features)
    made["correlations/correlation_heatmap.svg"] = heatmap("Pearson correlation", features, features, _square([r.asDict() for r in found.correlations.collect()], features), each=24, told=True)
    age = found.age.first()
    bins = [(r["low"], r["high"], r["n"]) for r in data["age_histogram"]]
    made["demographics/age_distribution.svg"] = page(480, 320, histogram("Age distribution", bins, [(r["x"], r["density"]) for r in data["age_curve"]], {"Mean": age["mean"], "Median": age["median"]}))
    for k, (code, counts) in enumerate(found.label_counts.items()):
        made[f"demographics/{_LABELLED[k] if k < len(_LABELLED) else code}_distribution.svg"] = bars(f"{code}: distribution", [(r[0], r["n"]) for r in counts.collect()])
    first, *_ = catalog.labels
    for name, label_set in (("gender", f"{first}_label"), ("age_group", f"{catalog.age_column}_bin")):
        rows = [r for r in data["label_sets"] if r["label_set"] == label_set and r["label"] is not None]
        each = [[{"label": r["label"], "low": r["min"], "high": r["max"], **{k: r[k] for k in ("q1", "median", "q3")}} for r in sorted(rows, key=lambda r: r["label"]) if r["variable"] == v] for v in dict.fromkeys(r["variable"] for r in rows)]
        titles = list(dict.fromkeys(r["variable"] for r in rows))
        made[f"demographics/biomarkers_by_{name}.svg"] = grid(f"By {name.replace('_', ' ')}: quartiles, least and greatest", [boxes(t, e) for t, e in zip(titles, each)], 5)
    return made


# What the first two coded columns are called in file names.
_LABELLED = ("gender", "ethnicity")


def _number(value) -> str:
    return "-" if value is None else f"{value:.2f}"


def write_figures(spark: SparkSession, found, folder: str, catalog: Catalog) -> list[str]:
    """All figures below ``folder``; their paths there."""
    made = figures(found, catalog)
    for path, svg in made.items():
        write_text(spark, f"{folder}/{path}", svg)
    return sorted(made)
