"""A profile as a small HTML page."""

from __future__ import annotations

import os
from html import escape

from quarry.model import ColumnProfile


def write_profile(profiles: list[ColumnProfile], path: str, title: str) -> str:
    rows = []
    for p in profiles:
        stats = p.numeric_stats or p.datetime_stats or p.categorical_stats
        told = "" if stats is None else ", ".join(f"{k}: {v}" for k, v in list(stats.to_dict().items())[:8])
        cells = (p.name, p.column_type.value, p.n_total, p.n_null, p.n_unique, told, ", ".join(map(str, p.examples)))
        rows.append("<tr>" + "".join(f"<td>{escape(str(c))}</td>" for c in cells) + "</tr>")
    head = "".join(f"<th>{h}</th>" for h in ("column", "type", "rows", "nulls", "distinct", "statistics", "examples"))
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table border=1><tr>{head}</tr>{''.join(rows)}</table>\n")
    return path
