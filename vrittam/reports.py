"""Text reports from small aggregates."""

from __future__ import annotations

from collections.abc import Iterable


def table(rows: Iterable[dict], columns: list[str]) -> str:
    """Aligned text table of a few rows."""
    cells = [columns] + [["" if r.get(c) is None else (f"{r[c]:.4f}".rstrip("0").rstrip(".") if isinstance(r[c], float) else str(r[c])) for c in columns] for r in rows]
    width = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in cells)


def histogram(counts: dict[int, int], edges: tuple[float, ...], wide: int = 40) -> str:
    """Bars of bucket counts; an absent bucket is empty."""
    most = max(counts.values(), default=0) or 1
    out = []
    for k in range(len(edges) - 1):
        n = counts.get(k, 0)
        out.append(f"{edges[k]:>6.2f} - {edges[k + 1]:<6.2f} {n:>8} {'#' * round(wide * n / most)}".rstrip())
    return "\n".join(out)


def couplet_report(row) -> str:
    """One analysed couplet (a row of ``metre.analyse``) in words."""
    lines = []
    for k in "12":
        feet = row[f"feet{k}"]
        state = "no division" if feet is None else f"{feet.valid} of 4 feet valid"
        lines.append(f"line {k}: {row[f'line{k}']}\n  weights {row[f'gana{k}']}, {state}, alliteration {row[f'yati{k}'] or 'not tested'}")
    lines.append(f"rhyme {'agrees' if row.prasa else 'differs'}; score {row.overall}; {'valid' if row.is_valid else 'not valid'}")
    return "\n".join(lines)
