"""Counters that are taken in the pass that writes the rows, and their text for a scraper.

``Observation`` hands the totals over when the write ends, so no second job reads the rows again. What reaches the driver is one
number per counter; label values are given, so their number is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Upper bounds in seconds of a latency histogram, if no others are given.
BOUNDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


class Metrics:
    """Gauges by label and histograms over the rows of one write."""

    def __init__(self):
        self.kinds: dict[str, str] = {}
        self.samples: list[tuple[str, str, dict[str, str], Column]] = []  # metric, suffix, labels, aggregate

    def gauge(self, name: str, label: str, values: list[str], column: str) -> Metrics:
        """How many rows have each value; values without rows give 0."""
        self.kinds[name] = "gauge"
        self.samples += [(name, "", {label: v}, F.count_if(F.col(column) == v)) for v in values]
        return self

    def histogram(self, name: str, seconds: str, bounds: list[float] | None = None) -> Metrics:
        """Cumulative counts up to each bound, their sum and number. Nulls are left out."""
        self.kinds[name] = "histogram"
        c = F.col(seconds)
        self.samples += [(name, "_bucket", {"le": str(b)}, F.count_if(c <= b)) for b in bounds or BOUNDS]
        self.samples += [(name, "_bucket", {"le": "+Inf"}, F.count(c)), (name, "_sum", {}, F.coalesce(F.sum(c), F.lit(0.0))), (name, "_count", {}, F.count(c))]
        return self

    def write(self, rows: DataFrame, path: str, mode: str = "errorifexists") -> str:
        """Writes the rows and gives the text of their metrics."""
        seen = Observation()
        rows.observe(seen, *[a.alias(f"m{i}") for i, (_, _, _, a) in enumerate(self.samples)]).write.mode(mode).parquet(path)
        return self.text(seen.get)

    def text(self, values: dict) -> str:
        """One line for the kind of each metric and one for each of its samples."""
        lines = []
        for name, kind in self.kinds.items():
            lines.append(f"# TYPE {name} {kind}")
            for i, (of, suffix, labels, _) in enumerate(self.samples):
                if of == name:
                    shown = ",".join(f'{k}="{_escaped(v)}"' for k, v in labels.items())
                    lines.append(f"{name}{suffix}{'{' + shown + '}' if shown else ''} {float(values[f'm{i}'])}")
        return "\n".join(lines) + "\n"


def _escaped(value: str) -> str:
    return value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
