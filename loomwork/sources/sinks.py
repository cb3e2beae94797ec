"""Results as JSON, CSV and text, and metrics as CSV."""

from __future__ import annotations

import csv
import datetime
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TooLargeError
from ..functions.dialect import name
from ..operators.scan import renamed

NO_ROWS = "(no rows)"
#: Rows that an envelope brings to the driver at most.
LARGEST_RESULT = 1_000_000


def envelope(df: DataFrame, largest: int = LARGEST_RESULT) -> dict:
    """{rowCount, executionMs, data}: the result of a request, for JSON.

    It comes to the driver, so a result of more than `largest` rows is refused
    with an error (write it with `write_csv`, or ask for fewer rows).
    """
    began = time.perf_counter()
    plain = lambda v: v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v
    rows = df.limit(largest + 1).collect()
    if len(rows) > largest:
        raise TooLargeError(f"more than {largest} rows")
    data = [{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in rows]
    return {"rowCount": len(rows), "executionMs": int((time.perf_counter() - began) * 1000), "data": data}


def write_csv(df: DataFrame, folder: str, aliases: dict[str, str] | None = None, decimals: int | None = None, placeholder: str | None = None) -> None:
    """Part files with a header, doubles with that many decimals if given, null as empty; written by the executors.

    An empty result leaves one file with the header or, if given, the placeholder.
    """
    double = (T.FloatType, T.DoubleType)
    fixed = lambda f: F.when(name(f.name).isNotNull(), F.format_string(f"%.{decimals}f", name(f.name)))
    out = df.select([(fixed(f) if decimals is not None and isinstance(f.dataType, double) else name(f.name)).alias(f.name) for f in df.schema.fields])
    if placeholder is not None and not df.take(1):
        df.sparkSession.range(1, numPartitions=1).select(F.lit(placeholder).alias("value")).write.mode("overwrite").text(folder)
        return
    renamed(out, aliases or {}).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(folder)


def table_text(df: DataFrame, aliases: dict[str, str] | None = None, rows: int = 100) -> str:
    """A box of the first rows, for a console; a last line tells if there are more."""
    df = renamed(df, aliases or {})
    got = df.take(rows + 1)
    cells = [["" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r] for r in got[:rows]]
    if not cells:
        return NO_ROWS
    width = [max(len(x) for x in column) for column in zip(df.columns, *cells, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) + " |"
    more = [f"(the first {rows} rows; there are more)"] if len(got) > rows else []
    return "\n".join([rule, line(df.columns), rule, *map(line, cells), rule, *more])


def write_metrics(metrics, path: str) -> None:
    """operation, rowCount, elapsedMs and elapsedNs of benchmark metrics."""
    with Path(path).open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["operation", "rowCount", "elapsedMs", "elapsedNs"])
        out.writerows([m.operation, m.rows, m.elapsed_ns // 1_000_000, m.elapsed_ns] for m in metrics)


def write_trace(metrics, path: str, title: str = "Benchmark") -> None:
    """A Markdown report of benchmark metrics."""
    lines = [f"# {title}", "", "| operation | rows | ms |", "| --- | ---: | ---: |", *(f"| {m.operation} | {m.rows} | {m.elapsed_ns / 1e6:.1f} |" for m in metrics)]
    Path(path).write_text("\n".join(lines) + "\n")


def write_plot(by_scale: dict, path: str, title: str = "Benchmark") -> None:
    """A script that draws the times of each operation over the scales (rows) with matplotlib, the figures written into it."""
    lines: dict[str, list[tuple[int, float]]] = {}
    for scale, metrics in sorted(by_scale.items()):
        for m in metrics:
            if not m.error:
                lines.setdefault(m.operation, []).append((scale, round(m.elapsed_ns / 1e6, 3)))
    Path(path).write_text(
        "import matplotlib.pyplot as plt\n\n"
        f"TIMES = {lines!r}\n\n"
        "for operation, points in TIMES.items():\n"
        "    plt.plot([x for x, _ in points], [y for _, y in points], marker='o', label=operation)\n"
        "plt.xlabel('rows')\nplt.ylabel('ms')\n"
        f"plt.title({title!r})\nplt.legend()\nplt.savefig({str(Path(path).with_suffix('.png'))!r})\n"
    )
