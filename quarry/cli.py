"""Command line: compress, decompress, validate, run-poc, fingerprint."""

from __future__ import annotations

import argparse
import os
import sys
import time

from quarry.operators.validation import report_text
from quarry.plans import pipeline
from quarry.session import session
from quarry.sources import fingerprint, recipes

#: A comparison succeeds from this score.
PASSING = 50.0


def listed(text: str | None) -> list[str] | None:
    return [x.strip() for x in text.split(",") if x.strip()] if text else None


def size_text(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return ""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def compressing(p):
        p.add_argument("--input", required=True)
        p.add_argument("--table-name")
        p.add_argument("--manual-anchors", help="columns, by commas")
        p.add_argument("--random-format", help="columns, by commas")
        p.add_argument("--codec", default="zstd")
        p.add_argument("--level", type=int, default=19)
        p.add_argument("--generate-html-profile", action="store_true")
        p.add_argument("--aggressive-uuid", action="store_true")

    c = commands.add_parser("compress")
    compressing(c)
    c.add_argument("--output", required=True)
    d = commands.add_parser("decompress")
    d.add_argument("--recipe", required=True)
    d.add_argument("--output", required=True)
    d.add_argument("--anchors")
    v = commands.add_parser("validate")
    v.add_argument("--original", required=True)
    v.add_argument("--reconstructed", required=True)
    v.add_argument("--anchor-columns")
    v.add_argument("--recipe")
    f = commands.add_parser("fingerprint", help="pictures of a compressed table, and next to the original")
    f.add_argument("--recipe", required=True)
    f.add_argument("--original")
    f.add_argument("--output", required=True)
    r = commands.add_parser("run-poc")
    compressing(r)
    r.add_argument("--output", default="output")
    return top


def _compress(spark, a):
    return pipeline.compress(
        spark, a.input, a.output, a.table_name, manual_anchors=listed(a.manual_anchors), random_format=listed(a.random_format), codec=a.codec, level=a.level,
        html_profile=a.generate_html_profile, aggressive_uuid=a.aggressive_uuid, anchor_files=1,
    )


def _told(result) -> str:
    return (
        f"{result.n_rows} rows, {result.n_columns} columns: {size_text(result.original_size_bytes)} to {size_text(result.recipe_size_bytes)} recipe "
        f"and {size_text(result.anchor_size_bytes)} anchors, {result.compression_ratio:.2f}:1, in {result.elapsed_seconds:.1f} s"
    )


def _bytes(path: str) -> bytes:
    """A file, or the data files of a folder in order of their names."""
    if os.path.isdir(path):
        return b"".join(_bytes(os.path.join(path, n)) for n in sorted(os.listdir(path)) if not n.startswith(("_", ".")))
    with open(path, "rb") as f:
        return f.read()


def draw(a) -> int:
    compressed = _bytes(a.recipe) + _bytes(recipes.anchor_path(recipes.read(a.recipe), a.recipe))
    fingerprint.write_png(fingerprint.rgb(compressed), f"{a.output}/fingerprint_rgb.png")
    fingerprint.write_png(fingerprint.bases(compressed), f"{a.output}/fingerprint_dna.png")
    if a.original:
        fingerprint.write_png(fingerprint.side_by_side(_bytes(a.original), compressed), f"{a.output}/fingerprint_comparison.png")
    return 0


def run(spark, a) -> int:
    if a.command == "compress":
        print(_told(_compress(spark, a)))
        return 0
    if a.command == "decompress":
        result = pipeline.decompress(spark, a.recipe, a.output, a.anchors)
        print(f"{result.n_rows} rows in {result.elapsed_seconds:.1f} s")
        return 0
    if a.command == "validate":
        bundle = pipeline.validate_pair(spark, a.original, a.reconstructed, listed(a.anchor_columns), a.recipe)
    else:
        began = time.perf_counter()
        made = _compress(spark, a)
        print(_told(made))
        rebuilt = f"{a.output}/reconstructed/{made.recipe.metadata.table_name}.csv"
        pipeline.decompress(spark, made.recipe_path, rebuilt)
        bundle = pipeline.validate_pair(spark, a.input, rebuilt, recipe_path=made.recipe_path)
        print(f"{time.perf_counter() - began:.1f} s in all")
    print(report_text(bundle.report))
    return 0 if bundle.report.overall_score >= PASSING else 1


def main(argv: list[str] | None = None) -> int:
    """0: done, 1: failed, 2: a file is missing, 130: interrupted."""
    a = parser().parse_args(argv)
    try:
        return draw(a) if a.command == "fingerprint" else run(session(), a)
    except KeyboardInterrupt:
        return 130
    except FileNotFoundError as e:
        print(f"no such file: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
