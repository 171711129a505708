"""Command line: one scene source to its documents."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from dataclasses import fields

from tesserae.engine import Request, SceneEngine

#: The options, each with the field of Request that it sets. Defaults are those of Request.
OPTIONS = {
    "--output": "scene_output",
    "--graph-output": "graph_output",
    "--no-graph": "build_graph",
    "--package": "build_package",
    "--optimize-package-by-visibility": "optimize_package_by_visibility",
    "--frame-start": "frame_start",
    "--frame-end": "frame_end",
    "--package-output": "package_output",
    "--cache-dir": "cache_dir",
    "--blender-executable": "reader",
    "--reader-script": "reader_script",
}
SHORT = {"--output": "-o"}


def parser() -> argparse.ArgumentParser:
    """An option for each entry of OPTIONS; those of flags turn their field's default around."""
    p = argparse.ArgumentParser(prog="tesserae", description="Analyse a scene description.")
    p.add_argument("input_path", metavar="input", help="JSON payload or binary scene file")
    defaults = {f.name: f.default for f in fields(Request)}
    for option, target in OPTIONS.items():
        names, default = [*filter(None, [SHORT.get(option)]), option], defaults[target]
        if isinstance(default, bool):
            p.add_argument(*names, dest=target, action="store_const", const=not default, default=default)
        else:
            p.add_argument(*names, dest=target, type=int if isinstance(default, int) else str, default=default)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    """0 if all went well, 1 on a source that is not there or cannot be read."""
    try:
        result = SceneEngine().run(Request(**vars(parser().parse_args(argv))))
    except (FileNotFoundError, ValueError, TypeError) as error:  # broken JSON is a ValueError
        print(f"Error: {error}", file=sys.stderr)
        return 1
    print(*result.messages, sep="\n")
    print(*result.warnings, sep="\n", end="\n" if result.warnings else "", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
