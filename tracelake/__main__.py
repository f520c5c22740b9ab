"""``python -m tracelake FILE``: parses a waveform file's header; exit code 0 if it is one, else 1."""

from __future__ import annotations

import sys
from pathlib import Path

from tracelake.sources.waveform import parse_header


def main(args: list[str]) -> int:
    if len(args) != 1 or not Path(args[0]).is_file():
        print("no such file" if args else __doc__, file=sys.stderr)
        return 1
    with open(args[0], "rb") as handle:
        head = parse_header(handle)
    if head is None:
        print("no binary part", file=sys.stderr)
        return 1
    print(f"{head.fields.get('Plotname', '')}: {len(head.variables)} variables, {head.n_points} points, {head.scale}, {'complex' if head.is_complex else 'real'}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
