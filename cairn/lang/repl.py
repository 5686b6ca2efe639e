"""A read-eval-print loop, or files of programs: python -m cairn.lang.repl [FILE...]."""

from __future__ import annotations

import sys

from cairn.lang.interpreter import Session
from cairn.lang.parser import Incomplete


def main(files: list[str]) -> int:
    from cairn.session import session as spark_session

    session = Session(stdlib=True, spark=spark_session("language"))
    if files:
        for name in files:
            with open(name) as f:
                print(*session.run(f.read()), sep="\n")
        return 0
    held = ""
    while True:
        try:
            line = input("> " if not held else ". ")
        except EOFError:
            return 0
        held += line + "\n"
        try:
            print(*session.run(held), sep="\n")
        except Incomplete:
            # more lines may complete it; an empty one gives up
            if line:
                continue
            print("SYNTAX ERROR: the expression ends too early")
        held = ""


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
