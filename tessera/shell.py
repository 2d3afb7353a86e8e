"""Interactive shell: ``python -m tessera.shell [directory of Parquet tables]``."""

from __future__ import annotations

import sys

from tessera.engine import Engine
from tessera.session import build_session, local_master
from tessera.sources import open_tables


def main(args: list[str]) -> None:
    engine = Engine(build_session("tessera-shell", local_master()))
    if args:
        open_tables(engine.spark, args[0])
    while True:
        try:
            print(engine.command(input("> ")))
        except EOFError:
            return
        except Exception as error:  # the shell goes on after a failing statement
            print(f"error: {str(error).splitlines()[0]}")


if __name__ == "__main__":
    main(sys.argv[1:])
