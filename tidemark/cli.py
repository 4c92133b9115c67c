"""A small shell over a durable table: put k v…, get k, del k, flush, exit."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from tidemark.operators.table import NotFound, VersionedTable


def answer(table: VersionedTable, line: str) -> str | None:
    """The reply to one line; None ends the shell."""
    match line.split():
        case []:
            return ""
        case ["exit" | "quit"]:
            return None
        case ["put", key, first, *rest]:
            table.put(key.encode(), " ".join([first, *rest]).encode())
            return "ok"
        case ["get", key]:
            try:
                return table.get(key.encode()).decode()
            except NotFound:
                return "(not found)"
        case ["del", key]:
            table.delete(key.encode())
            return "ok"
        case ["flush"]:
            table.flush()
            return "ok"
        case ["items"]:
            return "\n".join(f"{bytes(r.key).decode()} = {bytes(r.value).decode()}" for r in table.items().toLocalIterator())
        case _:
            return "put <key> <value> | get <key> | del <key> | items | flush | exit"


def run(table: VersionedTable, lines: Iterable[str]) -> None:
    for line in lines:
        reply = answer(table, line)
        if reply is None:
            return
        print(reply, flush=True)


if __name__ == "__main__":
    from tidemark.session import local_session

    run(VersionedTable(local_session(), sys.argv[1]), sys.stdin)
