"""Assemble a self-contained DuckDB statement from named relations."""

import re

from oracle.relations import RELATIONS

_NAME = re.compile(r"\{([a-z_][a-z_0-9]*)\}")


def build(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prepend, as CTEs, every relation the statement reads directly or through another one."""
    known = {**RELATIONS, **(extra or {})}
    done: dict[str, str] = {}

    def need(text: str) -> str:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in known and name not in done:
                body = need(known[name])
                done[name] = body
        return _NAME.sub(lambda m: f'"{m.group(1)}"', text)

    main = need(sql)
    if not done:
        return main
    return "WITH " + ",\n".join(f'"{n}" AS MATERIALIZED ({b})' for n, b in done.items()) + f"\nSELECT * FROM ({main})"
