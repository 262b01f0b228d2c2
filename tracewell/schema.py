"""Operations that write, and the two small grammars for sizes and parameters. A request has vtime (its place in the trace, from 1), clock_time, obj_id, obj_size, op, ttl, ns."""

from __future__ import annotations

import re

#: Operations that count as overwriting.
WRITES = ["set", "replace", "cas"]

UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}
AUTO_FRACTIONS = [0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.4, 0.8]


def parse_sizes(spec: str, wss: int) -> list[int]:
    """"1GB,512mb,100" in bytes; an entry with a point is a fraction of the working set; "0" or "auto", the usual fractions."""
    if spec in ("0", "auto"):
        return [max(1, int(f * wss)) for f in AUTO_FRACTIONS]
    out = []
    for x in spec.split(","):
        if "." in x:
            out.append(max(1, int(float(x) * wss)))
            continue
        m = re.fullmatch(r"(\d+)([KMGT]?)(?:I?B)?", x.strip().upper())
        if not m:
            raise ValueError(f"not a size: {x}")
        out.append(int(m[1]) * UNITS[m[2]])
    return out


def parse_params(spec: str) -> dict[str, str]:
    """"k1=v1,k2=v2"; semicolons count as commas, underscores in names as hyphens."""
    pairs = [p.partition("=") for p in spec.replace(";", ",").split(",") if p.strip()]
    return {k.strip().lower().replace("_", "-"): v.strip() for k, _, v in pairs}
