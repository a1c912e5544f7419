"""Hand-made captures for tests."""

from __future__ import annotations

import copy
import json
import os
import tempfile


def capture(n: int = 4, owner: int | None = None, anchor: int | None = None) -> list[dict]:
    """n command buffers 30 ns apart with one operation each, an anchor wait, a summary."""
    rows: list[dict] = []
    for i in range(n):
        rows.append({"record": "op", "seq": 100 + i, "command_buffer_index": i, "kernel_name": f"k{i}"})
        rows.append(
            {
                "record": "cb", "command_buffer_index": i, "op_count": 1, "first_op_seq": 100 + i, "last_op_seq": 100 + i,
                "encode_start_ns": 10 + 30 * i, "encode_end_ns": 20 + 30 * i,
                "gpu_start_ns": 15 + 30 * i, "gpu_end_ns": 30 + 30 * i,
            }
        )
    wait = {"record": "wait", "bucket": "cb_wait_until_completed", "wait_ns": 7,
            "at_ns": 10 + 30 * (n - 1) + 21 if anchor is None else anchor}
    if owner is not None:
        wait["command_buffer_index"] = owner
    rows.append(wait)
    rows.append(
        {
            "record": "summary", "schema_version": 1, "complete": True, "dropped_rows": 0, "ops_total": n,
            "cbs_total": n, "buckets": {"cb_wait_until_completed": {"count": 1, "total_ns": 7}},
        }
    )
    return rows


def edited(rows: list[dict], index: int, **changes) -> list[dict]:
    """A copy with one row changed; a value of ``...`` removes the field."""
    result = copy.deepcopy(rows)
    for key, value in changes.items():
        if value is ...:
            result[index].pop(key)
        else:
            result[index][key] = value
    return result


def text(rows: list) -> str:
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)


def folder(files: dict[str, str]) -> str:
    """A fresh folder with the given files."""
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name, content in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(content if isinstance(content, bytes) else content.encode())
    return root


def lines(spark, captures: dict[str, list]):
    """Captures as a lines table, without files."""
    rows = [
        (name, number, row if isinstance(row, str) else json.dumps(row))
        for name, listed in captures.items()
        for number, row in enumerate(listed, 1)
    ]
    return spark.createDataFrame(rows, "trace_id string, line_no bigint, value string")
