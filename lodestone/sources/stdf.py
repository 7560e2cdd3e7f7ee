"""Binary test logs (STDF V4, a public format): bytes to records; records to rows by the windows of operators.conditions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.session import ship

SCHEMA = (
    "path string, ord int, rec_type string, head int, site int, test_num bigint, test_flg int, result double, test_txt string, units string, lo double, hi double, opt_flag int, pin int, part_id string, "
    "part_flg int, x int, y int, hard_bin int, soft_bin int, test_time_ms bigint, text string, lot string, wafer string"
)
# Record type and subtype.
RECORDS = {(1, 10): "MIR", (2, 10): "WIR", (5, 10): "PIR", (5, 20): "PRR", (15, 10): "PTR", (15, 15): "MPR", (15, 20): "FTR", (50, 30): "DTR"}
_EMPTY = dict.fromkeys(c.split()[0] for c in SCHEMA.split(", "))


class _Fields:
    """Reads the fields of one record; a record may end early, then the rest is null."""

    def __init__(self, data: bytes, order: str) -> None:
        self.data, self.at, self.order = data, 0, order

    def num(self, code: str):
        size = struct.calcsize(code)
        if self.at + size > len(self.data):
            self.at = len(self.data)
            return None
        v = struct.unpack_from(self.order + code, self.data, self.at)[0]
        self.at += size
        return v

    def text(self) -> str | None:
        n = self.num("B")
        if n is None:
            return None
        v = self.data[self.at : self.at + n].decode("latin-1")
        self.at += n
        return v

    def skip(self, n: int) -> None:
        self.at = min(len(self.data), self.at + n)


def records(data: bytes) -> Iterator[dict]:
    """SRC29, SRC30, WN11: the records of a log in order; a pin list gives a row for each pin, a functional test no result."""
    order = "<"
    if len(data) >= 5 and data[2:4] == b"\x00\x0a":
        order = ">" if data[4] == 1 else "<"
    at = ord_ = 0
    while at + 4 <= len(data):
        size, kind, sub = struct.unpack_from(order + "HBB", data, at)
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        name = RECORDS.get((kind, sub))
        if name is None:
            continue
        f, row = _Fields(body, order), {**_EMPTY, "rec_type": name, "ord": ord_}
        ord_ += 1
        if name == "MIR":
            f.skip(15)
            row["lot"] = f.text()
        elif name == "WIR":
            row["head"] = f.num("B")
            f.skip(5)
            row["wafer"] = f.text()
        elif name == "DTR":
            row["text"] = f.text()
        elif name == "PIR":
            row["head"], row["site"] = f.num("B"), f.num("B")
        elif name == "PRR":
            row["head"], row["site"], row["part_flg"] = f.num("B"), f.num("B"), f.num("B")
            f.skip(2)
            row["hard_bin"], row["soft_bin"], x, y, row["test_time_ms"], row["part_id"] = f.num("H"), f.num("H"), f.num("h"), f.num("h"), f.num("I"), f.text()
            row["x"], row["y"] = (None if v == -32768 else v for v in (x, y))
        else:
            row["test_num"], row["head"], row["site"], row["test_flg"] = f.num("I"), f.num("B"), f.num("B"), f.num("B")
            if name == "PTR":
                f.skip(1)
                row["result"], row["test_txt"] = f.num("f"), f.text()
                f.text()
                row["opt_flag"] = f.num("B")
                f.skip(3)
                row["lo"], row["hi"], row["units"] = f.num("f"), f.num("f"), f.text()
            elif name == "MPR":
                f.skip(1)
                pins, values = f.num("H") or 0, f.num("H") or 0
                f.skip((pins + 1) // 2)
                results = [f.num("f") for _ in range(values)]
                row["test_txt"] = f.text()
                f.text()
                row["opt_flag"] = f.num("B")
                f.skip(3)
                row["lo"], row["hi"] = f.num("f"), f.num("f")
                f.skip(8)
                index = [f.num("H") for _ in range(pins)]
                row["units"] = f.text()
                for i, v in enumerate(results):
                    pin = index[i] if i < len(index) and index[i] is not None else i
                    yield {**row, "result": v, "pin": pin, "test_txt": f"{row['test_txt'] or ''}[{pin}]"}
                continue
        yield row


def parse(files: DataFrame) -> DataFrame:
    """files(path, content) to one row of SCHEMA for each record. A file is one ordered unit; files spread over tasks."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, data in zip(pdf["path"], pdf["content"]):
                rows = []
                for r in records(bytes(data)):
                    rows.append({**r, "path": path})
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=list(_EMPTY))
    for c in SCHEMA.split(", "):
        name, kind = c.split()
        if kind in ("int", "bigint"):
            out[name] = out[name].astype("Int64" if kind == "bigint" else "Int32")
    return out
