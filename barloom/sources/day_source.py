"""Binary day files as a data source: spark.read.format("day_files").load(<root>).

A file <root>/<market>/lday/<market>NNNNNN.day (or anywhere under root) holds one instrument's bars. Partitions are
planned by file and size: small files are packed up to `partition_bytes`, large ones are cut at record bounds.
Conditions on market and symbol prune files before any task starts; conditions on the day are judged on the records'
numbers, before anything is converted.

Options: markets ("sh,sz": only these, in this order), universe ("ashare" or "all"), limit_symbols (only so many files,
the first in that order), partition_bytes.

Names that are no market and six digits are passed over, and so are a partial record at the end and days that are no
dates. A root without files gives no rows; a root that is not there is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

#: Prefixes of A-share symbols by market.
A_SHARES = {"sh": ("600", "601", "603", "605", "688", "689"), "sz": ("000", "001", "002", "003", "300", "301"), "bj": ("43", "83", "87", "88", "92")}
#: A day record: little-endian date, open, high, low, close (hundredths), amount, volume, reserved.
RECORD = np.dtype([("date", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<u4"), ("reserved", "<u4")])
SCHEMA = "market string, symbol string, trade_date date, trade_year int, open double, high double, low double, close double, volume long, amount double"
COMPARED = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


@dataclass(frozen=True)
class DayFile:
    market: str
    symbol: str
    path: str
    size: int


class Parts(InputPartition):
    """(market, symbol, path, first byte, bytes) of one task."""

    def __init__(self, parts: list[tuple[str, str, str, int, int]]):
        self.parts = parts


class DayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.markets = [m.strip().lower() for m in options.get("markets", "sh,sz,bj").split(",") if m.strip()]
        if unknown := set(self.markets) - A_SHARES.keys():
            raise ValueError(f"markets: {sorted(unknown)}")
        self.universe = options.get("universe", "ashare")
        if self.universe not in ("ashare", "all"):
            raise ValueError(f"universe: {self.universe}")
        self.limit = int(options["limit_symbols"]) if options.get("limit_symbols") else None
        self.bytes = int(options.get("partition_bytes", 32 << 20))
        self.keys: list[Filter] = []
        self.days: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on market and symbol for files, and such on day and year for records."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("market", "symbol") and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.keys.append(f)
            elif name in ("trade_date", "trade_year") and isinstance(f, (*COMPARED, IsNotNull)):
                self.days.append(f)
            else:
                yield f

    def wanted(self, f: DayFile) -> bool:
        if self.universe == "ashare" and not f.symbol.startswith(A_SHARES[f.market]):
            return False
        for k in self.keys:
            x = getattr(f, k.attribute[0])
            if isinstance(k, EqualTo) and x != k.value or isinstance(k, In) and x not in k.value or isinstance(k, StringStartsWith) and not x.startswith(k.value):
                return False
        return True

    def listed(self) -> list[DayFile]:
        """All files of the markets and the universe, by market as configured, then by symbol."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        out = []
        for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            m = re.fullmatch(r"(sh|sz|bj)(\d{6})\.day", x.base_name.lower())
            if m and x.type == pafs.FileType.File and m[1] in self.markets:
                out.append(DayFile(m[1], m[2], x.path, x.size))
        return sorted(out, key=lambda f: (self.markets.index(f.market), f.symbol, f.path))

    def files(self) -> list[DayFile]:
        """Files to read. A limit on symbols counts files of the universe, before conditions of the query prune any."""
        own = [f for f in self.listed() if self.universe == "all" or f.symbol.startswith(A_SHARES[f.market])]
        return [f for f in own[: self.limit] if self.wanted(f)]

    def partitions(self) -> list[Parts]:
        step = max(RECORD.itemsize, self.bytes // RECORD.itemsize * RECORD.itemsize)
        out, held, total = [], [], 0
        for f in self.files():
            whole = f.size // RECORD.itemsize * RECORD.itemsize
            for at in range(0, whole, step):
                size = min(step, whole - at)
                if held and total + size > step:
                    out.append(Parts(held))
                    held, total = [], 0
                held.append((f.market, f.symbol, f.path, at, size))
                total += size
        return [*out, Parts(held)]

    def kept(self, number: np.ndarray) -> np.ndarray:
        """Which days (as yyyymmdd) meet all conditions."""
        keep = np.ones(len(number), bool)
        for f in self.days:
            if isinstance(f, IsNotNull):
                continue
            year = f.attribute[0] == "trade_year"
            value = f.value if year else int(f"{f.value:%Y%m%d}")
            keep &= COMPARED[type(f)](number // 10_000 if year else number, value)
        return keep

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for market, symbol, path, at, size in partition.parts:
            with fs.open_input_file(path) as f:
                r = np.frombuffer(f.read_at(size, at), RECORD)
            r = r[self.kept(r["date"].astype(np.int64))]
            number = r["date"].astype(np.int64)
            day = np.array([days_since_epoch(x) for x in number.tolist()], float)
            r, number, day = r[~np.isnan(day)], number[~np.isnan(day)], day[~np.isnan(day)]
            if not len(r):
                continue
            prices = [pa.array(r[c] / 100.0) for c in ("open", "high", "low", "close")]
            names = ["market", "symbol", "trade_date", "trade_year", "open", "high", "low", "close", "volume", "amount"]
            yield pa.RecordBatch.from_arrays([pa.array([market] * len(r)), pa.array([symbol] * len(r)), pa.array(day.astype(np.int32)).cast(pa.date32()), pa.array((number // 10_000).astype(np.int32)), *prices, pa.array(r["volume"].astype(np.int64)), pa.array(r["amount"].astype(float))], names)


def days_since_epoch(number: int) -> float:
    """Of yyyymmdd; NaN where that is no date."""
    try:
        return float(date(number // 10_000, number // 100 % 100, number % 100).toordinal() - 719_163)
    except ValueError:
        return float("nan")


class DaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "day_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DayReader:
        return DayReader(dict(self.options))
