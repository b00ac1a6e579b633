"""The data model: recordings of samples, and cycles cut from them.

samples     rec, filename, idx, frequency, comment, markers ARRAY<STRING>, and a DOUBLE column per channel
cycles      tables (rec, wave_no, and columns): a channel of cycles is an ARRAY<DOUBLE> column, a mask an INT column

Channels that were derived from each other share a table, so a step between them is a projection; channels of different tables are joined by (rec, wave_no).
A null array says that the recording has no such cycle. All of it is lazy: a Dataset holds plans, and a step returns a new Dataset.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ondula.workers import reach_workers

RESERVED = ("rec", "filename", "idx", "frequency", "comment", "markers")


def by_time() -> WindowSpec:
    return Window.partitionBy("rec").orderBy("idx")


def whole() -> WindowSpec:
    return Window.partitionBy("rec")


class PipelineError(ValueError):
    """A pipeline that names what does not exist, or asks for what cannot be done."""


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Table:
    """Cycles of one partition: the plan, and the columns by channel and mask name."""

    frame: DataFrame
    channels: tuple[str, ...] = ()
    masks: tuple[str, ...] = ()
    sparse: bool = True  # recordings may be without any cycle


@dataclass(frozen=True)
class Dataset:
    samples: DataFrame
    channels: tuple[str, ...]
    tables: tuple[Table, ...] = field(default=())
    rates: tuple[float, ...] | None = None  # the sampling rates, where a reader knows them

    def __post_init__(self) -> None:
        reach_workers(self.samples.sparkSession)

    # samples

    def needs(self, *names: str) -> None:
        for name in names:
            if name not in self.channels:
                raise PipelineError(f"no sample channel {name!r}; there are {', '.join(self.channels)}")

    def sampling_rates(self) -> tuple[float, ...]:
        """The distinct rates, which windows need as literals: a job over the samples only where no reader has told them."""
        return self.rates or tuple(r[0] for r in self.samples.select("frequency").distinct().collect())

    def with_samples(self, samples: DataFrame, *added: str) -> Dataset:
        return replace(self, samples=samples, channels=(*self.channels, *(a for a in dict.fromkeys(added) if a not in self.channels)))

    def recordings(self) -> DataFrame:
        return self.samples.groupBy("rec").agg(F.first("filename").alias("filename"), F.first("frequency").alias("frequency"))

    # cycles

    def table_of(self, channel: str) -> int:
        """The newest table with the channel."""
        for i in reversed(range(len(self.tables))):
            if channel in self.tables[i].channels:
                return i
        raise PipelineError(f"no cycles {channel!r}; there are {', '.join(c for t in self.tables for c in t.channels) or 'none'}")

    def has(self, channel: str) -> bool:
        return any(channel in t.channels for t in self.tables)

    def mask_table(self, mask: str) -> int | None:
        for i in reversed(range(len(self.tables))):
            if mask in self.tables[i].masks:
                return i
        return None

    def put(self, i: int, table: Table) -> Dataset:
        return replace(self, tables=(*self.tables[:i], table, *self.tables[i + 1 :]))

    def add_table(self, table: Table) -> Dataset:
        """A new table; its channels and masks replace older ones of the same name."""
        older = tuple(
            replace(t, channels=tuple(c for c in t.channels if c not in table.channels), masks=tuple(m for m in t.masks if m not in table.masks)) for t in self.tables
        )
        return replace(self, tables=(*older, table))

    def derive(self, source: str, out: str, values: Column) -> Dataset:
        """A channel computed from its neighbours in the source's table."""
        i = self.table_of(source)
        table = self.tables[i]
        changed = replace(table, frame=table.frame.withColumn(_column(out), values), channels=(*(c for c in table.channels if c != out), out))
        cleared = self.add_table(Table(table.frame, (out,)))  # drops the name elsewhere
        return replace(cleared, tables=cleared.tables[:-1]).put(i, changed)

    def set_mask(self, i: int, mask: str, ok: Column) -> Dataset:
        table = self.tables[i]
        masks = (*(m for m in table.masks if m != mask), mask)
        return self.put(i, replace(table, frame=table.frame.withColumn(_mask(mask), ok), masks=masks))

    def together(self, channels: list[str], masks: list[str] = ()) -> tuple[Dataset, int]:
        """The dataset with all named channels (and masks, where they exist) in one table, and that table."""
        first = self.table_of(channels[0])
        wanted = dict.fromkeys([self.table_of(c) for c in channels] + [t for m in masks if (t := self.mask_table(m)) is not None])
        if len(wanted) == 1:
            return self, first
        frame, got, kept = self.tables[first].frame, self.tables[first].channels, self.tables[first].masks
        for i in wanted:
            if i == first:
                continue
            other = self.tables[i]
            columns = {_column(c): c for c in other.channels if c in channels} | {_mask(m): m for m in other.masks if m in masks}
            side = other.frame.select("rec", "wave_no", *columns)
            frame = frame.drop(*columns).join(side, ["rec", "wave_no"], "left")
            got, kept = (*got, *(c for c in other.channels if c in channels)), (*kept, *(m for m in other.masks if m in masks))
        return self.add_table(Table(frame, got, kept, any(self.tables[i].sparse for i in wanted))), len(self.tables)

    def values(self, channel: str) -> Column:
        return F.col(_column(channel))

    def ok(self, i: int, mask: str) -> Column:
        """A mask as 0 or 1; all ones where it does not exist."""
        return F.coalesce(F.col(_mask(mask)), F.lit(1)) if mask and mask in self.tables[i].masks else F.lit(1)

    def cycles(self, channel: str) -> DataFrame:
        """rec, wave_no, values of one channel."""
        table = self.tables[self.table_of(channel)]
        return table.frame.select("rec", "wave_no", self.values(channel).alias("values")).filter("values is not null")

    def mask(self, mask: str) -> DataFrame:
        """rec, wave_no, ok of one mask."""
        i = self.mask_table(mask)
        if i is None:
            raise PipelineError(f"no mask {mask!r}")
        return self.tables[i].frame.select("rec", "wave_no", F.col(_mask(mask)).alias("ok")).filter("ok is not null")


def _column(channel: str) -> str:
    """A column name that any channel name may take."""
    return "c_" + "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in channel)


def _mask(mask: str) -> str:
    return "m_" + _column(mask)[2:]
