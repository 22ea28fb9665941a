"""Registry of queries: a Spark function of the panels, and the SQL that must agree with it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from ..sources.fixtures import PANELS, panel, render
from ..sources.store import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Panels:
    """The derived panels and base tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        return panel(self.spark, self.sf_dir, "bars")

    def _stored(self, name: str, build, tables: tuple[str, ...] = ("lineitem",), keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("date",), dealt: bool = False) -> DataFrame:
        return stored(self.spark, self.sf_dir, name, tables, build, keys, order, dealt)

    @cached_property
    def stored_bars(self) -> DataFrame:
        """bars, kept between queries; plans that read them in several branches start here."""
        return self._stored("bars", lambda: self.bars)

    @cached_property
    def stored_series(self) -> DataFrame:
        return self._stored("series", lambda: self.series, keys=())

    @cached_property
    def wide(self) -> DataFrame:
        """The signals of all strategies, as positions, breakouts and trades all start from them."""
        from ..operators.strategies import wide_signals

        return self._stored("signals", lambda: wide_signals(self.stored_bars))

    @cached_property
    def cells(self) -> DataFrame:
        """A row for each bar with its folds and what all variants hold, made from the kept signals when read."""
        from ..operators.accounting import wide_returns
        from ..operators.strategies import breakout_keys, position_keys, variants
        from ..operators.validation import with_folds

        return with_folds(wide_returns(self.wide, variants(position_keys()), variants(breakout_keys())))

    @cached_property
    def returns(self) -> DataFrame:
        """Returns of all variants, with their bar number and folds: rows that stream from the kept signals, never stored or shuffled."""
        from ..operators.accounting import unfolded

        own = ["symbol", "date", "open", "close", "i", "n", "ins", "fold"]
        return unfolded(self.cells, own)

    @cached_property
    def trades(self) -> DataFrame:
        """Trades of all variants, with the bar number and fold of their entry."""
        from ..operators.accounting import wide_trades
        from ..operators.strategies import breakout_keys, position_keys, variants
        from ..operators.validation import with_folds

        def made() -> DataFrame:
            from ..operators.validation import numbered_bars

            rows = with_folds(numbered_bars(self.wide)).drop("i", "n", "ins")
            return wide_trades(rows, variants(position_keys()), variants(breakout_keys()), ["fold"])

        return self._stored("trades", made, order=("strategy", "variant", "entry"))

    @cached_property
    def chosen(self) -> DataFrame:
        """The variant that each fold of the walk-forward takes."""
        from ..operators.validation import chosen_variants, folds

        return self._stored("chosen", lambda: chosen_variants(self.returns, folds(self.stored_bars)), order=("strategy", "fold"))

    @cached_property
    def oos(self) -> DataFrame:
        """Out-of-sample rows of the chosen variants."""
        from ..operators.validation import stitched

        return stitched(self.cells, self.chosen)

    @cached_property
    def smoothed(self) -> DataFrame:
        """What the modules read of bars, with their smoothed columns, each in several branches by symbol."""
        from ..operators.smooth import with_smoothed
        from ..operators.verdict import READ, SMOOTHED

        return self._stored("smoothed", lambda: with_smoothed(self.stored_bars, SMOOTHED, READ), dealt=True)

    @cached_property
    def modules(self) -> DataFrame:
        """Module scores at all sample dates of the back-test."""
        from .backtest import module_rows

        return self._stored("modules", lambda: module_rows(self.smoothed, self.stored_series, self.sectors))

    @cached_property
    def samples(self) -> DataFrame:
        """Verdicts of the back-test with what followed: the one table that hit rates, reports and tuning read."""
        from .backtest import samples_of

        return self._stored("samples", lambda: samples_of(self.modules))

    @cached_property
    def results(self) -> DataFrame:
        """(id, result): what each run stored, as JSON."""
        return panel(self.spark, self.sf_dir, "results")

    @cached_property
    def snapshots(self) -> DataFrame:
        """(id, payload): snapshots as JSON."""
        return panel(self.spark, self.sf_dir, "snapshots")

    @cached_property
    def sectors(self) -> DataFrame:
        return panel(self.spark, self.sf_dir, "sectors")

    @cached_property
    def series(self) -> DataFrame:
        return panel(self.spark, self.sf_dir, "series")

    @cached_property
    def statements(self) -> DataFrame:
        return panel(self.spark, self.sf_dir, "statements")

    @cached_property
    def news(self) -> DataFrame:
        return panel(self.spark, self.sf_dir, "news")

    @cached_property
    def runs(self) -> DataFrame:
        return panel(self.spark, self.sf_dir, "runs")


def with_panels(body: str, more: dict[str, str] | None = None) -> str:
    """DuckDB SQL of `body` behind the panels (and named fragments) that it mentions."""
    body = body.strip()
    known = PANELS | (more or {})
    need: list[str] = []

    def add(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b(FROM|JOIN|,) {name}\b", text):
                if name not in PANELS:
                    add(known[name])
                need.append(name)

    add(body)
    parts = ", ".join(f"{n} AS ({render(known[n], False)})" for n in need)
    if not parts:
        return body
    return f"WITH {parts}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {parts} {body}"


def _doubles(sql: str) -> str:
    """Decimal literals outside quotes as doubles, so that no column comes out as DECIMAL."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if p.startswith("'") else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for p in parts)


def query(sql: str | None = None, more: dict[str, str] | None = None):
    """Register a function of Panels under its name, with the DuckDB SQL of the same rows."""

    def register(f: Callable[[Panels], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Panels(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = _doubles(with_panels(sql, more))
        return f

    return register
