"""Column roles of an event log, and the log itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartrail.functions.ordering import Ordered, hot_keys

# Rows of one key that a single task may sort. Above it a key is "hot" and its
# rows are range-sorted over many tasks instead (functions/ordering.py).
DEFAULT_HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class LogSpec:
    """Names the columns and the activity roles that operators rely on."""

    # Default column names and activity names of the log format.
    case: str = "user_session"
    activity: str = "event_type"
    time: str = "event_time"
    user: str = "user_id"
    product: str = "product_id"
    category: str = "category_code"
    brand: str = "brand"
    price: str = "price"
    view: str = "view"
    cart: str = "cart"
    remove: str = "remove_from_cart"
    purchase: str = "purchase"
    category_id: str = "category_id"
    # Equal times inside a case are ordered by these columns.
    ties: tuple[str, ...] = ("event_type", "product_id")

    @property
    def order(self) -> list[str]:
        return [self.time, *self.ties]

    @property
    def sequence_columns(self) -> list[str]:
        """The columns a trace needs, each once."""
        return list(dict.fromkeys([self.case, *self.order, self.activity]))


@dataclass
class EventLog:
    """A DataFrame with its column roles; every operator takes one of these."""

    df: DataFrame
    spec: LogSpec = LogSpec()
    hot_rows: int = DEFAULT_HOT_ROWS
    _hot: dict[str, list] = field(default_factory=dict, repr=False)

    def is_activity(self, name: str) -> Column:
        return F.col(self.spec.activity) == F.lit(name)

    def hot(self, key: str) -> list:
        """Hot values of a column, looked up once per log."""
        if key not in self._hot:
            self._hot[key] = hot_keys(self.df, key, self.hot_rows)
        return self._hot[key]

    def complete(self) -> DataFrame:
        """Rows that can take part in a trace: case, activity and time present."""
        s = self.spec
        return self.df.dropna(subset=[s.case, s.activity, s.time])

    def sequences(self) -> Ordered:
        """Events in case order, reduced to the columns a trace needs."""
        s = self.spec
        return Ordered.of(
            self.complete().select(*s.sequence_columns),
            s.case,
            s.order,
            hot=self.hot(s.case),
            block_rows=self.hot_rows,
        )
