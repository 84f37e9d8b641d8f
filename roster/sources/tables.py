"""``Tables``: the 23 model tables as lazily built DataFrames.

A builder receives the columns the caller needs (``None`` = all), so a source can skip work nobody asked
for; the star-schema adapter uses this to avoid numbering enrollments when the id is not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roster import schema
from roster.plans import broadcast as bc
from roster.plans.partitions import kept_tasks

Builder = Callable[[tuple[str, ...] | None], DataFrame]


class Tables:
    def __init__(self, spark: SparkSession, builders: Mapping[str, Builder],
                 sources: Mapping[str, Callable[[], DataFrame]] | None = None, origin: str | None = None,
                 max_ids: Mapping[str, Callable[[], Column]] | None = None,
                 projection_aware: Iterable[str] = (), marks: Mapping[str, Callable[[], Column]] | None = None,
                 lineage: Mapping[str, Sequence[str]] | None = None,
                 sizes: Mapping[str, Callable[[], int]] | None = None, dealt: Iterable[str] = ()):
        unknown = set(builders) - set(schema.TABLE_NAMES)
        if unknown:
            raise KeyError(f"unknown tables: {sorted(unknown)}")
        self.spark = spark
        self._builders: dict[str, Builder] = dict(builders)
        self._frames: dict[tuple[str, tuple[str, ...] | None], DataFrame] = {}
        self._small: dict[str, bool] = {}
        self._sources = dict(sources or {})
        self.origin = origin   # where the tables were derived from (names the load-once folder)
        # Sources that know a table's largest id without building every id (a row-number id ends at count).
        self._max_ids = dict(max_ids or {})
        # Largest ids that AUTO_INCREMENT tables ever gave out, as far as earlier versions of the tables tell.
        self._marks = dict(marks or {})
        # Input paths a table is derived from, where they are known.
        self.lineage = dict(lineage or {})
        # Builders that do less work for fewer columns get the requested columns; the others are built once
        # per table set and projected, so any checks they run are not repeated.
        self._projection_aware = set(projection_aware)
        # About how many rows a table has (an upper bound where it is derived from a larger one), where that is cheap to know.
        self._sizes = dict(sizes or {})
        # Tables whose rows are already dealt out by their primary key when they are large.
        self.dealt = frozenset(dealt)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> "Tables":
        return cls(spark, {name: (lambda cols, df=df: df) for name, df in frames.items()})

    def names(self) -> list[str]:
        return [n for n in schema.TABLE_NAMES if n in self._builders]

    def __contains__(self, name: str) -> bool:
        return name in self._builders

    def get(self, name: str, *cols: str) -> DataFrame:
        if name not in self._builders:
            raise KeyError(f"table {name!r} is not available")
        key = (name, tuple(cols) if cols else None)
        if key not in self._frames:
            if key[1] is None or name in self._projection_aware:
                df = self._builders[name](key[1])
            else:
                df = self.get(name)
            self._frames[key] = df.select(*cols) if cols else df
        return self._frames[key]

    def __getitem__(self, name: str) -> DataFrame:
        return self.get(name)

    def source(self, name: str) -> DataFrame:
        """A raw input table the model was derived from (star-schema sources), for jobs whose change
        batches come from the inputs."""
        if name not in self._sources:
            raise KeyError(f"no source table {name!r} behind these tables")
        return self._sources[name]()

    def dim(self, name: str, *cols: str, max_rows: int = bc.DEFAULT_MAX_ROWS) -> DataFrame:
        """A dimension to join against: broadcast if its row count is checked to be within ``max_rows``,
        otherwise left to a shuffle join (and AQE). The check runs once per table and is remembered."""
        if name not in self._small:
            self._small[name] = bc.row_bound_holds(self.get(name), max_rows)
        df = self.get(name, *cols)
        return bc.fixed(df) if self._small[name] else df

    def tasks(self, name: str) -> int:
        """Tasks to deal the rows of a table out to; 0 if they can be left to AQE or the size is unknown. A changed
        table counts as the one it was made from."""
        return kept_tasks(self.spark, self._sizes[name]()) if name in self._sizes else 0

    def max_id(self, name: str, id_col: str = "id") -> Column:
        """Largest ``id_col`` of ``name`` (NULL when empty) as a scalar-subquery column."""
        if name in self._max_ids and id_col == "id":
            return self._max_ids[name]()
        return self.get(name, id_col).agg(F.max(id_col)).scalar()

    def high_water(self, name: str, id_col: str = "id") -> Column:
        """Largest id that the table holds or, for AUTO_INCREMENT tables, ever held in this version or one it was made
        from (NULL if none): an id that was given out once is not given out again after its row is deleted."""
        held = self.max_id(name, id_col)
        return F.greatest(held, self._marks[name]()) if name in self._marks and id_col == "id" else held

    def mark(self, name: str) -> Column:
        """The largest id that earlier versions of a table are known to have given out (NULL if none)."""
        return self._marks[name]() if name in self._marks else F.lit(None).cast("bigint")

    def replace(self, **frames: DataFrame) -> "Tables":
        """A new version with some tables replaced (the change jobs return these)."""
        return self.rebuild({name: (lambda cols, df=df: df) for name, df in frames.items()}, projection_aware=False)

    def rebuild(self, builders: Mapping[str, Builder], projection_aware: bool = True) -> "Tables":
        """A new version with some tables built anew, from the columns asked for if ``projection_aware``."""
        for name in builders:
            schema.table(name)
        # A replaced table no longer has the shortcut for its largest id, but its ids stay given out.
        max_ids = {n: f for n, f in self._max_ids.items() if n not in builders}
        marks = self._marks | {n: (lambda n=n: self.high_water(n)) for n in builders if n in schema.AUTO_INCREMENT and n in self}
        aware = self._projection_aware | set(builders) if projection_aware else self._projection_aware - set(builders)
        return Tables(self.spark, {**self._builders, **builders}, self._sources, self.origin, max_ids, aware, marks,
                      sizes=self._sizes, dealt=self.dealt - set(builders))
