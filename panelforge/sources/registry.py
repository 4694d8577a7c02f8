"""Sources by county: each a function that gives rows, found by its county and united by column name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Readers with their county's description.

    A reader returns rows without ``county``; ``rows`` adds it as a constant, so a filter on ``county``, there or later in a
    query, is decided for each reader before anything runs, and the files of the others are not read.
    """

    readers: dict[str, tuple[Reader, dict[str, str]]] = field(default_factory=dict)

    def source(self, county: str, **about: str) -> Callable[[Reader], Reader]:
        def add(reader: Reader) -> Reader:
            if county in self.readers:
                raise ValueError(f"{county} has a source already")
            self.readers[county] = (reader, about)
            return reader

        return add

    def wanted(self, only: Iterable[str] | None = None) -> list[str]:
        """Counties in order of name; of ``only``, whatever its case, those that have a source. None at all is an error."""
        asked = None if only is None else {c.lower() for c in only}
        found = sorted(c for c in self.readers if asked is None or c.lower() in asked)
        if not found:
            raise ValueError("no source found")
        return found

    def rows(self, spark: SparkSession, path: str, only: Iterable[str] | None = None) -> DataFrame:
        """The rows of all wanted counties; a column that a county does not have is null there."""
        parts = [self.readers[c][0](spark, path).withColumn("county", F.lit(c)) for c in self.wanted(only)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def counties(self, spark: SparkSession, only: Iterable[str] | None = None) -> DataFrame:
        """(county, about): what the wanted counties say of themselves, one row each."""
        return spark.createDataFrame([(c, self.readers[c][1]) for c in self.wanted(only)], "county string, about map<string,string>")
