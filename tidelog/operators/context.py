"""Values by place: the nearest enclosing scope that says something wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(places: DataFrame, id_col: str, path_col: str, scopes: DataFrame, scope_col: str, value_col: str) -> DataFrame:
    """(id_col, value_col) of the longest scope that is a prefix of each place.

    Paths end their parts with a slash.  A place is repeated for each of its prefixes, and those join the scopes
    by equality.
    """
    parts = F.split(F.regexp_replace(path_col, "/$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.concat_ws("/", F.slice(parts, F.lit(1), n)), F.lit("/")))
    each = places.select(id_col, F.explode(prefixes).alias("__scope"))
    met = each.join(scopes.select(F.col(scope_col).alias("__scope"), value_col), "__scope")
    return met.groupBy(id_col).agg(F.max_by(value_col, F.length("__scope")).alias(value_col))
