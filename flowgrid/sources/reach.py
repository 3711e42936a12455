"""Areas within reach of stations from a routing service: requests, and answers with a cache.

The service itself is the caller's function; nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requests(stations: DataFrame, minutes: Sequence[int] = (15, 25)) -> DataFrame:
    """(station_id, lat, lon, minutes, cache_key): a row for each station and band."""
    bands = stations.select("station_id", "lat", "lon", F.explode(F.array(*map(F.lit, minutes))).alias("minutes"))
    text = F.format_string("%s|%.6f|%.6f|%d", "station_id", "lat", "lon", "minutes")
    return bands.withColumn("cache_key", F.substring(F.sha1(text.cast("binary")), 1, 12))


def answers(asked: DataFrame, cached: DataFrame | None, call: Callable[[str, float, float, int], str]) -> DataFrame:
    """(cache_key, station_id, minutes, geojson, source, error): cached answers, and fresh ones for the rest.

    A call that fails leaves its error in its row; the other rows go on.
    """
    import pandas as pd

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                try:
                    out.append((call(r.station_id, r.lat, r.lon, int(r.minutes)), "fresh", None))
                except Exception as e:  # noqa: BLE001: a service may fail in any way
                    out.append((None, "failed", str(e)))
            got = pd.DataFrame(out, columns=["geojson", "source", "error"], dtype=object)
            yield pd.concat([b[["cache_key", "station_id", "minutes"]].reset_index(drop=True), got], axis=1)

    schema = "cache_key string, station_id string, minutes int, geojson string, source string, error string"
    if cached is None:
        return asked.mapInPandas(fetch, schema)
    known = cached.select(F.col("cache_key").alias("k"), F.col("geojson"))
    hit = asked.join(known, F.col("cache_key") == F.col("k")).select("cache_key", "station_id", "minutes", "geojson", F.lit("cache").alias("source"), F.lit(None).cast("string").alias("error"))
    rest = asked.join(known, F.col("cache_key") == F.col("k"), "left_anti")
    return hit.unionByName(rest.mapInPandas(fetch, schema))
