"""Files that hold an array of objects, read by many tasks each.

Spark cuts a file at closing braces as it cuts others at line ends. Whether such a brace ends an object of the
array depends on all that stands before it: strings may hold braces, and objects may hold objects. What a
fragment does to that state is a map that can be put after another one, so one scan over the fragments of a file
tells where objects end, and a second numbers them. Fragments of an object are then put together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.operators.scan import Scan, scanned

_MARKS = re.compile(r'\\.|["{}]', re.DOTALL)


def effect(fragment: str) -> tuple[tuple[bool, int], tuple[bool, int]]:
    """Whether a fragment and the brace behind it end inside a string, and what they add to the depth; begun outside one, and inside."""
    out = []
    for inside in (False, True):
        depth = 0
        for m in _MARKS.finditer(fragment + "}"):
            if m[0] == '"':
                inside = not inside
            elif not inside and m[0] in "{}":
                depth += 1 if m[0] == "{" else -1
        out.append((inside, depth))
    return out[0], out[1]


def _join(p: tuple, q: tuple) -> tuple:
    return tuple((q[s][0], d + q[s][1]) for s, d in p)


STATE = Scan("inside long, depth long", effect, _join, lambda e: (int(e[0][0]), e[0][1]))
ENDS = Scan("ends long", lambda end: (int(end),), lambda p, q: (p[0] + q[0],), lambda e: e)


def json_array_objects(spark: SparkSession, path: str, suffix: str = "*.json") -> DataFrame:
    """(path, object, text): the number, from 0, and the JSON text of each object of each file that holds an array.

    What isn't an object, and what stands after the last whole one, is left out; files that don't begin with an
    array give nothing.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).option("lineSep", "}").text(path)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    parts = raw.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), "value")
    state = scanned(parts, "path", F.col("place"), [F.col("value")], STATE)
    end = (F.col("inside") == 0) & (F.col("depth") == 0)
    counted = scanned(state, "path", F.col("place"), [end], ENDS).withColumn("end", end.cast("int"))
    arrays = counted.groupBy("path").agg(F.min_by("value", "place").alias("v")).filter(F.startswith(F.ltrim("v"), F.lit("["))).select("path")
    whole = counted.join(arrays, "path", "left_semi").groupBy("path", (F.col("ends") - F.col("end")).alias("object"))
    texts = whole.agg(F.max("end").alias("done"), _put_together(F.sort_array(F.collect_list(F.struct("place", "value")))).alias("text")).filter("done = 1")
    return texts.select("path", "object", F.regexp_replace("text", "^[^{]*+", "").alias("text"))


def _put_together(fragments: Column) -> Column:
    return F.concat(F.array_join(F.transform(fragments, lambda x: x["value"]), "}"), F.lit("}"))


def json_arrays(spark: SparkSession, path: str, key: str = "text") -> DataFrame:
    """(path, text): the string ``key`` of each object, stripped; blank texts and broken objects go."""
    item = F.from_json("text", T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    return json_array_objects(spark, path).select("path", F.trim(F.try_element_at(item, F.lit(key))).alias("text")).filter("text <> ''")
