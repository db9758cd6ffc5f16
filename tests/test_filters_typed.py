from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from concord.functions import filters
from concord.operators import diff

SCHEMA = "k long, s string, n double, b boolean, d date, t timestamp, a array<int>, o struct<x:int,y:string>, l array<struct<x:int,y:string>>, m map<string,int>, j string"
ROWS = [
    (1, "5", 5.0, True, date(2024, 1, 1), datetime(2024, 1, 1), [1, 5], (1, "p"), [(1, "p"), (2, "q")], {"z": 1}, '{"v": 5, "w": ["x", 2], "u": null}'),
    (2, "x", 5.5, False, date(2024, 1, 2), datetime(2024, 1, 2, 3), [], (1, None), [], {}, '{"v": "5", "w": {"x": 1}}'),
    (3, None, None, None, None, None, None, None, None, None, None),
]


@pytest.mark.parametrize(
    "query, kept",
    [
        ({"k": "1"}, []), ({"k": {"$in": ["1", 2]}}, [2]), ({"k": {"$nin": ["1", 2]}}, [1, 3]), ({"k": 1.0}, [1]), ({"s": 5}, []), ({"s": {"$gt": 3}}, []), ({"s": {"$not": {"$gt": 3}}}, [1, 2, 3]), ({"n": {"$gte": 5}}, [1, 2]), ({"n": {"$gte": True}}, []),
        ({"b": 1}, []), ({"b": True}, [1]), ({"d": date(2024, 1, 1)}, [1]), ({"d": datetime(2024, 1, 1)}, []), ({"t": {"$lt": datetime(2024, 1, 2)}}, [1]), ({"a": 5}, [1]), ({"a": "5"}, []), ({"a": [1, 5]}, [1]), ({"a": [5, 1]}, []), ({"a": []}, [2]),
        ({"a": {"$gt": 4}}, [1]), ({"a": {"$ne": 5}}, [2, 3]), ({"o": {"x": 1, "y": "p"}}, [1]), ({"o": {"y": "p", "x": 1}}, []), ({"o": {"x": 1, "y": None}}, [2]), ({"o.x": 1}, [1, 2]), ({"o.x": {"$in": ["1", None]}}, [3]), ({"l": {"$elemMatch": {"x": 2, "y": "q"}}}, [1]),
        ({"l": {"$elemMatch": {"x": "2"}}}, []), ({"l": {"$elemMatch": {"nothing": None}}}, [1]), ({"gone": None}, [1, 2, 3]), ({"gone": 1}, []), ({"gone": {"$exists": False}}, [1, 2, 3]), ({"gone.deeper": {"$ne": 3}}, [1, 2, 3]), ({"m.z": 1}, [1]), ({"s": {"$size": 1}}, []),
        ({"v.v": 5}, [1]), ({"v.v": "5"}, [2]), ({"v.v": {"$type": "string"}}, [2]), ({"v.w": 2}, [1]), ({"v.w": "x"}, [1]), ({"v.w": {"x": 1}}, [2]), ({"v.u": {"$exists": True}}, [1]), ({"v.w": {"$regex": "^x"}}, [1]), ({"k": {"$mod": [2, 1]}}, [1, 3]), ({"s": {"$mod": [2, 1]}}, []),
        ({"$or": [{"k": 1}, {"s": "x"}], "n": {"$gt": 5}}, [2]), ({"$nor": [{"gone": 1}, {"k": 3}]}, [1, 2]),
    ],
)
def test_filters_within_types(spark, query, kept):
    frame = spark.createDataFrame(ROWS, SCHEMA).withColumn("v", F.parse_json("j"))
    assert sorted(r.k for r in frame.where(filters.condition(query, frame.schema)).select("k").collect()) == kept


def test_comparisons_filter_by_type(spark):
    frame = spark.createDataFrame([(1, "5"), (2, "6")], "k long, s string")
    assert diff.compare(diff.documents(frame, ["k"], filter={"s": 5}), diff.documents(frame, ["k"], filter={"s": "5"})).count() == 1
