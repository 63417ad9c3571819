import pytest
from pyspark.sql import functions as F

from heddle.functions.json_schema import schema_faults

SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["id", "tags"], "forbidden": ["difficulty"],
    "properties": {
        "id": {"type": "string", "pattern": "^lst_[a-z]+$"}, "seq": {"type": ["integer", "null"]}, "level": {"type": "number", "minimum": 0, "maximum": 1}, "kind": {"enum": ["a", "b", None]}, "v": {"const": "1"},
        "tags": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 2}}, "ref": {"type": "object", "required": ["key"], "properties": {"key": {"type": "string"}}}, "difficulty": {"type": "number"},
    },
}


@pytest.mark.parametrize(
    ("raw", "faults"),
    [
        ('{"id":"lst_x","tags":["ab"],"seq":null,"level":0.5,"kind":null,"v":"1","ref":{"key":"k"}}', []), ("{bad", ["$: is not JSON"]), ('{"id":"x","tags":["ab"]}', ["$.id: does not match its pattern"]), ('{"tags":["ab"]}', ["$: lacks id"]),
        ('{"id":"lst_x","tags":[]}', ["$.tags: breaks minItems 1"]), ('{"id":"lst_x","tags":["a", 1]}', ["$.tags[0]: breaks minLength 2", "$.tags[1]: is not of type string"]), ('{"id":"lst_x","tags":["ab"],"level":2}', ["$.level: breaks maximum 1"]),
        ('{"id":"lst_x","tags":["ab"],"more":1}', ["$: has the unknown more"]), ('{"id":"lst_x","tags":["ab"],"difficulty":1}', ["$: has the forbidden difficulty"]), ('{"id":"lst_x","tags":["ab"],"ref":{}}', ["$.ref: lacks key"]), ('{"id":null,"tags":["ab"]}', ["$.id: is not of type string"]),
        ('{"id":"lst_x","tags":["ab"],"kind":"c","v":"2"}', ["$.kind: is outside its closed set", "$.v: is not 1"]), ("[]", ["$: is not of type object"]),
    ],
)
def test_faults(spark, raw, faults):
    got = spark.createDataFrame([(raw,)], "raw string").select(schema_faults(F.col("raw"), SCHEMA)).first()[0]
    assert sorted(got) == sorted(faults)


def test_unknown_keywords_fail(spark):
    with pytest.raises(ValueError, match="oneOf"):
        schema_faults(F.lit("{}"), {"oneOf": []})
