"""JSON array files read by byte ranges, against a JSON parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gaugeline import operators as op
from gaugeline.sources import read_snapshot
from tests.test_skew import conf


def _write(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def _want(text):
    return [((e or {}).get("id", ""), (e or {}).get("type", ""), (e or {}).get("delta"), (e or {}).get("value"), i)
            for i, e in enumerate(json.loads(text) or [])]


def _got(spark, folder):
    rows = read_snapshot(spark, folder, whole_array=True).orderBy("file", "pos").collect()
    return [(r.id, r.type, r.delta, None if r.value is None else r.value, r.pos) for r in rows]


def _element(rng):
    name = "".join(rng.choice(['a', 'é', '}', '{', '"', '\\', ',', '[', ']', ' ', 'null', '},{', '"}']) for _ in range(rng.randint(0, 9)))
    e = {"id": name, "type": rng.choice(["gauge", "counter", "bogus"])}
    if rng.random() < 0.4:
        e["extra"] = rng.choice([{"a": {"b": "}"}}, [{}, {"x": "{"}], "}" * 40, {}])
    e[rng.choice(["delta", "value"])] = rng.randint(-5, 5)
    return e


@pytest.mark.parametrize("seed,size", [(1, 64), (2, 256), (3, 997), (4, 1 << 20)])
def test_ranges_of_any_size(spark, scratch, seed, size):
    rng = random.Random(seed)
    elements = [None if rng.random() < 0.05 else _element(rng) for _ in range(250)] + [None]
    text = json.dumps(elements, ensure_ascii=False, indent=rng.choice([None, 1]))
    _write(scratch, "one.json", text)
    with conf(spark, {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}):
        assert _got(spark, scratch) == _want(text)


@pytest.mark.parametrize("text", ["null", " null\n", "[]", "[ \n]", "[null]", "[null , null ]", '[{}]', '[{},null]', '[null,{},{}]', ' [ {"id":"a"} ] \n', ""])
def test_small_files(spark, scratch, text):
    _write(scratch, "a.json", text)
    assert _got(spark, scratch) == (_want(text) if text else [])


@pytest.mark.parametrize("text", ["[", "]", "{}", '[{}', '[{},]', '[,{}]', '[{}{}]', '[{}]]', '[1]', '["a"]', '[{"id":1}]', "[null,]", "[{}},{}]", '[{"id":"a}]', "nul", "null null"])
def test_broken_files(spark, scratch, text):
    _write(scratch, "a.json", text)
    with pytest.raises(Exception, match="does not decode"):
        _got(spark, scratch)


def test_many_tasks_read_one_file(spark, scratch):
    n = 60_000
    with open(f"{scratch}/big.json", "w") as f:
        f.write("[" + ",".join(f'{{"id":"m{i % 1000}","type":"counter","delta":{i}}}' for i in range(n)) + "]")
    with conf(spark, {"spark.sql.files.maxPartitionBytes": "100000", "spark.sql.files.openCostInBytes": "1"}):
        rows = read_snapshot(spark, scratch, whole_array=True)
        assert rows.rdd.getNumPartitions() > 15
        assert rows.where("pos = delta").count() == n
        restored = op.restore_merge(spark.createDataFrame([], "type string, id string, delta long, value double"), rows)
        assert restored.count() == 1000 and restored.agg(F.sum("delta")).first()[0] == sum(range(n - 1000, n))
