"""What the pass over flows carries, and how often what it tells is worked on."""

from pyspark.sql import functions as F

from netglean.operators import flows
from netglean.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def segments(spark):
    return queries._segments(queries._events(spark, SF).select(F.col("e").alias("flow")))


def test_only_what_is_asked_travels(spark):
    """Addresses, ports and times end before the exchange; packets that tell nothing end in the pass."""
    p = plan(flows.http_messages(segments(spark)))
    sent = next(line for line in p.split("\n") if "MapInArrow" in line)
    assert "flow#" in sent and not any(f"{c}#" in sent for c in ("src", "dst", "sport", "dport"))
    every = flows.told(flows._payloads(segments(spark)), True, False, False)
    some = flows.told(flows._payloads(segments(spark)), True, False, False, only=("capture", "packet_no", "side", "bytes"))
    assert some.columns == ["capture", "packet_no", "side", "bytes"] and some.count() < every.count()
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.where("side IS NOT NULL").select(*some.columns).collect()))


def test_messages_are_parsed_once(spark):
    """No condition parses a message that a projection parses again."""
    p = plan(flows.http_observations(flows.http_messages(segments(spark))))
    assert not any("split(" in part for part in p.split("Filter ")[1:] for part in [part.split("+- ")[0].split(":- ")[0]])


def test_plain_values():
    import pyarrow as pa

    for values, kind in (([1, None, 2**53 + 1], pa.int64()), ([None, None], pa.int64()), ([], pa.int32()), ([True, False], pa.bool_()), ([True, None], pa.bool_()), (["a", None], pa.string()), ([b"a", None, b""], pa.binary()), ([2**40, -1], pa.int64())):
        a = pa.array(values, kind)
        assert flows._plain(a) == a.to_pylist() and list(map(type, flows._plain(a))) == list(map(type, a.to_pylist()))
