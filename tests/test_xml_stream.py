"""Feature collections are read as a stream: a task holds one feature, not the collection."""

import io
import tracemalloc

import pytest

from driftplane.sources import features

ONE = '<gml:featureMember><f:Place><f:identity>{0}</f:identity><gml:name>n &amp; {0}</gml:name><gml:Point><gml:pos>1.5 {0}</gml:pos></gml:Point></f:Place></gml:featureMember>\n'
HEAD = '<f:FeatureCollection xmlns:f="urn:features" xmlns:gml="http://www.opengis.net/gml">\n'


def _collection(n):
    return HEAD + "".join(ONE.format(i) for i in range(n)) + "</f:FeatureCollection>"


def test_memory_is_one_feature():
    data = _collection(20_000).encode()
    tracemalloc.start()
    n = sum(1 for _ in features.features_of(io.BytesIO(data)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 2_000_000


def test_batches_give_all_features(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(features, "BATCH", 7)
    (tmp_path / "a.gpml").write_text(_collection(50))
    (tmp_path / "b.gpml").write_text(_collection(0))
    got = features.read_xml(spark, f"{tmp_path}/*.gpml").orderBy("feature_id").collect()
    assert sorted(int(r["feature_id"]) for r in got) == list(range(50))
    assert all(r["name"] == f"n & {r['feature_id']}" and r["rings"][0][0]["lon"] == float(r["feature_id"]) and r["gtype"] == "point" for r in got)
    (tmp_path / "c.gpml").write_text(_collection(3)[:-5])
    assert [r["file"][-6:] for r in features.read_xml_errors(spark, f"{tmp_path}/*.gpml").collect()] == ["c.gpml"]
    with pytest.raises(Exception, match="ParseError|no element found|unclosed"):
        features.read_xml(spark, f"{tmp_path}/c.gpml").collect()
