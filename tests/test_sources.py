import gzip
import json

from larkmill.sources import files
from larkmill.sources.tfrecord import TFRecord, decode_example, encode_example, masked_crc


def test_reviews_and_literals(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        for i in range(3):
            f.write(json.dumps({"reviewerID": f"u{i}", "asin": "a", "unixReviewTime": i}) + "\n")
    assert [r["orig_order"] for r in files.reviews(spark, str(tmp_path / "r.json.gz")).orderBy("orig_order").collect()] == [0, 1, 2]
    (tmp_path / "m.txt").write_text("{'asin': 'x', 'categories': [['b', 'a']], 'related': {'also_bought': ['y']}}\n{'asin': 'z', 'title': \"it's\"}\n")
    got = {r["asin"]: r for r in files.literals(spark, str(tmp_path / "m.txt")).collect()}
    assert got["x"]["categories"] == [["b", "a"]] and got["x"]["title"] == "" and got["z"]["title"] == "it's"


def test_ratings_xml_bundles_manifest(spark, tmp_path):
    (tmp_path / "ratings.dat").write_text("1::2::3.5::99\n")
    assert tuple(files.ratings(spark, str(tmp_path / "ratings.dat")).first()) == (1, 2, 3.5, 99)
    (tmp_path / "j.xml").write_text("<jobs><job><id>1</id><nm>x</nm></job><job><id>2</id><nm>y</nm></job></jobs>")
    assert files.xml_rows(spark, str(tmp_path / "j.xml"), "job", "id int, nm string").count() == 2
    (tmp_path / "res.json").write_text(json.dumps({"a": {"recall@10": 0.5, "note": "x"}, "b": {"other": 1}}))
    assert [tuple(r) for r in files.metric_bundles(spark, str(tmp_path / "res.json"), "recall@10").collect()] == [("a", "recall@10", 0.5)]
    assert files.manifest(spark, str(tmp_path)).count() == 3
    assert files.listing(spark, str(tmp_path), ".dat").count() == 1


def test_tsv_skips_bad_lines_and_bom(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('id\tname\n1\t"a\nx\ty\n')
    got = files.delimited(spark, str(tmp_path / "t.tsv"), "id int, name string", "\t", None, strict=False).collect()
    assert [tuple(r) for r in got] == [(1, '"a')]
    files.write_csv_bom(spark.range(2), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbf")


def test_examples_round_trip(spark, tmp_path):
    row = {"id": [7, -3], "text": ["é", ""], "x": [0.5, -1.25]}
    back = decode_example(encode_example(row))
    assert back == {"id": [7, -3], "text": ["é".encode(), b""], "x": [0.5, -1.25]}
    assert masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    spark.dataSource.register(TFRecord)
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", [])], "id bigint, text string, seq array<bigint>")
    df.write.format("tfrecord").mode("append").save(str(tmp_path / "rec"))
    got = spark.read.format("tfrecord").schema(df.schema).load(str(tmp_path / "rec")).orderBy("id").collect()
    assert [(r["id"], r["text"], r["seq"]) for r in got] == [(1, "a", [1, 2]), (2, "b", [])]
