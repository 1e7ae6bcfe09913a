"""The file audit on repeated paths, empty tables and files that can't be read; sitemaps, selection and spread tables."""

import gzip

from pyspark.sql import functions as F

from signalroom.operators import audit, selection
from signalroom.plans import samples
from signalroom.sources import files, tables

SCHEMA = "path string, length bigint, content binary"


def landed(spark, rows):
    return spark.createDataFrame([(p, len(b or b"") if n is None else n, None if b is None else bytearray(b)) for p, b, n in rows], SCHEMA)


def test_each_file_is_an_item(spark):
    rows = [("a.txt", "x​y".encode(), None), ("a.txt", b"plain", None), (None, b"plain", None), ("b.png", b"", None), ("big.txt", b"x", files.MOST_BYTES + 1), ("c", b"\xff\xd8\xff", None), ("d", None, None)]
    docs = landed(spark, rows).withColumn("findings", F.lit("own")).withColumn("text", F.lit("own"))
    found = sorted(((r.path or "", r.kind, r.suspicious_total, r.skipped) for r in audit.items(docs).collect()))
    assert found == [("", "unknown", 0, False), ("a.txt", "text", 0, False), ("a.txt", "text", 1, False), ("b.png", "unknown", 0, False), ("big.txt", "error", 0, True), ("c", "jpeg", 0, False), ("d", "error", 0, True)]
    code = lambda keep: audit.exit_code(audit.items(landed(spark, [r for r in rows if keep(r)]))).first()[0]
    assert code(lambda r: True) == 3 and code(lambda r: r[0] == "a.txt") == 1 and code(lambda r: r[0] == "b.png") == 0 and code(lambda r: False) == 0
    assert audit.items(landed(spark, [])).count() == 0
    assert '"results":[]' in audit.sarif_documents(audit.items(landed(spark, []))).first().sarif


def test_sarif_documents_are_bounded(spark):
    found = audit.items(landed(spark, [(f"{k}.txt", f"{k}​".encode(), None) for k in range(40)]))
    docs = audit.sarif_documents(found, per_document=10).collect()
    assert len(docs) == 4 and sum(d.sarif.count("ruleId") for d in docs) == 40


def test_sitemaps_of_all_kinds(spark):
    xml = b"<urlset><url><loc> http://a.example/1 </loc></url></urlset>"
    rows = [("z", gzip.compress(xml)), ("p", xml), ("d", b"<!DOCTYPE x><urlset/>"), ("b", b"no"), ("n", None), ("l", xml + b" " * 200), ("g", gzip.compress(b" " * 500 + xml))]
    found = {r.url: (r.kind, r.locations, (r.error or "")[:12]) for r in files.sitemaps(spark.createDataFrame([(u, None if b is None else bytearray(b)) for u, b in rows], "url string, content binary"), 150).collect()}
    good = ("urlset", ["http://a.example/1"], "")
    assert found["z"] == found["p"] == good
    assert found["d"][2] == "sitemap decl" and found["b"][2] == found["n"][2] == "not a sitema" and found["l"][2] == found["g"][2] == "sitemap is o"


def test_fronts_against_peeling(spark):
    rows = [(k, k % 3, float((k * 37) % 23), float((k * 53) % 19)) for k in range(150)]
    found = {r.k: r.front for r in selection.fronts(spark.createDataFrame(rows, "k int, g int, a double, b double"), "g", "a", "b").collect()}
    for g in range(3):
        left, front = [r for r in rows if r[1] == g], 0
        while left:
            best = [r for r in left if not any(o[2] >= r[2] and o[3] >= r[3] and (o[2] > r[2] or o[3] > r[3]) for o in left)]
            assert {found[r[0]] for r in best} == {front}
            left, front = [r for r in left if r not in best], front + 1


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(8).write.parquet(f"{tmp_path}/many")
    assert tables.read(spark, f"{tmp_path}/one").select(F.spark_partition_id()).distinct().count() == 4
    assert "Exchange" not in tables.read(spark, f"{tmp_path}/many")._jdf.queryExecution().toString()
    assert tables.read(spark, f"{tmp_path}/one").count() == 100


def test_samples_are_the_same_each_time():
    assert [b for _, b in samples.SAMPLES if b] and samples.archive(a=b"x") == samples.archive(a=b"x")
