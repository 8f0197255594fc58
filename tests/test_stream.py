from lexiloom.api import identify, identify_stream, language_mix
from lexiloom.operators.options import IdentifyOptions


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "Hello world", "2024-01-01 00:01:00"), (2, "先生です", "2024-01-01 00:02:00"), (3, "안녕하세요", "2024-01-01 00:20:00")], "doc_id long, text string, at string").selectExpr("doc_id", "text", "cast(at as timestamp) at")
    df.write.parquet(str(tmp_path / "in"))
    plain = IdentifyOptions(segments=False)
    out = identify_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), options=plain).select("doc_id", "status", "primary_language")
    out.writeStream.format("memory").queryName("rows").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("rows").collect()} == {tuple(r) for r in identify(df, options=plain).select("doc_id", "status", "primary_language").collect()}
    mix = language_mix(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "at")
    mix.writeStream.format("memory").queryName("mix").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r["primary_language"], r["n"]) for r in spark.table("mix").collect()} == {("en", 1), ("ja", 1), ("ko", 1)}
