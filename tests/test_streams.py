"""The stream of follow-up questions gives what the batch query gives."""

import json

from tradewind.operators import followups
from tradewind.sources.questions import questions
from tradewind.streaming import turns

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = questions(spark.read.parquet(f"{SF}/conversations.parquet")).select("conv_id", "turn", "role", "question").collect()
    again = {(r.conv_id, r.turn): "Nó dùng để làm gì" if r.turn % 4 == 2 else r.question for r in rows}
    lines = sorted(({"conv_id": c, "turn": t, "role": next(r.role for r in rows if (r.conv_id, r.turn) == (c, t)), "text": x} for (c, t), x in again.items()), key=lambda r: (r["turn"], -r["conv_id"]))
    schema = "conv_id long, turn long, role string, text string"
    want = followups.batch(spark.createDataFrame([tuple(r.values()) for r in lines], schema))
    # Three files, in the order of turns: three batches, with the state kept between them.
    for n in range(3):
        part = [r for r in lines if min(r["turn"] // 2, 2) == n]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in reversed(part)), encoding="utf-8")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = turns.stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert len(query.recentProgress) >= 3
    columns = want.columns
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    assert got.filter("previous is not null").count() > 5 and got.filter("query <> question").count() > 3
