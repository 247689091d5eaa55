import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillcount.operators import analyze as an
from quillcount.operators import verify as vf
from quillcount.plans import report
from quillcount.sources import catalog as cat
from quillcount.sources import config as cf
from quillcount.streaming import ingest


def test_config(tmp_path):
    file = tmp_path / cf.DEFAULT_FILE
    file.write_text("models: sonnet, opus  # two\noutput_tokens: 3,1\nsave: false\nmax_duration: 1h30m\n")
    c = cf.load_config(root=str(tmp_path), profile="chat")
    assert c.models == ("sonnet", "opus") and c.output_tokens == (3, 1) and not c.save and c.profile == "chat" and c.limits().duration_ms == 5_400_000
    file.write_text("nothing: 1\n")
    with pytest.raises(ValueError, match="unknown"):
        cf.load_config(root=str(tmp_path))
    with pytest.raises(ValueError):
        cf.Config(max_duration="soon")
    with pytest.raises(FileNotFoundError):
        cf.load_config(str(tmp_path / "none.yaml"))
    assert cf.parse_ints("3,1") == (1, 3)


ENDPOINT = vf.Endpoint("https://count/{model}", "https://up", "https://del/{file}", {"k": "v"})


def test_verification_inline_upload_and_errors():
    calls = []

    def transport(method, url, headers, body):
        calls.append((method, url))
        if url == "https://up":
            return 200, b'{"id": "f1"}'
        return (200, b"") if method == "DELETE" else (200, b'{"input_tokens": 12}')

    request = vf.Assembled("r", "x", "sys", '[{"name": "t"}]', (vf.Part("image", mime="image/png", data=b"12345"), vf.Part("text", "hi")))
    got = vf.verify("anthropic", "m", request, 100, transport, ENDPOINT)
    assert (got["tokens"], got["transport"], got["error"]) == (12, "inline", None) and calls == [("POST", "https://count/m")]
    assert "not allowed" in vf.verify("anthropic", "m", request, 3, transport, ENDPOINT)["error"]
    calls.clear()
    up = vf.Assembled("r", "x", parts=request.parts, allow_file_upload=True)
    assert vf.verify("anthropic", "m", up, 3, transport, ENDPOINT)["cleanup"] == "deleted" and calls[-1] == ("DELETE", "https://del/f1")
    bad = vf.verify("google", "m", vf.Assembled("r", "x"), 0, lambda *a: (429, b'{"error": {"message": "slow"}}'), ENDPOINT)
    assert bad["error"] == "status 429: slow" and vf.verify("openai", "m", up, 0, transport, ENDPOINT)["error"]
    assert vf.verify("google", "m", up, 0, None, ENDPOINT)["error"] == "no transport is configured"


def test_reports(spark):
    df = spark.createDataFrame([("a", "some words"), ("b", "more")], "l string, t string")
    src = an.text_sources(df, F.lit("r"), F.col("l"), F.col("t"))
    r = an.analyze(src, cat.models(spark, cat.default_catalog(), ["sonnet", "gemini"]), an.Options(output_tokens=(1, 2, 3)), with_media=False)
    text = report.text_report(r, "r")
    assert "claude-sonnet-4-6" in text and "uncalibrated" in text and "expected" in text
    board = report.dashboard(r, "r", ["gemini-3.1-pro-preview", "claude-sonnet-4-6"], width=80, color=False)
    assert board.index("gemini") < board.index("sonnet") and board.count("system, tool") == 1
    lines = board.splitlines()
    assert lines[0].startswith("2 sources") and lines[0].endswith("14 B") and all(len(x) <= 80 for x in lines if not x.startswith("!")) and board.count("[#") == 2 and "uncalibrated" in board
    assert "kept if the run is saved" in board and "estimated locally" in lines[-1] and "run r-1" in report.dashboard(r, "r", [], 300, False, "r-1")
    assert report.terminal_width(7) == 44 and report.terminal_width(999) == 120 and "\x1b[1m" in report.dashboard(r, "r", [], 60, True)
    assert len(json.loads(report.to_json(r.models.select("request_id", "model"), ["model"]))) == 2
    assert report.human_bytes(2048) == "2.0 KiB" and report.usd(-1_500_000) == "-1.500000" and report.plural(1, "x") == "1 x" and report.visible_width("\x1b[31mab\x1b[0m") == 2
    assert report.expected_scenario([{"scenario": "scenario-1"}, {"scenario": "scenario-2"}])["scenario"] == "scenario-2"


def test_stream_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = dt.datetime(2026, 1, 1, 10)
    spark.createDataFrame([(at, "hello world"), (at, "func x()"), (at + dt.timedelta(minutes=20), "z")], "ts timestamp, text string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from counts order by start").collect()
    assert [r.n_texts for r in rows] == [2, 1] and rows[0].tokens >= 4
