"""Text functions, piece segmentation, stores and providers, on hand-written cases."""

import json

import pytest
from pyspark.sql import functions as F

from talkloom.functions import text as X
from talkloom.operators import events, providers, stream_text
from talkloom.sources import stores


def one(spark, **columns):
    """The values of column expressions, by name."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_white_space_is_what_python_strips():
    assert set(X.WHITE_SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()} and len(X.WHITE_SPACE) == 29


def test_rounds_and_fallbacks(spark):
    got = one(
        spark,
        round=X.round_dialog(F.lit("　hi\t"), F.lit(None)),
        topic=X.topic_from_round(F.lit("user: 😀" + "x" * 40)),
        unnamed=X.topic_from_round(F.lit(" \n")),
        content=X.last_rounds(F.array(*map(F.lit, "abcd"))),
        short=X.last_rounds(F.array(F.lit("a"))),
        query=X.expand_query(F.lit("q"), F.lit(""), F.lit("r")),
        document=X.record_document(F.lit("t"), F.lit("c"), F.array(F.lit("k1"), F.lit("k2")), F.lit("p"), F.lit("")),
        keywords=X.clean_keywords(F.array(*map(F.lit, [" a", "b ", "", "a"]))),
        broken=X.clean_keywords(F.array(F.lit("a"), F.lit(None).cast("string"))),
        listed=X.keywords_of(F.lit('```json\n{"keywords": [" a", "b"]}\n```')),
        mixed=X.keywords_of(F.lit('{"keywords": ["a", 3]}')),
        absent=X.keywords_of(F.lit("no json")),
        joined=X.ordered_distinct(F.array(*map(F.lit, ["b", "", "a", "b"]))),
    )
    assert got["round"] == "user: hi\nagent: "
    assert got["topic"] == ("user: 😀" + "x" * 40)[:30] and got["unnamed"] == X.UNNAMED_TOPIC
    assert (got["content"], got["short"]) == ("b\nc\nd", "a")
    assert got["query"] == "q r" and got["document"] == "t c k1 k2 p"
    assert got["broken"] == [] and got["listed"] == ["a", "b"] and got["mixed"] == [] and got["absent"] == []
    assert got["keywords"] == ["a", "b"] and got["joined"] == "b | a"


def test_responses(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a":1}',
        'x ``` {"a": 2} ``` y ```json {"a": 3} ```': '{"a":2}',
        '  {"a": 4} ': '{"a":4}',
        "not json": "{}",
        "": "{}",
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string").select("r", F.to_json(X.parse_response(F.col("r"))).alias("j"))
    assert {r["r"]: r["j"] for r in df.collect()} == cases
    assert one(spark, none=X.fenced(F.lit("no fence")), null=F.to_json(X.parse_response(F.lit(None).cast("string")))) == {"none": None, "null": "{}"}


@pytest.mark.parametrize("raw, loose, strict", [("2", 2, 2), ("-3", -3, -3), ("+2", 0, 2), ('"+2"', 2, None), ("2.5", 25, None), ("[1,2]", 12, None), ("", 0, None), ("-", 0, None), ('"-"', None, None), ("1-2", 0, None), ("评分：2", 0, None), ("[1,-2]", None, None), ('{"a-b": 2}', -2, None), (None, 0, None), ("9", 9, None), ("1e3", 10000, None), ("2.50", 25, None), ("1000.0", 10000, None), ('"\\u0032"', 2, None), ('{"score": 3.0}', 30, None), ('[1.50, "2.50"]', 15250, None), ("1.000", 10, None), ("-0.5", -5, None), ("10.05", 1005, None)])
def test_scores(spark, raw, loose, strict):
    assert one(spark, a=X.parse_score(F.lit(raw).cast("string")), b=X.parse_score(F.lit(raw).cast("string"), True)) == {"a": loose, "b": strict}


def test_stages_and_cleaning(spark):
    rows = spark.createDataFrame([(29,), (30,), (79,), (80,)], "t int").select(X.trust_stage(F.col("t")).alias("s"), X.trust_attitude(F.col("t"))["stage"].alias("a")).collect()
    assert [r["a"] for r in rows] == ["Initial", "Process", "Process", "Final"]
    assert [r["s"].split()[0] for r in rows] == ["Initial", "Process", "Process", "Final"]
    got = one(
        spark, said=X.spoken(F.lit(" a（x)b(y）😀c ")), key=X.cache_key(F.lit("t"), F.lit("v")), time=X.short_time(F.lit("2026-01-02T03:04:05.6")),
        html=X.html_escape(F.lit("<a&b>")), low=X.clamp(F.lit(-1)), high=X.clamp(F.lit(101)), command=X.is_command(F.lit(" EXIT\n"), "exit"), idle=X.buffer_status(F.lit("t"), F.lit(0)),
    )
    assert got["said"] == "abc" and len(got["key"]) == 16 and got["time"] == "2026-01-02 03:04"
    assert got["html"] == "&lt;a&amp;b&gt;" and (got["low"], got["high"]) == (0, 100)
    assert got["command"] is True and got["idle"] == "当前无对话内容"


PIECES = [
    (["你好，今天跑步。很累(笑)，明天再说"], ["你好，今天跑步。", "很累，明天再说"]),
    (list("你好，今天跑步。很累(笑)，明天再说"), ["你好，", "今天跑步。", "很累，", "明天再说"]),
    (["a,b。c"], ["a,b。", "c"]),
    (["😀"], []),
    (["😀。", "好。"], ["。", "好。"]),
    (list("甲" * 105), ["甲" * 100, "甲" * 5]),
    (list("一。二。三。" + "四" * 16 + "，五五"), ["一。", "二。", "三。", "四" * 16 + "，", "五五"]),
    (list("一。二。三。" + "四" * 8 + "，" + "五" * 6), ["一。", "二。", "三。", "四" * 8 + "，", "五" * 6]),
    (["一。", "二。", "三。", "四四，" + "五" * 12], ["一。", "二。", "三。", "四四，" + "五" * 12]),
    ([], []),
]


@pytest.mark.parametrize("chunks, pieces", PIECES)
def test_pieces(chunks, pieces):
    assert [s for _, s in stream_text.segments(chunks)] == pieces


def test_pieces_over_a_table(spark):
    rows = [(k, i, c) for k, (chunks, _) in enumerate(PIECES) for i, c in enumerate(chunks)] + [(99, 0, None)]
    got = stream_text.segment_streams(spark.createDataFrame(rows, "stream_id int, chunk_seq int, chunk string")).collect()
    for k, (_, pieces) in enumerate(PIECES):
        assert [r["segment"] for r in sorted((r for r in got if r["stream_id"] == k), key=lambda r: r["segment_id"])] == pieces


def test_release_in_order(spark):
    done = spark.createDataFrame([(1, 1, 7, True), (1, 2, 3, True), (1, 3, 9, False), (1, 4, 8, None)], "stream_id int, segment_id int, done_seq int, ok boolean")
    assert [(r["segment_id"], r["released_after"]) for r in stream_text.release_in_order(done).orderBy("segment_id").collect()] == [(1, 7), (2, 7), (4, 9)]


def test_record_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert stores.read_jsonl(spark, path).count() == 0 and stores.clear(spark, path)
    full = {"topic": "t", "content": "c", "keywords": ["k", "k"], "create_time": "2026-01-02T00:00:00", "update_time": "", "user_prediction": "p", "user_risk": "", "agent_empathy": "", "agent_action": "é"}
    lines = [json.dumps(full, ensure_ascii=False), "", "{broken", "123", '{"topic": null, "other": 1}', '{"topic": "last", "create_time": "2020-01-01T00:00:00"}']
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part-0.txt").write_text("\r\n".join(lines), encoding="utf-8")
    got = stores.read_jsonl(spark, path).orderBy("seq").collect()
    assert [r["topic"] for r in got] == ["t", "", "last"] and got[0]["keywords"] == ["k", "k"] and got[1]["keywords"] == [] and got[0]["agent_action"] == "é"
    assert [r["line"] for r in stores.bad_lines(spark, path).orderBy("seq").collect()] == ["{broken", "123"]
    assert stores.latest(stores.read_jsonl(spark, path)).first()["topic"] == "last"
    assert [r["topic"] for r in stores.newest_first(stores.read_jsonl(spark, path)).collect()] == ["last", "", "t"]
    assert [r["topic"] for r in stores.read_jsonl(spark, str(tmp_path / "store" / "part-0.txt")).orderBy("seq").collect()] == ["t", "", "last"]
    copy = str(tmp_path / "copy")
    stores.append_jsonl(stores.read_jsonl(spark, path), copy, [f.name for f in stores.RECORD.fields])
    assert sorted(r["topic"] for r in stores.read_jsonl(spark, copy).collect()) == ["", "last", "t"]
    assert stores.clear(spark, copy) and stores.read_jsonl(spark, copy).count() == 0


def test_store_keeps_the_order_of_appends(spark, tmp_path):
    path, told = str(tmp_path / "log"), []
    for k in range(4):
        rows = [(f"u{k}", 1, 10 * k + i) for i in range(5)]
        told += [r[2] for r in rows]
        stores.append_jsonl(spark.createDataFrame(rows[::-1], stores.TRUST).repartition(3), path, order=["trust_score"])
        assert stores.last_trust(spark, path) == told[-1]
        log = stores.read_jsonl(spark, path, stores.TRUST)
        assert stores.latest(log).first()["trust_score"] == told[-1]
        assert [r["trust_score"] for r in stores.newest_first(log).collect()] == told[::-1]
    of_each = {r["user_input"]: r["trust_score"] for r in stores.latest(log, "user_input").collect()}
    assert of_each == {f"u{k}": 10 * k + 4 for k in range(4)}
    (tmp_path / "log" / "batch-5").mkdir()
    (tmp_path / "log" / "batch-5" / "part-00000.txt").write_text("broken\n")
    assert stores.last_trust(spark, path) == 0 and stores.bad_lines(spark, path).count() == 1
    stores.append_jsonl(log.limit(1), path, ["trust_score"])
    assert stores.read_jsonl(spark, path, stores.TRUST).count() == 21


@pytest.mark.parametrize("lines, score", [([], 0), (['{"user_input": "a", "change": 1, "trust_score": 31}'], 31), (['{"trust_score": 31}', "broken"], 0)])
def test_trust_log(spark, tmp_path, lines, score):
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    assert stores.last_trust(spark, str(tmp_path / "log.jsonl")) == score
    assert stores.last_trust(spark, str(tmp_path / "none.jsonl")) == 0


def test_documents_and_profiles(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"Meta_Layer": {"a": 1}}')
    (tmp_path / "bad.json").write_text("{")
    assert stores.read_json_document(spark, str(tmp_path / "d.json")).count() == 1
    assert stores.read_json_document(spark, str(tmp_path / "bad.json")).count() == 0
    assert stores.read_json_document(spark, str(tmp_path / "none.json")).count() == 0
    default = spark.createDataFrame([(1, "default"), (2, "default")], "id int, p string")
    own, load = str(tmp_path / "own"), lambda **k: {r["id"]: r["p"] for r in stores.load_profile(spark, str(tmp_path / "own"), default, **k).collect()}
    assert load(save=False) == {1: "default", 2: "default"} and not stores._exists(spark, own)
    stores.save_profile(spark.createDataFrame([(1, "own"), (3, "own")], "id int, p string"), own)
    assert load() == load(save=False) == {1: "own", 2: "default", 3: "own"}
    for k in range(3):  # load, update, save to the same place
        stores.save_profile(stores.load_profile(spark, own, default).withColumn("p", F.concat("p", F.lit(str(k)))), own)
    assert load() == {1: "own012", 2: "default012", 3: "own012"}
    assert stores.load_profile(spark, own, default.limit(0)).count() == 3 and stores.load_profile(spark, str(tmp_path / "fresh"), default).count() == 2
    old, new = '{"Meta_Layer":"m","Cognitive_Layer":{"x":1},"Behavior_Layer":"b"}', '{"Meta_Layer":null,"Behavior_Layer":"B","Zzz":1}'
    row = spark.range(1).select(*stores.layer_merge(F.lit(old), F.lit(new))).first()
    assert tuple(row) == (None, '{"x":1}', "B", None)


def test_frames(spark):
    turns = spark.createDataFrame([(1, "t", ["a\"b", "", "é"])], "turn_id long, thinking string, chunks array<string>")
    got = events.turn_frames(turns).orderBy("seq").collect()
    assert [r["type"] for r in got] == ["thinking", "chunk", "chunk", "done"] and got[1]["frame"] == 'data: {"type":"chunk","content":"a\\"b"}\n\n'
    text = "".join(r["frame"] for r in got) + ": comment\n\ndata: {\"ty"
    parsed = events.parse_frames(spark.createDataFrame([(1, text)], "stream_id long, text string")).orderBy("seq").collect()
    assert [(r["type"], r["content"]) for r in parsed] == [("thinking", "t"), ("chunk", 'a"b'), ("chunk", "é"), ("done", None)]
    assert one(spark, tail=events.unfinished(F.lit(text)))["tail"] == 'data: {"ty'


def test_thinking_and_labels(spark):
    side = F.struct(F.lit("now").alias("present"), F.lit("then").alias("future"))
    got = one(spark, t=events.thinking(side, F.lit(None).cast("struct<present:string,future:string>")), lines=events.labelled([("a", F.lit("<")), ("b", F.lit("")), ("c", F.lit("x"))]))
    assert json.loads(got["t"]) == {"user_profile": {"past": "（见用户画像）", "present": "now", "future": "then"}}
    assert got["lines"] == "a: &lt;\nc: x"


def test_contracts_and_registry(spark):
    df = spark.createDataFrame([("t" * 21, ["a"] * 5, 6), ("t", ["abcdef"], None)], "topic string, keywords array<string>, score int")
    assert [r["violations"] for r in providers.contract_violations(df).collect()] == [["topic_length", "score_range"], ["keyword_count", "keyword_length"]]
    with pytest.raises(ValueError, match="offline"):
        providers.provider("none")
