"""The registered queries of the conversation engine and their SQL equivalents.

Every query takes (spark, sf_dir) and runs over its whole tables.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.functions import text as X
from talkloom.operators import events as E
from talkloom.operators import asof, encoder, extract, judge, refresh, retrieve, rounds, stream_text, trust, wavefront
from talkloom.operators.providers import MARKERS, contract_violations, provider
from talkloom.sources import store_source, stores
from talkloom.sources.scratch import shared_dir, written
from talkloom.streaming import stateful
from talkloom.streaming.drain import drained

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds with the offline provider's flags and analyses, segmented."""
    p = provider("offline")
    r = p.analyses(p.flags(rounds.pair_rounds(_table(spark, sf_dir, "conversations"))))
    return rounds.segment(r, F.col("topic_changed"), F.col("is_noise"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a change of trust: the kind of event stands in for a judged score."""
    kinds = {"purchase": 5, "signup": 3, "click": 1, "view": 0}
    change: Column = F.lit(-5)
    for kind, n in kinds.items():
        change = F.when(F.col("event_type") == kind, F.lit(n)).otherwise(change)
    return _table(spark, sf_dir, "events").withColumn("change", change)


_TRIM = f"'{X.WHITE_SPACE}'"
_CHANGE = "CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 WHEN 'click' THEN 1 WHEN 'view' THEN 0 ELSE -5 END"
_ROUNDS = f"""
said AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS reply_role, lead(text) OVER w AS agent_text
  FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), rounds AS (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS round_no, text AS user_text, agent_text,
    'user: ' || trim(coalesce(text, ''), {_TRIM}) || chr(10) || 'agent: ' || trim(coalesce(agent_text, ''), {_TRIM}) AS round_dialog
  FROM said WHERE role = 'user' AND reply_role = 'assistant'
)"""
_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_MARKED = " OR ".join(f"contains(coalesce(user_text, ''), '{m}')" for m in MARKERS)
_SEGMENTED = f"""{_ROUNDS}, termed AS (
  SELECT *, list_distinct({_WORDS.format("concat_ws(' ', user_text, agent_text)")}) AS t FROM rounds
), lagged AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY round_no) AS p FROM termed
), flagged AS (
  SELECT *, p IS NOT NULL AND ({_MARKED} OR len(list_intersect(t, p)) / greatest(least(len(t), len(p)), 1) < 0.3) AS topic_changed,
    length(coalesce(user_text, '')) < 60 AS is_noise,
    trim(substring(coalesce(user_text, ''), 1, 12), {_TRIM}) AS user_prediction,
    CASE WHEN length(coalesce(user_text, '')) > 300 THEN 'long message' ELSE '' END AS user_risk,
    trim(substring(coalesce(agent_text, ''), 1, 8), {_TRIM}) AS agent_empathy,
    CASE WHEN contains(coalesce(agent_text, ''), '?') THEN 'asks' ELSE 'tells' END AS agent_action
  FROM lagged
), marked AS (
  SELECT *, round_no > 1 AND topic_changed AND NOT is_noise AS boundary, round_no > 1 AND topic_changed AND is_noise AS dropped FROM flagged
), segmented AS (
  SELECT *, CAST(sum(CAST(boundary AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY round_no ROWS UNBOUNDED PRECEDING) AS INTEGER) AS topic_no,
    CAST(coalesce(sum(CAST(boundary AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY round_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS analysis_topic
  FROM marked
)"""


def _distinct_sql(value: str, topic: str) -> str:
    return f"""(SELECT conv_id, topic_no, string_agg(v, ' | ' ORDER BY rn) AS v FROM (
      SELECT conv_id, {topic} AS topic_no, {value} AS v, min(round_no) AS rn FROM segmented WHERE {value} <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def _accumulated_sql(topic: str) -> str:
    joins = " ".join(f"LEFT JOIN {_distinct_sql(a, topic)} {a[0]}{i} USING (conv_id, topic_no)" for i, a in enumerate(rounds.ANALYSES))
    cols = ", ".join(f"coalesce({a[0]}{i}.v, '') AS {a}" for i, a in enumerate(rounds.ANALYSES))
    return f"WITH {_SEGMENTED} SELECT conv_id, topic_no, {cols} FROM (SELECT DISTINCT conv_id, {topic} AS topic_no FROM segmented) {joins}"


@query(f"WITH {_ROUNDS} SELECT * FROM rounds")
def rounds_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.pair_rounds(_table(spark, sf_dir, "conversations"))


@query(f"WITH {_SEGMENTED} SELECT conv_id, round_no, boundary, dropped, topic_no, analysis_topic FROM segmented")
def topic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("conv_id", "round_no", "boundary", "dropped", "topic_no", "analysis_topic")


_RECORDS = f"""WITH {_SEGMENTED}, topics AS (
  SELECT conv_id, topic_no, list(round_dialog ORDER BY round_no) AS rs FROM segmented WHERE NOT dropped GROUP BY ALL
), acc AS ({{acc}})
SELECT t.conv_id, t.topic_no, t.topic_no = max(t.topic_no) OVER (PARTITION BY t.conv_id) AS is_open, CAST(len(rs) AS INTEGER) AS n_rounds,
  coalesce(nullif(trim(substring(rs[1], 1, 30), {_TRIM}), ''), '{X.UNNAMED_TOPIC}') AS topic, array_to_string(rs[-3:], chr(10)) AS content,
  {", ".join(f"coalesce(a.{x}, '') AS {x}" for x in rounds.ANALYSES)}
FROM topics t LEFT JOIN acc a USING (conv_id, topic_no)"""


@query(_RECORDS.replace("{acc}", _accumulated_sql("analysis_topic")))
def topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.build_records(_judged(spark, sf_dir))


@query(_accumulated_sql("analysis_topic"))
def analysis_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.accumulate(_judged(spark, sf_dir))


@query(_accumulated_sql("topic_no"))
def analysis_own_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.accumulate(_judged(spark, sf_dir), own_topic=True)


@query(f"WITH {_SEGMENTED} SELECT conv_id, round_no, round_dialog FROM segmented WHERE dropped")
def noise_dropped_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("dropped").select("conv_id", "round_no", "round_dialog")


@query(f"""SELECT conv_id, topic_no, '当前话题：' || topic || chr(10) || '对话轮次：' || n_rounds AS status
FROM ({_RECORDS.replace("{acc}", _accumulated_sql("analysis_topic"))}) WHERE is_open""")
def buffer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open topic of each conversation, as it is shown."""
    m = rounds.build_records(_judged(spark, sf_dir)).where("is_open")
    return m.select("conv_id", "topic_no", X.buffer_status(F.col("topic"), F.col("n_rounds")).alias("status"))


def _last_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").withColumnRenamed("turn", "seq")


@query("SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, max(turn) AS seq FROM conversations GROUP BY 1")
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each conversation, by its order and not by a time."""
    return stores.latest(_last_said(spark, sf_dir), "conv_id").select("conv_id", "role", "text", "seq")


@query("SELECT event_id, replace(substring(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, 16), 'T', ' ') AS shown FROM events ORDER BY event_id DESC")
def record_listing_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stores.newest_first(_table(spark, sf_dir, "events"), "event_id")
    return e.select("event_id", X.short_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("shown"))


@query(f"""WITH terms AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE length(term) >= 4 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rn FROM tf)
SELECT doc_id, array_to_string(list(term ORDER BY rn), ',') AS keywords FROM ranked WHERE rn <= 5 GROUP BY 1""")
def keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = rounds.top_terms(_table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return k.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query(f"""WITH k AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
c AS (SELECT conv_id, turn, trim(x, {_TRIM}) AS x, min(i) AS i FROM k WHERE trim(x, {_TRIM}) <> '' GROUP BY 1, 2, 3)
SELECT conv_id, turn, string_agg(x, ',' ORDER BY i) AS keywords FROM c GROUP BY 1, 2""")
def keywords_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    k = c.select("conv_id", "turn", X.clean_keywords(F.split("text", " ")).alias("k")).where(F.size("k") > 0)
    return k.select("conv_id", "turn", F.array_join("k", ",").alias("keywords"))


_FOLD = "list_reduce(list_prepend(0, list({c} ORDER BY ts, event_id)), lambda a, x: greatest(0, least(100, a + x)))"
_PREFIX = f"""WITH e AS (SELECT *, {_CHANGE} AS change FROM events), p AS (
  SELECT *, list(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cs FROM e), r AS (
  SELECT user_id, event_id, ts, change, CAST(list_reduce(list_prepend(0, cs), lambda a, x: greatest(0, least(100, a + x))) AS INTEGER) AS trust_score FROM p)"""
_STAGE = "CASE WHEN {t} < 30 THEN 'Initial (Suspicion)' WHEN {t} < 80 THEN 'Process (Utilization)' ELSE 'Final (Symbiosis)' END"


@query(f"SELECT user_id, CAST({_FOLD.format(c=_CHANGE)} AS INTEGER) AS trust_score FROM events GROUP BY 1")
def trust_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.final_trust(_scored(spark, sf_dir))


@query(f"{_PREFIX} SELECT user_id, event_id, change, trust_score FROM r")
def trust_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.running_trust(_scored(spark, sf_dir)).select("user_id", "event_id", "change", "trust_score")


@query(f"SELECT user_id, trust_score, {_STAGE.format(t='trust_score')} AS stage FROM (SELECT user_id, CAST({_FOLD.format(c=_CHANGE)} AS INTEGER) AS trust_score FROM events GROUP BY 1)")
def trust_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.final_trust(_scored(spark, sf_dir)).withColumn("stage", X.trust_stage(F.col("trust_score")))


@query(f"""{_PREFIX}, s AS (SELECT user_id, event_id, coalesce(lag(trust_score) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before, trust_score FROM r)
SELECT user_id, event_id, {_STAGE.format(t='before')} AS from_stage, {_STAGE.format(t='trust_score')} AS to_stage FROM s WHERE from_stage <> to_stage""")
def trust_stage_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trust.running_trust(_scored(spark, sf_dir)).select(
        "user_id", "event_id", X.trust_stage(F.col("trust_before")).alias("from_stage"), X.trust_stage(F.col("trust_score")).alias("to_stage")
    )
    return t.where(F.col("from_stage") != F.col("to_stage"))


#: Responses and the scores that they stand for (null: no whole number, and trust stays).
_SCORES = [("2", 2), ("+2", 0), ('"+2"', 2), ("2.5", 25), ("[1,2]", 12), ('{"a-b": 2}', -2), ("-", 0), ("1-2", 0), ("评分：2", 0), ('"-"', None), ('"1-2"', None), ("null", 0), ("true", 0), ("", 0), ("```json\n-3\n```", -3), ("x ```\n4\n```", 4)]


@query("SELECT event_id, CASE event_id % 17 " + " ".join(f"WHEN {k} THEN {'NULL' if n is None else n}" for k, (_, n) in enumerate(_SCORES)) + " ELSE TRY_CAST(regexp_extract(props, '[0-9]+') AS INTEGER) END AS score FROM events")
def trust_score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of responses of all kinds; every seventeenth is an object."""
    k = (F.col("event_id") % 17).cast("int")
    raw = F.when(k == 16, F.col("props")).otherwise(F.element_at(F.array(*[F.lit(x) for x, _ in _SCORES]), F.least(k, F.lit(15)) + 1))
    return _table(spark, sf_dir, "events").select("event_id", X.parse_score(raw).alias("score"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return v.where(F.col("id") % 20 == 0), v


_DENSE = """WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS record_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS sim
  FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, record_id) AS rank FROM s WHERE {where})
SELECT query_id, record_id, CAST(rank AS INTEGER) AS rank, round(sim, 4) AS similarity FROM k WHERE rank <= 5"""


@query(_DENSE.format(where="true"))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.dense_top_k(*_vectors(spark, sf_dir), threshold=None, others_only=True).withColumn("similarity", F.round("similarity", 4))


@query(_DENSE.format(where="sim > 0.3"))
def vector_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.dense_top_k(*_vectors(spark, sf_dir), others_only=True).withColumn("similarity", F.round("similarity", 4))


_LEXICAL = f"""WITH d AS (SELECT doc_id AS id, unnest({_WORDS.format('text')}) AS term FROM documents),
b AS (SELECT id, unnest({_WORDS.format('text')}) AS term FROM ({{queries}})),
dc AS (SELECT id, term, count(*) AS tf FROM d GROUP BY ALL), bc AS (SELECT id, term, count(*) AS tf FROM b GROUP BY ALL),
dn AS (SELECT id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS n FROM dc GROUP BY 1), bn AS (SELECT id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS n FROM bc GROUP BY 1),
dot AS (SELECT bc.id AS query_id, dc.id AS record_id, CAST(sum(bc.tf * dc.tf) AS DOUBLE) AS dot FROM bc JOIN dc USING (term) GROUP BY 1, 2),
s AS (SELECT query_id, record_id, round(dot / (bn.n * dn.n), 6) AS similarity FROM dot JOIN bn ON query_id = bn.id JOIN dn ON record_id = dn.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, record_id) AS rank FROM s WHERE similarity > 0.3)
SELECT query_id, record_id, similarity, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5"""


@query(_LEXICAL.replace("{queries}", "SELECT item_id AS id, text FROM benchmark"))
def lexical_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieve.lexical_top_k(q, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(_LEXICAL.replace("{queries}", "SELECT item_id AS id, concat_ws(' ', text, nullif(substring(text, 1, item_id % 3 * 10), ''), nullif(substring(text, 11, item_id % 2 * 10), '')) AS text FROM benchmark"))
def expanded_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, with queries expanded by a prediction and a risk (here parts of the query itself)."""
    b = _table(spark, sf_dir, "benchmark")
    prediction = F.expr("substring(text, 1, cast(item_id % 3 * 10 as int))")
    risk = F.expr("substring(text, 11, cast(item_id % 2 * 10 as int))")
    q = b.select(F.col("item_id").alias("id"), X.expand_query(F.col("text"), prediction, risk).alias("text"))
    return retrieve.lexical_top_k(q, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("""SELECT conv_id, topic_no, concat_ws(' ', topic, content, '', nullif(user_prediction, ''), nullif(user_risk, '')) AS document
FROM (""" + _RECORDS.replace("{acc}", _accumulated_sql("analysis_topic")) + ")")
def record_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text under which each record is found."""
    m = rounds.build_records(_judged(spark, sf_dir))
    doc = X.record_document(F.col("topic"), F.col("content"), F.array().cast("array<string>"), F.col("user_prediction"), F.col("user_risk"))
    return m.select("conv_id", "topic_no", doc.alias("document"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM s GROUP BY user_id, n""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.idle_sessions(_table(spark, sf_dir, "events"))


@query("""SELECT user_id, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 24 HOURS, false) AS due FROM events""")
def profile_refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.refresh_due(_table(spark, sf_dir, "events")).select("user_id", "event_id", "due")


def _layers_old() -> str:
    return '{"Meta_Layer":"m0","Cognitive_Layer":"c0","Behavior_Layer":"b0","Concrete_Layer":"d0"}'


@query("""WITH n AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, 'm' || k AS "Meta_Layer", CASE WHEN k % 2 = 0 THEN NULL ELSE 'c0' END AS "Cognitive_Layer", 'b0' AS "Behavior_Layer", CASE WHEN k % 3 = 0 THEN 'd' || k ELSE 'd0' END AS "Concrete_Layer" FROM n""")
def layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of four layers, merged with updates built from events: layers present, absent and null."""
    k = F.get_json_object("props", "$.k").cast("long")
    new = F.concat(
        F.lit('{"Meta_Layer":"m'), k.cast("string"), F.lit('"'),
        F.when(k % 2 == 0, ',"Cognitive_Layer":null').otherwise(""),
        F.when(k % 3 == 0, F.concat(F.lit(',"Concrete_Layer":"d'), k.cast("string"), F.lit('"'))).otherwise(""),
        F.lit(',"Other":1}'),
    )
    return _table(spark, sf_dir, "events").select("event_id", *stores.layer_merge(F.lit(_layers_old()), new))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN trim(props) ELSE regexp_extract(CASE event_id % 3 WHEN 0 THEN 'x ```json' || chr(10) || props || chr(10) || '``` y ``` {} ```' ELSE '``` ' || props || '```' END,
  '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) END AS json FROM events""")
def fenced_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 3
    raw = F.when(m == 0, F.concat(F.lit("x ```json\n"), "props", F.lit("\n``` y ``` {} ```"))).when(m == 1, F.concat(F.lit("``` "), "props", F.lit("```"))).otherwise(F.concat(F.lit(" "), "props"))
    return _table(spark, sf_dir, "events").select("event_id", X.json_text(raw).alias("json"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(trim(text, {_TRIM}), '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'), '[（(](?s:.*?)[）)]', '', 'g') AS said FROM documents")
def clean_brackets_astral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", X.spoken(F.col("text")).alias("said"))


@query("SELECT doc_id, substring(sha256(text), 1, 16) AS key, substring(sha256(lang || ':' || text), 1, 16) AS voice_key FROM documents")
def content_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", X.cache_key(t).alias("key"), X.cache_key(t, F.col("lang")).alias("voice_key"))


_FRAMES = """WITH t AS (SELECT conv_id * 1000 + turn AS turn_id, role, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS chunks FROM conversations WHERE role = 'assistant'),
e AS (SELECT turn_id, 0 AS seq, 'thinking' AS type, role AS content FROM t
  UNION ALL SELECT turn_id, unnest(range(1, len(chunks) + 1)), 'chunk', unnest(chunks) FROM t
  UNION ALL SELECT turn_id, len(chunks) + 1, 'done', NULL FROM t)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.col("role").alias("thinking"), F.split("text", "\n").alias("chunks"))


@query(_FRAMES + """SELECT turn_id, CAST(seq AS INTEGER) AS seq, type, 'data: ' || CASE WHEN content IS NULL THEN '{"type":"done"}'
  ELSE '{"type":"' || type || '","content":' || CAST(to_json(content) AS VARCHAR) || '}' END || chr(10) || chr(10) AS frame FROM e""")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.turn_frames(_turns(spark, sf_dir))


@query(_FRAMES + "SELECT turn_id AS stream_id, CAST(seq AS INTEGER) AS seq, type, content FROM e")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames joined to a stream with a tail that isn't complete, and parsed again."""
    f = E.turn_frames(_turns(spark, sf_dir)).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("seq", "frame"))).alias("fs"))
    text = F.concat(F.array_join(F.transform("fs", lambda x: x["frame"]), ""), F.lit('data: {"type":"chu'))
    return E.parse_frames(f.select(F.col("turn_id").alias("stream_id"), text.alias("text")))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@query(f"""WITH {_ROUNDS} SELECT conv_id, string_agg(round_dialog, chr(10) || chr(10) ORDER BY round_no) AS history, string_agg(round_dialog, chr(10) ORDER BY round_no) AS dialogs,
  CASE WHEN count(*) < 3 THEN 'Initial' WHEN count(*) < 8 THEN 'Process' ELSE 'Final' END AS stage FROM rounds GROUP BY 1""")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt carries of a conversation: its rounds joined both ways, and the stage (ten points of trust a round)."""
    r = rounds.pair_rounds(_table(spark, sf_dir, "conversations")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("round_no", "round_dialog"))).alias("rs"))
    ds = F.transform("rs", lambda x: x["round_dialog"])
    return r.select("conv_id", F.array_join(ds, "\n\n").alias("history"), F.array_join(ds, "\n").alias("dialogs"), X.trust_attitude(F.size("rs") * 10)["stage"].alias("stage"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 20 THEN 'topic_length,' ELSE '' END || CASE WHEN length(text) > 30 THEN 'topic_summary_length,' ELSE '' END || CASE WHEN length(text) > 300 THEN 'content_length,' ELSE '' END
  || CASE WHEN len(string_split(text, ' ')) NOT BETWEEN 5 AND 10 THEN 'keyword_count,' ELSE '' END
  || CASE WHEN len(list_filter(string_split(text, ' '), lambda x: length(x) > 5)) > 0 THEN 'keyword_length,' ELSE '' END || CASE WHEN abs(turn - 3) > 5 THEN 'score_range,' ELSE '' END AS violations FROM conversations""")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("topic"), F.col("text").alias("topic_summary"), F.col("text").alias("content"), F.split("text", " ").alias("keywords"), (F.col("turn") - 3).alias("score"))
    v = contract_violations(c)
    return v.select("conv_id", "turn", F.array_join(F.transform("violations", lambda x: F.concat(x, F.lit(","))), "").alias("violations"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND TIMESTAMP '2024-01-15 00:00:00' - ts > INTERVAL 24 HOURS")
def stale_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that are over a day old; events stand in for a folder's files."""
    name = F.concat(F.when(F.col("event_type") == "view", "recording_").otherwise("other_"), F.col("event_id").cast("string"), F.lit(".wav"))
    files = _table(spark, sf_dir, "events").select("event_id", name.alias("name"), F.col("ts").alias("modified"))
    return E.stale(files, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


def _cut_sql() -> str:
    """The rules of cutting, restated as SQL: one chunk a step, the pending text and the counts as state."""
    marks = lambda m: "[" + m.replace(".", "\\.") + "]"
    first = lambda m: f"length(regexp_extract(p, '^[^{m}]*{marks(m)}'))"
    last = lambda m: f"length(regexp_extract(p, '(?s)^.*{marks(m)}'))"
    pause = last(stream_text.PAUSE_MARKS)
    at = f"""CASE WHEN trim(p, {_TRIM}) = '' THEN 0 WHEN {first(stream_text.END_MARKS)} > 0 THEN {first(stream_text.END_MARKS)}
      WHEN cuts < {stream_text.EARLY} AND {first(stream_text.FIRST_MARKS)} > 0 THEN {first(stream_text.FIRST_MARKS)}
      WHEN length(p) >= {stream_text.TARGET} AND {pause} > 0 AND length(p) - {pause} < {stream_text.TAIL} THEN {pause}
      WHEN length(p) >= {stream_text.LONGEST} THEN CASE WHEN {last(stream_text.LAST_RESORT_MARKS)} > 0 THEN {last(stream_text.LAST_RESORT_MARKS)} ELSE {stream_text.LONGEST} END ELSE 0 END"""
    said = "regexp_replace(regexp_replace(trim({}, " + _TRIM + "), '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'), '[（(](?s:.*?)[）)]', '', 'g')"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations WHERE role = 'assistant'),
s(conv_id, turn, ws, k, rest, cuts, number, piece) AS (
  SELECT conv_id, turn, ws, 0, '', 0, 0, '' FROM c
  UNION ALL
  SELECT conv_id, turn, ws, k + 1, CASE WHEN k = len(ws) THEN '' WHEN cut > 0 THEN trim(substring(p, cut + 1), {_TRIM}) ELSE p END,
    cuts + CASE WHEN cut > 0 THEN 1 ELSE 0 END, number + CASE WHEN cut > 0 AND {said.format("left(p, cut)")} <> '' THEN 1 ELSE 0 END, CASE WHEN cut > 0 THEN {said.format("left(p, cut)")} ELSE '' END
  FROM (SELECT *, CASE WHEN k = len(ws) THEN CASE WHEN trim(p, {_TRIM}) = '' THEN 0 ELSE length(p) END ELSE {at} END AS cut
    FROM (SELECT *, CASE WHEN k = len(ws) THEN rest ELSE rest || ws[k + 1] || CASE WHEN k + 1 < len(ws) THEN ' ' ELSE '' END END AS p FROM s WHERE k <= len(ws)))
) SELECT conv_id, turn, CAST(number AS INTEGER) AS segment_id, piece AS segment FROM s WHERE piece <> ''"""


@query(_cut_sql())
def sentence_stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies streamed word by word and cut into speakable pieces."""
    replies = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return stream_text.segment_rows(replies.select("conv_id", "turn", F.split("text", "(?<= )").alias("chunks")))


@query("""SELECT count(*) AS n_records, count(DISTINCT conv_id) AS n_conversations, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n_user_turns FROM conversations""")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.agg(F.count("*").alias("n_records"), F.countDistinct("conv_id").alias("n_conversations"), F.count_if(F.col("role") == "user").alias("n_user_turns"))


@query(f"SELECT conv_id, turn, trim(text, {_TRIM}) AS message, lower(trim(text, {_TRIM})) IN ('exit', 'show buffer') AS is_command FROM conversations WHERE role = 'user' AND trim(text, {_TRIM}) <> ''")
def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming messages, stripped; blank ones are turned away."""
    c = _table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("message", X.strip(F.col("text"))).where(F.col("message") != "")
    return c.select("conv_id", "turn", "message", X.is_command(F.col("message"), "exit", "show buffer").alias("is_command"))


@query("""WITH c AS (SELECT conv_id, turn, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS chunk, generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) AS i FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, string_agg(chunk, '' ORDER BY i) AS reply FROM c GROUP BY 1, 2""")
def reply_from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies put together from the chunks in which they came; empty chunks are left out."""
    c = _table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "chunk")).where(F.col("chunk") != "")
    g = c.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("i", "chunk"))).alias("cs"))
    return g.select("conv_id", "turn", F.array_join(F.transform("cs", lambda x: x["chunk"]), "").alias("reply"))


@query("""WITH f AS (SELECT user_id AS stream_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS segment_id, event_id AS done_seq, event_type <> 'error' AS ok FROM events),
r AS (SELECT *, max(done_seq) OVER (PARTITION BY stream_id ORDER BY segment_id ROWS UNBOUNDED PRECEDING) AS released_after FROM f)
SELECT stream_id, segment_id, done_seq, released_after FROM r WHERE ok""")
def segments_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions that come in any order, released by segment; failed ones hold nothing up."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    done = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), F.row_number().over(order).alias("segment_id"), F.col("event_id").alias("done_seq"), (F.col("event_type") != "error").alias("ok")
    )
    return stream_text.release_in_order(done).drop("ok")


@query("""SELECT event_id, event_id % 5 IN (0, 3) AS topic_changed, event_id % 5 = 3 AS is_noise, event_id % 5 NOT IN (1, 3) AS is_worthy FROM events""")
def judgement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of responses that are plain, false, no JSON, fenced, or quoted (which is no boolean)."""
    from talkloom.operators.profiles import flag

    forms = ['{"topic_changed": true, "confidence": 0.9}', '{"topic_changed": false, "is_worthy": false}', "cannot say", '```json\n{"topic_changed": true, "is_noise": true, "is_worthy": false}\n```', '{"topic_changed": "true", "is_noise": "true", "is_worthy": "false"}']
    raw = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % 5 + 1).cast("int"))
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", flag(raw, "topic_boundary", "topic_changed").alias("topic_changed"), flag(raw, "noise", "is_noise").alias("is_noise"), flag(raw, "worthiness", "is_worthy").alias("is_worthy"))


@query(f"""SELECT conv_id AS id, 'm0' AS "Meta_Layer", 'c0' AS "Cognitive_Layer", CAST(count(*) AS VARCHAR) AS "Behavior_Layer", arg_max(topic, topic_no) AS "Concrete_Layer"
FROM ({_RECORDS.replace("{acc}", _accumulated_sql("analysis_topic"))}) GROUP BY 1""")
def profile_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of conversations, updated from their records: here by their number and the last topic."""
    from talkloom.operators.profiles import update_profiles

    m = rounds.build_records(_judged(spark, sf_dir)).select(F.col("conv_id").alias("id"), F.col("topic_no").alias("seq"), "topic")
    profiles = m.select("id").distinct().withColumn("document", F.lit(_layers_old()))
    judge = lambda ms: F.to_json(F.struct(F.size(ms).cast("string").alias("Behavior_Layer"), F.element_at(ms, -1)["topic"].alias("Concrete_Layer")))
    return update_profiles(profiles, m, judge)


def _script(kind: str, inputs: Column) -> Column:
    """A model for the queries below: plain, fenced, broken and failing responses, by conversation."""
    told = {
        "topic_init": '{"topic": " opening "}',
        "topic_summary": '{"topic": " summary "}',
        "content_summary": '{"content": "in short"}',
        "keywords": '{"keywords": [" a", "", "b", "a"]}',
        "user_activation": '{"Meta_Layer": "M", "Cognitive_Layer": null, "Other": 1}',
        "own_activation": '{"Behavior_Layer": "B"}',
        "user_update": '{"Meta_Layer": "U"}',
        "own_update": '{"Concrete_Layer": "O"}',
        "user_analysis": '{"present": {"emotion": "calm"}, "future": {"prediction": "more", "risk": 5}}',
        "persona_analysis": '{"present": {"empathy": "warm"}, "future": {"action": "ask"}}',
        "score": '{"score": 3}',
        "reply": "well then\nso be it",
    }[kind]
    n = F.col("conv_id") % 4
    return F.when(n == 0, F.lit(told)).when(n == 1, F.lit(f"so: ```json\n{told}\n```")).when(n == 2, F.lit("cannot say" if kind != "keywords" else '{"keywords": ["a", 3]}'))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.build_records(_judged(spark, sf_dir), model=judge.Model(_script))


@query(f"""SELECT conv_id, topic_no, CASE WHEN conv_id % 4 < 2 THEN 'summary' ELSE topic END AS topic, CASE WHEN conv_id % 4 < 2 THEN 'in short' ELSE content END AS content,
  CASE WHEN conv_id % 4 < 2 THEN 'a,b' ELSE '' END AS keywords FROM ({_RECORDS.replace("{acc}", _accumulated_sql("analysis_topic"))})""")
def model_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, content and keywords from a model's responses, or their defaults."""
    return _seen(spark, sf_dir).select("conv_id", "topic_no", "topic", "content", F.array_join("keywords", ",").alias("keywords"))


def _script_by_history(kind: str, inputs: Column) -> Column:
    """A model whose judgement of a round depends on the open topic: its rounds so far, and its name."""
    of = lambda name: F.get_json_object(inputs, f"$.{name}")
    told = {
        "topic_boundary": lambda: (F.length(of("history")) + F.length(of("dialog")) > 900).alias("topic_changed"),
        "noise": lambda: ((F.length(of("dialog")) + F.length(of("topic"))) % 3 == 0).alias("is_noise"),
        "topic_init": lambda: F.substring(of("dialog"), F.lit(7), F.length(of("dialog")) % 10 + 3).alias("topic"),
    }
    return F.to_json(F.struct(told[kind]()))


_FIRST_NAME = f"coalesce(nullif(trim(substring({{d}}, 7, CAST(length({{d}}) % 10 + 3 AS INTEGER)), {_TRIM}), ''), '')"


@query(f"""WITH RECURSIVE {_ROUNDS}, run(conv_id, round_no, history, topic, topic_no, analysis_topic, boundary, dropped) AS (
  SELECT conv_id, round_no, round_dialog, {_FIRST_NAME.format(d="round_dialog")}, 0, 0, false, false FROM rounds WHERE round_no = 1
  UNION ALL
  SELECT conv_id, round_no, CASE WHEN changed AND noise THEN history WHEN changed THEN d ELSE history || chr(10) || chr(10) || d END,
    CASE WHEN changed AND NOT noise THEN {_FIRST_NAME.format(d="d")} ELSE topic END, topic_no + CASE WHEN changed AND NOT noise THEN 1 ELSE 0 END, topic_no, changed AND NOT noise, changed AND noise
  FROM (SELECT r.conv_id, r.round_no, r.round_dialog AS d, history, topic, topic_no, length(history) + length(r.round_dialog) > 900 AS changed, (length(r.round_dialog) + length(topic)) % 3 = 0 AS noise
    FROM run JOIN rounds r ON r.conv_id = run.conv_id AND r.round_no = run.round_no + 1)
) SELECT conv_id, round_no, boundary, dropped, topic_no, analysis_topic, topic AS open_topic FROM run""")
def model_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by a model that sees each open topic as its own judgements have left it."""
    r = rounds.pair_rounds(_table(spark, sf_dir, "conversations"))
    told = wavefront.segment_with(r, judge.Model(_script_by_history))
    return told.select("conv_id", "round_no", "boundary", "dropped", "topic_no", "analysis_topic", "open_topic")


@query(f"""WITH {_ROUNDS}, t AS (SELECT *, conv_id % 4 AS n, conv_id % 4 < 2 AS told, CAST(10 * round_no % 101 AS INTEGER) AS trust FROM rounds)
SELECT conv_id, round_no, CASE WHEN told THEN 'M' ELSE 'm0' END AS user_meta, CASE WHEN told THEN NULL ELSE 'c0' END AS user_cognitive, 'b0' AS user_behavior,
  CASE WHEN told THEN NULL ELSE 'm0' END AS own_meta, CASE WHEN told THEN 'B' ELSE 'b0' END AS own_behavior, CASE WHEN told THEN 'calm' ELSE '' END AS emotion, CASE WHEN told THEN 'more' ELSE '' END AS prediction,
  CASE WHEN told THEN 'ask' ELSE '' END AS action, CASE n WHEN 0 THEN 'well |then' || chr(10) || '|so |be |it' WHEN 1 THEN 'so: |```json' || chr(10) || '|well |then' || chr(10) || '|so |be |it' || chr(10) || '|```' WHEN 2 THEN 'cannot |say' ELSE '{judge.APOLOGY}' END AS reply,
  CASE WHEN trust < 30 THEN 'Initial (Suspicion)' WHEN trust < 80 THEN 'Process (Utilization)' ELSE 'Final (Symbiosis)' END AS stage,
  CASE WHEN told THEN 3 ELSE 0 END AS change, least(100, trust + CASE WHEN told THEN 3 ELSE 0 END) AS trust_after FROM t""")
def turn_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns: both profiles activated, both sides analysed, the reply, and trust scored after it."""
    r = rounds.pair_rounds(_table(spark, sf_dir, "conversations"))
    turns = r.select("conv_id", "round_no", F.col("user_text").alias("message"), F.lit(_layers_old()).alias("user"), F.lit(_layers_old()).alias("own"), F.lit("[]").alias("records"), (10 * F.col("round_no") % 101).alias("trust"))
    j = judge.judge_turns(turns, judge.Model(_script))
    of = lambda doc, key, name: F.get_json_object(doc, f"$.{key}").alias(name)
    return j.select(
        "conv_id", "round_no", of("user_active", "Meta_Layer", "user_meta"), of("user_active", "Cognitive_Layer", "user_cognitive"), of("user_active", "Behavior_Layer", "user_behavior"),
        of("own_active", "Meta_Layer", "own_meta"), of("own_active", "Behavior_Layer", "own_behavior"), F.col("profile.present.emotion").alias("emotion"), F.col("profile.future.prediction").alias("prediction"),
        F.col("persona.future.action").alias("action"), F.array_join("chunks", "|").alias("reply"), "stage", "change", "trust_after",
    )


@query(f"""SELECT conv_id, CASE WHEN conv_id % 4 < 2 THEN 'U' ELSE 'm0' END AS user_meta, CASE WHEN conv_id % 4 < 2 THEN 'O' ELSE 'd0' END AS own_concrete
FROM ({_RECORDS.replace("{acc}", _accumulated_sql("analysis_topic"))}) GROUP BY 1""")
def model_profile_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both profiles after an update from all records, the agent's after the user's."""
    m = rounds.build_records(_judged(spark, sf_dir)).select(F.col("conv_id").alias("id"), F.col("topic_no").alias("seq"), "topic")
    m = written(m, "records")  # used four times below: else each use makes the records anew, all in one plan
    profiles = m.select("id").distinct().select("id", F.lit(_layers_old()).alias("user"), F.lit(_layers_old()).alias("own"))
    model = judge.Model(_script_by_id)
    u = judge.update_profiles(profiles, m, model)
    return u.select(F.col("id").alias("conv_id"), F.get_json_object("user", "$.Meta_Layer").alias("user_meta"), F.get_json_object("own", "$.Concrete_Layer").alias("own_concrete"))


def _script_by_id(kind: str, inputs: Column) -> Column:
    told = {"user_update": '{"Meta_Layer": "U"}', "own_update": '{"Concrete_Layer": "O"}'}[kind]
    seen = F.lit(True) if kind == "user_update" else F.get_json_object(F.get_json_object(inputs, "$.user"), "$.Meta_Layer") == "U"
    return F.when((F.col("id") % 4 < 2) & seen, F.lit(told)).otherwise("cannot say")


@query("""SELECT conv_id, arg_max(text, turn) AS last_text, count(*) AS n FROM conversations GROUP BY 1""")
def appended_store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each conversation in a store to which its turns were appended in three parts."""
    path = f"{shared_dir(spark)}/talkloom-store-{uuid.uuid4().hex}"
    c = _table(spark, sf_dir, "conversations")
    for part in (c.where("turn < 2"), c.where("turn between 2 and 4"), c.where("turn > 4")):
        stores.append_jsonl(part.select("conv_id", "turn", "text"), path, order=["turn", "conv_id"])
    log = stores.read_jsonl(spark, path, T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("text", T.StringType())]))
    return log.groupBy("conv_id").agg(F.max_by("text", "seq").alias("last_text"), F.count("*").alias("n"))


#: Rounds of a conversation are as many minutes after the one before as the user's text has characters, modulo 50.
_PAUSE = "length(coalesce(user_text, '')) % 50"
_IDLE_RECORDS = (
    _RECORDS.replace("{acc}", _accumulated_sql("analysis_topic"))
    .replace("SELECT *, round_no > 1 AND topic_changed AND NOT is_noise AS boundary, round_no > 1 AND topic_changed AND is_noise AS dropped FROM flagged",
             f"SELECT *, fresh OR round_no > 1 AND topic_changed AND NOT is_noise AS boundary, NOT fresh AND round_no > 1 AND topic_changed AND is_noise AS dropped FROM (SELECT *, round_no > 1 AND {_PAUSE} > 30 AS fresh FROM flagged)")
    .replace("CAST(coalesce(sum(CAST(boundary AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY round_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS analysis_topic",
             "CAST(coalesce(sum(CAST(boundary AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY round_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN fresh THEN 1 ELSE 0 END AS INTEGER) AS analysis_topic")
)


@query(f"SELECT conv_id, topic_no, n_rounds, topic, content, {', '.join(rounds.ANALYSES)} FROM ({_IDLE_RECORDS})")
def stream_idle_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of a stream of rounds, closed by the next one or by more than 30 minutes of silence, the last ones by a timer; over two restarts."""
    from pyspark.sql import Window

    p = provider("offline")
    r = p.analyses(p.flags(rounds.pair_rounds(_table(spark, sf_dir, "conversations"))))
    pause = F.length(X.text_or_empty(F.col("user_text"))) % 50
    minutes = F.sum(pause).over(Window.partitionBy("conv_id").orderBy("round_no"))
    columns = ["conv_id", "round_no", "round_dialog", "topic_changed", "is_noise", *rounds.ANALYSES]
    r = written(r.select(*columns, F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + 60 * minutes).alias("ts")), "timed")
    end = F.lit("2030-01-01 00:00:00").cast("timestamp")
    last = r.limit(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(1).alias("round_no"), *columns[2:], end.alias("ts"))
    got = drained([r, last], lambda s: stateful.closed_topics(s.withWatermark("ts", "1 minute"), idle="30 minutes"), "idle", partitions=8)
    return got.where("conv_id >= 0")


def _state_partitions(rows: DataFrame) -> int:
    """Of a stream's state: one for so many rows, eight at least and no more than a shuffle has."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(most, rows.count() // 200_000))


@query(ORACLE_SQL["segments_in_order"])
def stream_segments_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, in which completions arrive in no order."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    done = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), F.row_number().over(order).alias("segment_id"), F.col("event_id").alias("done_seq"), (F.col("event_type") != "error").alias("ok")
    )
    done = written(done.repartition("done_seq").sortWithinPartitions(F.xxhash64("done_seq")), "done")
    half = F.xxhash64("done_seq") % 2 == 0
    got = drained([done.where(half), done.where(~half)], lambda s: stateful.in_order(s, "stream_id", "segment_id", highest="done_seq"), "order", partitions=_state_partitions(done))
    return got.where("ok").select("stream_id", "segment_id", "done_seq", "released_after")


@query(ORACLE_SQL["sse_parse"])
def stream_sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event streams that arrive as reads of 7 to 70 bytes, cut in frames and characters and out of order, parsed as they come."""
    f = E.turn_frames(_turns(spark, sf_dir)).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("seq", "frame"))).alias("fs"))
    text = F.concat(F.array_join(F.transform("fs", lambda x: x["frame"]), ""), F.lit('data: {"type":"chu'))
    raw = f.select(F.col("turn_id").alias("stream_id"), F.encode(text, "utf-8").alias("raw"), (7 + F.col("turn_id") % 64).cast("int").alias("size"))
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / F.col("size")).cast("int"))
    reads = raw.select("stream_id", "raw", "size", F.explode(starts).alias("n")).select("stream_id", F.col("n").cast("long").alias("read_seq"), F.substring("raw", F.col("n") * F.col("size") + 1, F.col("size")).alias("data"))
    reads = written(reads.repartition("read_seq", "stream_id"), "reads")
    half = F.xxhash64("read_seq") % 2 == 0
    return drained([reads.where(half), reads.where(~half)], stateful.frames, "frames", partitions=_state_partitions(reads))


@query("SELECT conv_id, turn, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS seq, trim(text, ' ') AS text FROM conversations WHERE role = 'user'")
def store_source_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended to a store in two writes, streamed from it to another, and read there: each once, with its number."""
    store_source.register(spark)
    at = f"{shared_dir(spark)}/talkloom-records-{uuid.uuid4().hex}"
    said = _table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.btrim("text", F.lit(" ")).alias("text"))
    middle = said.agg(F.percentile_approx("conv_id", 0.5)).first()[0] or 0
    for part in (said.where(F.col("conv_id") <= middle), said.where(F.col("conv_id") > middle)):
        store_source.as_lines(part.orderBy("conv_id", "turn")).write.format("records").mode("append").save(f"{at}/a")
        stream = spark.readStream.format("records").load(f"{at}/a").select("line")
        q = stream.writeStream.format("records").option("txn", "copy").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/b")
        q.awaitTermination()
    fields = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("text", T.StringType())])
    return store_source.from_lines(spark.read.format("records").load(f"{at}/b"), fields)


@query(f"""{_PREFIX}, last AS (SELECT user_id, ts, arg_max(trust_score, event_id) AS trust_score FROM (SELECT r.user_id, e.ts, r.event_id, r.trust_score FROM r JOIN events e USING (event_id)) GROUP BY ALL),
t AS (SELECT conv_id, turn, conv_id % 60 AS user_id, TIMESTAMP '2024-01-01' + to_minutes(CAST((conv_id * 7919 + turn * 613) % 43200 AS INTEGER)) AS ts FROM conversations WHERE role = 'user')
SELECT t.conv_id, t.turn, coalesce(trust_score, 0) AS trust, {_STAGE.format(t='coalesce(trust_score, 0)')} AS stage FROM t ASOF LEFT JOIN last ON t.user_id = last.user_id AND t.ts > last.ts""")
def trust_as_of_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trust and stage that each user turn finds: those after the user's last event before it."""
    minutes = (F.col("conv_id") * 7919 + F.col("turn") * 613) % 43200
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    turns = _table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", (F.col("conv_id") % 60).alias("user_id"), ts.alias("ts"))
    scores = trust.running_trust(_scored(spark, sf_dir)).select("user_id", "ts", "event_id", F.col("trust_score").alias("trust"))
    told = asof.asof_join(turns, scores, ["user_id"], "ts", ["trust"], tie=["event_id"])
    found = F.coalesce("trust", F.lit(0))
    return told.select("conv_id", "turn", found.alias("trust"), X.trust_stage(found).alias("stage"))


def _counting_script(kind: str, inputs: Column) -> Column:
    """Tells how many records it was given; the agent's part tells what it sees of the user's."""
    n = F.coalesce(F.size(F.from_json(F.get_json_object(inputs, "$.records"), "array<struct<seq: int>>")), F.lit(0))
    if kind == "user_update":
        return F.to_json(F.struct(n.cast("string").alias("Meta_Layer")))
    return F.to_json(F.struct(F.get_json_object(F.get_json_object(inputs, "$.user"), "$.Meta_Layer").alias("Concrete_Layer")))


@query(f"""SELECT conv_id AS id, CAST(max(topic_no) AS BIGINT) AS seen, CAST(count(*) AS VARCHAR) AS user_meta, CAST(count(*) AS VARCHAR) AS own_concrete,
  CASE WHEN count(*) > 1 THEN 50 ELSE 25 END AS refreshed_hour
FROM ({_RECORDS.replace("{acc}", _accumulated_sql("analysis_topic"))}) GROUP BY 1""")
def profiles_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles entered, refreshed a day later from the records there are, left alone while they aren't due, and refreshed again where records have come."""
    path = f"{shared_dir(spark)}/talkloom-profiles-{uuid.uuid4().hex}"
    m = written(rounds.build_records(_judged(spark, sf_dir)).select(F.col("conv_id").alias("id"), F.col("topic_no").alias("seq"), "topic"), "records")
    profiles = m.select("id").distinct().select("id", F.lit(_layers_old()).alias("user"), F.lit(_layers_old()).alias("own"))
    model, start = judge.Model(_counting_script), datetime(2024, 1, 1)
    for hour, there in ((0, m), (25, m.where("seq = 0")), (26, m), (50, m), (80, m)):
        out = refresh.refresh(path, profiles, there, model, start + timedelta(hours=hour))
    of = lambda doc, key, name: F.get_json_object(doc, f"$.{key}").alias(name)
    hours = F.timestamp_diff("HOUR", F.lit(start).cast("timestamp"), F.col("refreshed")).cast("int")
    return out.select("id", "seen", of("user", "Meta_Layer", "user_meta"), of("own", "Concrete_Layer", "own_concrete"), hours.alias("refreshed_hour"))


def _ranked_sql(steps: int, damping: float) -> str:
    """The walk over sentences, a pair of tables for each step."""
    each, key = "conv_id, topic_no, round_no, pos", "conv_id, topic_no"
    out = f"""{_SEGMENTED}, pieces AS (
  SELECT conv_id, topic_no, round_no, unnest(ls) AS s, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS pos FROM (
    SELECT conv_id, topic_no, round_no, regexp_split_to_array(concat_ws(chr(10), user_text, agent_text), '[.!?。！？\\n]+') AS ls FROM segmented WHERE NOT dropped)
), phrases AS MATERIALIZED (SELECT {each}, trim(s, {_TRIM}) AS sentence FROM pieces WHERE len({_WORDS.format("s")}) > 0),
counts AS (SELECT {each}, word, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {each}, unnest({_WORDS.format("sentence")}) AS word FROM phrases) GROUP BY ALL),
unit AS MATERIALIZED (SELECT {each}, word, n / sqrt(sum(n * n) OVER (PARTITION BY {each})) AS x FROM counts),
total AS (SELECT {key}, word, sum(x) AS y FROM unit GROUP BY ALL),
fixed AS MATERIALIZED (SELECT {each}, degree, count(*) OVER (PARTITION BY {key}) AS size FROM (SELECT {each}, sum(x * y) AS degree FROM unit JOIN total USING ({key}, word) GROUP BY ALL)),
r0 AS (SELECT {each}, 1.0 / size AS rank FROM fixed)"""
    for k in range(steps):
        out += f""",
y{k} AS MATERIALIZED (SELECT {key}, word, sum(rank / degree * x) AS y FROM unit JOIN fixed USING ({each}) JOIN r{k} USING ({each}) GROUP BY {key}, word),
r{k + 1} AS MATERIALIZED (SELECT {each}, {1 - damping!r} / any_value(size) + {damping!r} * sum(x * y) AS rank FROM unit JOIN y{k} USING ({key}, word) JOIN fixed USING ({each}) GROUP BY {each})"""
    return out


@query(f"""WITH {_ranked_sql(extract.STEPS, extract.DAMPING)}, placed AS (
  SELECT *, row_number() OVER w AS k, substring(sentence, 1, {extract.CONTENT}) AS cut FROM phrases JOIN r{extract.STEPS} USING (conv_id, topic_no, round_no, pos)
  WINDOW w AS (PARTITION BY conv_id, topic_no ORDER BY round(rank, {extract.PLACES}) DESC, round_no, pos)
), used AS (SELECT *, sum(length(cut) + 1) OVER (PARTITION BY conv_id, topic_no ORDER BY k) - 1 AS used FROM placed WHERE k <= {extract.MOST})
SELECT conv_id, topic_no, trim(substring(arg_min(cut, k), 1, {extract.TOPIC}), {_TRIM}) AS topic, string_agg(cut, chr(10) ORDER BY round_no, pos) AS content
FROM used WHERE k = 1 OR used <= {extract.CONTENT} GROUP BY 1, 2""")
def extractive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of topics by the rank of their sentences, without a model."""
    return extract.summaries(_judged(spark, sf_dir))


@query()
def dense_retrieval_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents nearest to each benchmark item, by vectors that are made here from the texts and kept by content."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    model, store = encoder.fit(docs), f"{shared_dir(spark)}/talkloom-vectors-{uuid.uuid4().hex}"
    found = retrieve.dense_top_k(encoder.encoded(items, model, store), encoder.encoded(docs, model, store))
    return found.select("query_id", "record_id", F.round("similarity", 6).alias("similarity"), "rank")


def _worthiness_script(kind: str, inputs: Column) -> Column:
    """Judges a record by the length of its topic: no, a flag of the wrong type, yes."""
    n = F.char_length(F.get_json_object(F.get_json_object(inputs, "$.record"), "$.topic")) % 3
    return F.when(n == 0, '{"is_worthy": false}').when(n == 1, '{"is_worthy": "no"}').otherwise('```json\n{"is_worthy": true}\n```')


@query(f"SELECT conv_id, topic_no, n_rounds FROM ({_RECORDS.replace('{acc}', _accumulated_sql('analysis_topic'))}) WHERE length(topic) % 3 <> 0")
def worthy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic records that a model finds worth keeping; those it says nothing usable of are kept."""
    records = rounds.build_records(_judged(spark, sf_dir))
    return judge.worthy_records(records, judge.Model(_worthiness_script), F.lit(_layers_old()), F.lit(_layers_old())).select("conv_id", "topic_no", "n_rounds")
