"""The registered queries of this package. Each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: The rules of the query: (verdict, host and path prefix).
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the rules above, else by the classifier."""
    from talkloom.llm.url_filter import judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded by the multilingual byte-level ranks."""
    import public_tokenizers

    from talkloom.llm.bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece lengths of every document under the 32,000-piece vocabulary."""
    from talkloom.llm.token_counts import count_tokens, piece_sets, spelling

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = tokenizer_path("piece_bpe_32k.model")
    return count_tokens(docs, *piece_sets(model), spelling=spelling(model)).drop("text")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the ids."""
    from talkloom.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, ~held_out)
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of their links."""
    from talkloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, a row for each pair of document and item."""
    from talkloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates met by the words of every document."""
    from talkloom.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op9_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings within their labels, at a cosine of 0.93."""
    from talkloom.llm.pq import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op9_embedding_pq"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(c.c, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN comp c ON e.vec_id = c.x LEFT JOIN deg d ON e.vec_id = d.x
"""


@query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from four fifths of the ids."""
    from talkloom.llm.lm_score import Vocabulary, score

    vocabulary = Vocabulary.from_sentencepiece(tokenizer_path("piece_bpe_32k.model"))
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    return score(table(spark, sf_dir, "documents"), vocabulary, train)


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document when 50-byte strings of earlier documents are removed."""
    from talkloom.llm.suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"), with_text=False)


ORACLE_SQL["op1_suffix_dedup"] = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM b)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
g AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS p FROM w JOIN f USING (s) WHERE f.m < w.doc_id),
n AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY doc_id, k),
cuts AS (SELECT doc_id, k, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS last FROM spans),
parts AS (
  SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, string_agg(substr(h, CAST(2 * last + 1 AS BIGINT), CAST(2 * (a - last) AS BIGINT)), '' ORDER BY k) || substr(max(h), CAST(2 * max(z) + 1 AS BIGINT)) AS kept
  FROM cuts JOIN b USING (doc_id) GROUP BY doc_id
)
SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN parts USING (doc_id)
"""


def _license_sql() -> str:
    from talkloom.llm.license_scan import PHRASES, TEMPLATES, THRESHOLD, window, words_of

    step = window(TEMPLATES)

    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(regexp_split_to_array({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    templates = ", ".join(f"('{label}', {sorted(set(words_of(t)))})" for label, t in TEMPLATES.items())
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, {words.format('t')} AS ws FROM d),
t(label, ts) AS (VALUES {templates}), p(ps, label) AS (VALUES {phrases}),
hits AS (SELECT doc_id, i, label FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w), p WHERE ws[i + 1] = ps[1] AND ws[i + 1 : i + len(ps)] = ps),
base AS (SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, list_distinct(list(label)) AS labels FROM hits GROUP BY doc_id),
lines AS (SELECT doc_id, list_distinct(ws[i : i + {2 * step - 1}]) AS ls FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 1) + 1, {step})) AS i FROM w)),
met AS (SELECT doc_id, label, len(list_intersect(ls, ts)) / len(ts) AS share FROM lines, t WHERE len(list_intersect(ls, ts)) >= ceil({THRESHOLD} * len(ts) - 1e-9)),
best AS (SELECT doc_id, max(share) AS score, list_distinct(list(label)) AS labels FROM met GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLE_SQL["op6_license_scan"] = _license_sql()


#: DuckDB SQL for the unsigned CRC-32 of a text: a table of 256 steps, and a fold over the text's bytes.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY k) AS crc FROM (
  SELECT k, list_reduce(list_concat([k], range(8)), lambda a, x: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM (SELECT unnest(range(256)) AS k)))"""


def _crc_sql(text: str) -> str:
    h = f"hex(encode({text}))"
    each = f"list_transform(range(length({h}) // 2), lambda i: CAST('0x' || substr({h}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {each}), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the lines that three documents hold; the one with the largest id keeps them."""
    from talkloom.llm.line_dedup import apply, keep_bitmaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op11_line_dedup"] = f"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (SELECT *, {_LOWER_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
many AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last > doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN many USING (key) GROUP BY doc_id
"""


def _missing_letter(doc_id, word):
    """One in 31 words of a document lacks a letter, by the CRC of its id and the word."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), word))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with its commonest near word and the root that such words lead to."""
    from talkloom.llm.spelling import count_words, variants

    return variants(count_words(table(spark, sf_dir, "documents"), _missing_letter))


ORACLE_SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, {_LOWER_SQL.format("unnest(regexp_extract_all(text, '[A-Za-z' || chr(192) || '-' || chr(255) || ']+'))")} AS run FROM documents
), said AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, {_crc_sql("doc_id || ':' || run")} AS h FROM said, crc_table),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gaps AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS top FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN other END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)
), led(word, root, form) AS (
  SELECT word, word, form FROM forms UNION ALL SELECT l.word, f.word, f.form FROM led l JOIN forms f ON l.form = f.word
)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM forms f JOIN led l ON l.word = f.word AND l.form IS NULL
"""


def _looped(doc_id, words):
    """One in ten documents ends in words that repeat, by the CRC of its id."""
    h = F.crc32(doc_id.cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    a = F.try_mod(g, n.cast("long")).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.transform(F.sequence(a, n - 1), lambda i: F.element_at(words, a + (i - a) % p + 1))
    return F.when((h % 10 == 0) & (n > 0), F.concat(F.slice(words, 1, a), again)).otherwise(words)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document, and what remains without their repeats."""
    from talkloom.llm.periodic_runs import collapse, words_of

    split = table(spark, sf_dir, "documents").select("doc_id", words_of(F.col("text")).alias("w"))
    told = collapse(split, _looped(F.col("doc_id"), F.col("w")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    # runs come by start and period, so the first of equal exponents stays
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    first = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    told = told.withColumn("top", F.aggregate("runs", first, better))
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE_SQL["op13_periodic_runs"] = f"""
WITH {_CRC_TABLE}, d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, {_crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc_table
), e AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS looped, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN looped THEN g % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
w AS (SELECT doc_id, i, CASE WHEN looped AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
eq AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
isles AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k, i FROM eq),
spans AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM isles GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM spans a WHERE NOT EXISTS (FROM spans b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.s <= a.s AND b.s + b.len >= a.s + a.len)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len::DECIMAL(38, 18) / q DESC, s, q) AS k FROM runs) WHERE k = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS said FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
  sha256(coalesce(l.said, '')) AS runs_sha256, sha256(coalesce(k.said, '')) AS collapsed_sha256
FROM d LEFT JOIN top USING (doc_id) LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
