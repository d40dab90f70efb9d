"""Text functions of the conversation engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that count as white space when text is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "               　"
)
#: What stands between words.
NO_WORD = r"[^\p{L}\p{N}]+"
#: Fixed value: the name of a topic that has none.
UNNAMED_TOPIC = "未命名主题"
#: Stages of trust, with the bounds below which they hold.
STAGES = ((30, "Initial (Suspicion)"), (80, "Process (Utilization)"), (None, "Final (Symbiosis)"))
#: The short stage labels and attitudes that prompts carry.
ATTITUDES = (
    (30, "Initial", "保持警惕，观察用户意图，不轻易信任"),
    (80, "Process", "逐渐熟悉，开始展现真实性格，适度放开"),
    (None, "Final", "高度信任，完全展现自我，深度陪伴"),
)


def strip(c: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def not_empty(c: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(c, F.lit(""))


def round_dialog(user: Column, agent: Column) -> Column:
    """One round of dialogue as text."""
    return F.concat(F.lit("user: "), strip(text_or_empty(user)), F.lit("\nagent: "), strip(text_or_empty(agent)))


def topic_from_round(first_round: Column) -> Column:
    """The fallback topic: the first 30 characters of a topic's first round, stripped."""
    return F.coalesce(not_empty(strip(F.substring(first_round, 1, 30))), F.lit(UNNAMED_TOPIC))


def last_rounds(rounds: Column, n: int = 3) -> Column:
    """The fallback content: the last n rounds, a line break between them."""
    return F.array_join(F.slice(rounds, F.greatest(F.size(rounds) - (n - 1), F.lit(1)), n), "\n")


def expand_query(query: Column, prediction: Column, risk: Column) -> Column:
    return F.concat_ws(" ", query, not_empty(prediction), not_empty(risk))


def record_document(topic: Column, content: Column, keywords: Column, prediction: Column, risk: Column) -> Column:
    """The text under which a record is found. Empathy, action and times are not part of it."""
    main = F.concat_ws(" ", text_or_empty(topic), text_or_empty(content), F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " "))
    return expand_query(main, prediction, risk)


def clean_keywords(keywords: Column) -> Column:
    """Stripped, without blanks, each once in the order of first occurrence. A list with an item that is null is taken for broken: empty."""
    cleaned = F.array_distinct(F.filter(F.transform(keywords, strip), lambda x: x != ""))
    return F.when(F.exists(keywords, lambda x: x.isNull()), F.array().cast("array<string>")).otherwise(cleaned)


def keywords_of(response: Column) -> Column:
    """The keywords of a response, cleaned; empty where it isn't an object with a list of strings only."""
    raw = F.get_json_object(json_text(response), "$.keywords")
    items = F.from_json(raw, "array<variant>")
    broken = items.isNull() | F.exists(items, lambda x: F.schema_of_variant(x) != "STRING")
    return F.when(broken, F.array().cast("array<string>")).otherwise(clean_keywords(F.from_json(raw, "array<string>")))


def ordered_distinct(values: Column, between: str = " | ") -> Column:
    """The non-empty values, each once in the order of first occurrence."""
    return F.array_join(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))), between)


def fenced(response: Column) -> Column:
    """The inside of the first fenced block, or null."""
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    return F.when(F.regexp_like(response, F.lit(fence)), F.regexp_extract(response, fence, 1))


def json_text(response: Column) -> Column:
    """The inside of the first fenced block, else the whole response stripped; an empty response is {}."""
    r = text_or_empty(response)
    return F.when(r == "", "{}").otherwise(F.coalesce(fenced(r), strip(r)))


def parse_response(response: Column) -> Column:
    """The response's JSON as a variant; {} where it can't be parsed."""
    return F.coalesce(F.try_parse_json(json_text(response)), F.parse_json(F.lit("{}")))


def _as_printed(told: Column) -> Column:
    """JSON text with its numbers as they are printed once parsed: without zeros that end a fraction (but one), a number that stands alone also without
    an exponent; and with the digits and minus signs that a text spells by escapes."""
    plain = F.regexp_replace(F.regexp_replace(told, r"\\u003([0-9])", "$1"), r"\\u002[dD]", "-")
    # a text is kept as it is, a fraction up to its last digit that counts
    trimmed = F.regexp_replace(plain, r'("(?:[^"\\]|\\.)*")|(\.[0-9]*?[1-9])0+(?![0-9])|(\.0)0+(?![0-9])', "$1$2$3")
    alone = F.regexp_like(told, F.lit(r"^-?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+$"))
    return F.when(alone, told.try_cast("double").cast("string")).otherwise(trimmed)


def parse_score(value: Column, strict: bool = False) -> Column:
    """A score's integer. The response is read as JSON first (fenced or not; what isn't JSON counts as an empty
    object), and then the digits and minus signs of that value's text are the number; empty: 0; not an integer: null.
    The value's text is that of what was parsed: 2.50 is 25, 1000.0 and 1e3 are 10000 (an exponent within a list or an object is left as written).

    strict: only a whole number from -5 to 5 counts, else null.
    """
    if strict:
        n = F.when(F.regexp_like(strip(value), F.lit(r"^[+-]?\d+$")), strip(value).try_cast("int"))
        return F.when(n.between(-5, 5), n)
    told = json_text(value)
    # a text is its JSON string, so that the signs and digits of all kinds of values are kept alike
    kept = F.regexp_replace(F.when(F.try_parse_json(told).isNotNull(), _as_printed(told)).otherwise(""), "[^-0-9]", "")
    return F.when(kept == "", F.lit(0)).otherwise(kept.try_cast("int"))


def _bucket(trust: Column, cases: tuple, pick) -> Column:
    out = pick(cases[-1])
    for case in reversed(cases[:-1]):
        out = F.when(trust < case[0], pick(case)).otherwise(out)
    return out


def trust_stage(trust: Column) -> Column:
    return _bucket(trust, STAGES, lambda c: F.lit(c[1]))


def trust_attitude(trust: Column) -> Column:
    """Struct of the short stage label and the attitude text."""
    return _bucket(trust, ATTITUDES, lambda c: F.struct(F.lit(c[1]).alias("stage"), F.lit(c[2]).alias("attitude")))


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def without_brackets(c: Column) -> Column:
    """Without bracketed text; brackets may be full or half width, in any pairing."""
    return F.regexp_replace(c, r"[（(][\s\S]*?[）)]", "")


def without_astral(c: Column) -> Column:
    """Without characters beyond the basic plane (emoji)."""
    return F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", "")


def spoken(c: Column) -> Column:
    """Text as it is spoken: stripped, without emoji and bracketed text."""
    return without_brackets(without_astral(strip(c)))


def cache_key(text: Column, voice: Column | None = None) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the text, with the voice before it if given."""
    return F.substring(F.sha2(text if voice is None else F.concat(voice, F.lit(":"), text), 256), 1, 16)


def short_time(iso: Column) -> Column:
    """An ISO time to the minute, with a space for the T."""
    return text_or_empty(F.replace(F.substring(iso, 1, 16), F.lit("T"), F.lit(" ")))


def html_escape(c: Column) -> Column:
    out = text_or_empty(c)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def buffer_status(topic: Column, rounds: Column) -> Column:
    return F.when(rounds > 0, F.concat(F.lit("当前话题："), topic, F.lit("\n对话轮次："), rounds.cast("string"))).otherwise("当前无对话内容")


def is_command(message: Column, *commands: str) -> Column:
    return F.lower(strip(message)).isin(*commands)


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text_or_empty(c)), NO_WORD), "")
