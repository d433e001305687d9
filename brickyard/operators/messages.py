"""Message labels by rule, history and follow-up context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickyard.functions.dims import REGIONS
from brickyard.functions.text import strip

# Whole messages that are small talk, by category.
SMALL_TALK = {
    "greeting": ["chào", "chào bạn", "chào shop", "xin chào", "alo", "hi", "hello", "hey", "helo", "hí"],
    "farewell": ["tạm biệt", "chào tạm biệt", "bye", "bye bye", "goodbye", "hẹn gặp lại", "byebye"],
    "thanks": ["cảm ơn", "cám ơn", "cảm ơn bạn", "cám ơn bạn", "cảm ơn nhé", "thanks", "thank you", "thank", "ok cảm ơn", "oke cảm ơn"],
    "how_are_you": ["bạn khỏe không", "bạn khoẻ không", "khỏe không", "khoẻ không", "bạn có khỏe không", "dạo này sao rồi", "how are you", "how are you doing"],
    "bot_identity": ["bạn là ai", "bạn là ai vậy", "bạn là ai thế", "bạn tên gì", "bạn tên là gì", "who are you", "what is your name", "bạn là người hay máy", "bạn là bot à", "bạn là ai à"],
    "bot_capability": ["bạn làm được gì", "bạn giúp được gì", "bạn có thể làm gì", "bạn hỗ trợ gì", "bạn có thể giúp gì", "what can you do"],
    "apology": ["xin lỗi", "sorry", "xin lỗi bạn", "xin lỗi nhé"],
}
MAX_SMALL_TALK = 40
# An intent needs a phrase of every group.
INTENTS = {"construction_cost": [["nhà"], ["xây", "xây dựng", "thi công", "làm nhà", "dự toán"], ["giá", "chi phí", "bao nhiêu tiền", "tốn bao nhiêu", "hết bao nhiêu", "dự toán"]]}
# Area and budget patterns with the budget's multipliers.
AREA = r"(\d+(?:[.,]\d+)?)\s*m\s*2"
BUDGET = r"(?U)(\d+(?:[.,]\d+)?)\s*(tỷ|ty|triệu|trieu|tr\b)"
MULTIPLIERS = {"tỷ": 1e9, "ty": 1e9, "triệu": 1e6, "trieu": 1e6, "tr": 1e6}
FOLLOWUP_WORDS, TITLE_CHARS, CONTEXT_TURNS = 8, 512, 4


def small_talk(c: Column) -> Column:
    """The category of a message that is nothing but small talk, else null."""
    plain = strip(F.regexp_replace(F.lower(strip(c)), "[!?.,;:~…]+", ""))
    phrases = F.create_map(*[F.lit(x) for cat, words in SMALL_TALK.items() for w in words for x in (w, cat)])
    return F.when(F.length(plain).between(1, MAX_SMALL_TALK), F.try_element_at(phrases, plain))


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(c), F.lit(" "))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def intent(c: Column) -> Column:
    """The first intent with a phrase of each of its groups, else null."""
    out = F.lit(None).cast("string")
    for name, groups in reversed(INTENTS.items()):
        fits = F.lit(True)
        for group in groups:
            fits = fits & _any(_padded(c), group)
        out = F.when(fits, name).otherwise(out)
    return out


def regions(c: Column) -> Column:
    """All regions named, in fixed order."""
    named = F.array(*[F.when(_any(_padded(c), words), code) for code, words in REGIONS])
    return F.filter(named, lambda r: r.isNotNull())


def single_region(c: Column) -> Column:
    return F.when(F.size(regions(c)) == 1, F.get(regions(c), F.lit(0)))


def prefill(c: Column) -> Column:
    """struct<area, region, budget> read from a message; nulls where absent."""
    text = _padded(c)
    number = lambda pattern: F.replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in MULTIPLIERS.items() for x in kv]), F.regexp_extract(text, BUDGET, 2))
    return F.struct(number(AREA).alias("area"), F.get(regions(c), F.lit(0)).alias("region"), (number(BUDGET) * factor).alias("budget"))


def route(messages: DataFrame) -> DataFrame:
    """Adds route: form, small_talk, intent, guard, agent or retrieval, in that order of precedence.

    A voice turn (via_voice) has no intent route. A turn without a base, project or skill
    in scope (in_scope false) is for the topic guard, whose verdict is a model's. Without
    these columns no turn is by voice and every turn is in scope.
    """
    of = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in messages.columns else F.lit(default)
    r = F.when(F.col("form_id").isNotNull(), "form").when(small_talk(F.col("content")).isNotNull(), "small_talk")
    r = r.when(intent(F.col("content")).isNotNull() & ~of("via_voice", False), "intent").when(~of("in_scope", True), "guard")
    return messages.withColumn("route", r.when(F.col("agent_mode"), "agent").otherwise("retrieval"))


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation, with place 1.. oldest first."""
    last = Window.partitionBy("conversation_id").orderBy(F.desc("turn"), F.desc("message_id"))
    kept = messages.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("back")))).drop("back")


def history(messages: DataFrame, owned: DataFrame, n: int = 200) -> DataFrame:
    """The first n messages of the conversations in ``owned``."""
    mine = messages.join(owned.select("conversation_id").distinct(), "conversation_id", "left_semi")
    return mine.withColumn("place", F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn", "message_id"))).filter(F.col("place") <= n)


def followup_query(messages: DataFrame) -> DataFrame:
    """Adds query to user messages: a short one is prefixed by the user's message before it."""
    before = Window.partitionBy("conversation_id").orderBy("turn", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before)
    words = F.size(F.filter(F.split(F.col("content"), r"\s+"), lambda w: w != ""))
    return messages.withColumn("prev", prev).filter("role = 'user'").withColumn("query", F.when((words <= FOLLOWUP_WORDS) & F.col("prev").isNotNull(), F.concat_ws(" ", "prev", "content")).otherwise(F.col("content"))).drop("prev")


def turn_context(messages: DataFrame, n: int = CONTEXT_TURNS) -> DataFrame:
    """Adds context: the n user and assistant turns before each one, as "role: text" lines."""
    turns = messages.filter("role IN ('user', 'assistant')")
    before = Window.partitionBy("conversation_id").orderBy("turn", "message_id").rowsBetween(-n, -1)
    return turns.withColumn("context", F.array_join(F.collect_list(F.concat("role", F.lit(": "), "content")).over(before), "\n"))


def title(c: Column) -> Column:
    return F.substring(c, 1, TITLE_CHARS)
