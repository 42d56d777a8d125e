"""Webhook events: routing, texts and senders of messages, feedback and cancellation state, status texts.

payloads has payload, the event's JSON. Everything is expressions over it, so batches and streams take the same plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions.cleaning import stripped
from tessera.functions.loose import whole_json

# Kinds of events and actions, keys in the order they are tried, and status texts.
MESSAGE, CARD = "im.message.receive_v1", "card.action.trigger"
ACTIONS = ("stop_feishu_answer", "answer_feedback")
SENDER_IDS = ("union_id", "open_id", "user_id")
SENDER_NAMES = ("user_name", "sender_name", "name", "display_name", "nickname")
ACTION_PLACES = ("event.action", "action", "event.action_info", "action_info")
STATUS_TEXTS = ("正在理解问题", "正在检索知识库", "正在整理资料", "正在组织答案", "处理失败，请稍后重试")
LONG_GREETING = "收到，这个问题信息量有点大，我先检索知识库再帮你整理清楚。"
ASKING_GREETING = "收到，我先帮你查一下相关资料，再整理成好读的答复。"
GREETING = "收到，我先看一下知识库里的相关内容，马上给你整理答复。"
ASKING = ("怎么", "如何", "为什么", "哪些", "是否", "能不能")


def _at(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, "$." + path)


def _some(x: Column) -> Column:
    return F.nullif(stripped(x), F.lit(""))


def message_text(message: Column) -> Column:
    """The text of a message of type text: its content's text, or the content itself where it is no JSON; else empty."""

    def text(content: Column) -> Column:
        is_json = whole_json(content).isNotNull()
        return stripped(F.when(is_json, F.when(F.substring(F.ltrim(content), 1, 1) == "{", _at(content, "text"))).otherwise(content))

    # As an element the content is taken out once, however often it is looked at.
    found = F.transform(F.array(_at(message, "content")), text).getItem(0)
    return F.when(_at(message, "message_type") == "text", F.coalesce(found, F.lit(""))).otherwise("")


def sender_id(sender: Column) -> Column:
    return F.coalesce(*[F.nullif(_at(sender, f"sender_id.{k}"), F.lit("")) for k in SENDER_IDS])


def sender_name(sender: Column) -> Column:
    names = [*SENDER_NAMES, *(f"sender_id.{k}" for k in SENDER_NAMES if k != "sender_name")]
    found = F.transform(F.array(*[_at(sender, k) for k in names]), stripped)
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def action_value(payload: Column) -> Column:
    """The value of a card's action, as JSON: of the first place that has one, or that is a known action itself."""
    tries = []
    for place in ACTION_PLACES:
        value = _at(payload, f"{place}.value")
        tries += [F.when(F.substring(F.ltrim(value), 1, 1) == "{", value), F.when(_at(payload, f"{place}.action").isin(*ACTIONS), _at(payload, place))]
    # A key can't be there without its letters, plain or as numbers.
    return F.when(payload.contains("action") | payload.contains("\\u"), F.coalesce(*tries))


def dedupe_key(message_id: Column, event_id: Column) -> Column:
    """message:id, else event:id; null for an event without either, which is never a duplicate."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(F.concat(F.lit("message:"), some(message_id)), F.concat(F.lit("event:"), some(event_id)))


def routed(payloads: DataFrame) -> DataFrame:
    """payloads with route (encrypted, challenge, card, ignored, empty or message), event_type, event_id, key, question, sender and sender_name, and action for cards."""
    p = F.col("payload")
    # Columns of their own, which are evaluated once each; fields of a struct would be put back into what reads them.
    parts = {f"_routed_{k}": _at(p, path) for k, path in (("kind", "header.event_type"), ("type", "type"), ("event", "header.event_id"), ("message", "event.message"), ("sender", "event.sender"))}
    part = lambda k: F.col(f"_routed_{k}")
    rows = payloads.withColumns(parts).withColumns({
        "event_type": F.coalesce(part("kind"), part("type")), "event_id": part("event"), "action": action_value(p), "question": message_text(part("message")),
        "sender": sender_id(part("sender")), "sender_name": sender_name(part("sender")), "key": dedupe_key(_at(p, "event.message.message_id"), part("event")),
    })
    is_card = (F.col("event_type") == CARD) | (part("type") == CARD) | _at(F.col("action"), "action").isin(*ACTIONS)
    route = (
        F.when(_at(p, "encrypt").isNotNull(), "encrypted")
        .when(F.coalesce(_at(p, "challenge"), F.lit("")) != "", "challenge")
        .when(F.coalesce(is_card, F.lit(False)), "card")
        .when(~F.col("event_type").eqNullSafe(F.lit(MESSAGE)), "ignored")
        .when(F.col("question") == "", "empty")
        .otherwise("message")
    )
    return rows.withColumn("route", route).drop(*parts)


def action_kind(action: Column) -> Column:
    """What a card's action asks for: feedback, stop, missing (a stop without its id) or unsupported."""
    name = _at(action, "action")
    return F.when(name == ACTIONS[1], "feedback").when(name == ACTIONS[0], F.when(F.coalesce(_at(action, "cancel_id"), F.lit("")) != "", "stop").otherwise("missing")).otherwise("unsupported")


def normal_status(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9A-Za-z\x{4e00}-\x{9fff}]+", ""))


def is_transient(answer: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether an answer is only a status text, whatever its marks and case."""
    own = normal_status(answer)
    return (own != "") & own.isin(*[_plain(t) for t in (*STATUS_TEXTS, *more) if _plain(t)])


def _plain(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isalnum() or "一" <= c <= "鿿").lower()


def greeting(question: Column) -> Column:
    """The canned first reply, by the question's length and words."""
    one = F.substring(stripped(F.regexp_replace(F.coalesce(question, F.lit("")), r"(?U)\s+", " ")), 1, 300)
    return F.when(F.length(one) >= 80, LONG_GREETING).when(one.rlike("|".join(ASKING)), ASKING_GREETING).otherwise(GREETING)


def status_card(prefix: Column, status: Column) -> Column:
    """Both texts with a blank line between, or the one that is there."""
    return F.concat_ws("\n\n", _some(prefix), _some(status))


def rotation(started: Column, now: Column, n_texts: int, every_s: float = 1.5) -> Column:
    """Which of n_texts status texts shows after the time since the start: the next one every 1.5 seconds, the last one for good."""
    return F.least(F.lit(n_texts - 1), F.floor((now - started) / every_s)).cast("int")


def comfort_minutes(started: Column, ended: Column, every_s: float = 60.0) -> Column:
    """The minutes at which an answer that is still open gets a comforting line: an array, empty for quick answers."""
    n = F.floor((ended - started) / every_s).cast("int")
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def delivered(answers: DataFrame, cancels: DataFrame, ttl_s: int = DEFAULT.cancel_ttl_s) -> DataFrame:
    """answers (cancel_id, started, answered, in seconds) with suppressed: a stop (cancel_id, at) came after the start and before the answer, within the state's life.

    The earliest stop that counts is taken by an aggregate, so that many clicks on one answer are no group of rows.
    """
    pairs = cancels.select("cancel_id", "at").alias("c").join(answers.select("cancel_id", "started", "answered").alias("a"), "cancel_id")
    counted = pairs.where((F.col("at") >= F.col("started")) & (F.col("at") < F.col("answered")) & (F.col("at") - F.col("started") <= ttl_s))
    first = counted.groupBy("cancel_id", "started").agg(F.min("at").alias("cancelled_at"))
    return answers.join(first, ["cancel_id", "started"], "left").withColumn("suppressed", F.col("cancelled_at").isNotNull())


def selections(states: DataFrame, clicks: DataFrame, window_s: int = DEFAULT.feedback_window_s) -> DataFrame:
    """feedback_id, created and selected: the first choice after the latest registration of each id, within its window.

    states (feedback_id, created): registering again resets the choice. clicks: feedback_id, at, choice. Times are seconds; the window is five minutes at least.
    """
    last = states.groupBy("feedback_id").agg(F.max("created").alias("created"))
    life = max(window_s, DEFAULT.feedback_window_least_s)
    open_ = clicks.join(last, "feedback_id").where((F.col("at") >= F.col("created")) & (F.col("at") - F.col("created") <= life))
    first = open_.groupBy("feedback_id").agg(F.min_by("choice", F.struct("at", "choice")).alias("selected"))
    return last.join(first, "feedback_id", "left")


def latest_open(rows: DataFrame, keys: list[str], order: list[str], answer: str = "answer") -> DataFrame:
    """The latest row of each key that has no answer yet."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.where(F.coalesce(F.col(answer), F.lit("")) == "").withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")
