"""Chat and event state in batch form: answers, feedback, deduplication and progress; tessera.streaming has the streaming forms."""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions.cleaning import stripped

PREFIX = "fernet:v1:"


def _fernet_key(secret: str) -> bytes:
    """Signing and encryption keys, sixteen bytes each: of a key in URL-safe base 64, else of the SHA-256 of any other text."""
    secret = secret.strip()
    if not secret:
        raise ValueError("the encryption key is empty")
    try:
        raw = base64.urlsafe_b64decode(secret.encode("ascii"))
    except ValueError:
        raw = b""
    return raw if len(raw) == 32 else hashlib.sha256(secret.encode()).digest()


def _hmac(key: bytes, data: Column) -> Column:
    """HMAC with SHA-256, from two digests."""
    pads = [F.lit(bytes(b ^ pad for b in key.ljust(64, b"\0"))) for pad in (0x36, 0x5C)]
    return F.unhex(F.sha2(F.concat(pads[1], F.unhex(F.sha2(F.concat(pads[0], data), 256))), 256))


def encrypted(text: Column, secret: str, at: Column | None = None) -> Column:
    """A text as a token of the public Fernet format (AES-128 in CBC mode with a new vector, signed), behind a prefix; at is its time in seconds, now if absent."""
    key = _fernet_key(secret)
    seconds = F.lpad(F.hex(F.coalesce(at, F.unix_timestamp()) if at is not None else F.unix_timestamp()), 16, "0")
    body = F.concat(F.unhex(F.lit("80")), F.unhex(seconds), F.aes_encrypt(F.encode(text, "UTF-8"), F.lit(key[16:]), F.lit("CBC"), F.lit("PKCS")))
    # Bound as an array's element, so that what is signed is what was encrypted: the vector is a new one each time it is asked for.
    token = F.transform(F.array(body), lambda b: F.base64(F.concat(b, _hmac(key[:16], b)))).getItem(0)
    # Base 64 comes in lines; the URL-safe kind has other letters for two of them.
    return F.concat(F.lit(PREFIX), F.translate(F.regexp_replace(token, r"\s+", ""), "+/", "-_"))


def decrypted(text: Column, secret: str) -> Column:
    """The plain text; what was never encrypted is passed through, and a token that is not signed with the key is null."""
    key = _fernet_key(secret)
    token = F.unbase64(F.translate(F.substring(text, len(PREFIX) + 1, 1 << 30), "-_", "+/"))
    size = F.octet_length(token)
    body = F.substring(token, F.lit(1), size - 32)
    signed = F.hex(_hmac(key[:16], body)) == F.hex(F.substring(token, size - 31, F.lit(32)))
    plain = F.decode(F.aes_decrypt(F.substring(token, F.lit(10), size - 41), F.lit(key[16:]), F.lit("CBC"), F.lit("PKCS")), "UTF-8")
    return F.when(text.startswith(PREFIX), F.when(signed, plain)).otherwise(text)


def records(rows: DataFrame, secret: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Chat rows as they are stored: normalised ids, texts trimmed and encrypted, an answer that is not there yet left empty, and the time of creation.

    rows: user_id, user_name, session_id, conversation_id, question and answer; more: columns that are passed on.
    """
    some = lambda c: F.nullif(stripped(F.col(c)), F.lit(""))
    hidden = lambda c: F.when(some(c).isNotNull(), encrypted(some(c), secret)).otherwise("")
    out = normalized_ids(rows).withColumns({"user_name": some("user_name"), "question": hidden("question"), "answer": hidden("answer"), "create_time": F.current_timestamp()})
    return out.select(*more, "user_id", "user_name", "session_id", "conversation_id", "create_time", "question", "answer")


def insert(rows: DataFrame, path: str, secret: str) -> None:
    """Appends chat rows to the table at path."""
    records(rows, secret).write.mode("append").parquet(path)


def normalized_ids(rows: DataFrame) -> DataFrame:
    """Ids without blanks; an absent user is anonymous, an absent conversation is the session."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    session = F.coalesce(some("session_id"), F.lit("default"))
    return rows.withColumns({"user_id": F.coalesce(some("user_id"), F.lit("anonymous")), "session_id": session, "conversation_id": F.coalesce(some("conversation_id"), session)})


def attach_answers(events: DataFrame) -> DataFrame:
    """key, seq, question and answer: an answer closes the latest open question of its key, or stands alone where none is open.

    events has key, seq, kind (question or answer) and text. Open questions are a stack, which only a walk in order can follow; it is carried over frames, so that a key's events
    are never held together.
    """
    columns = ["key", "seq", "question", "answer"]

    def walked(frames):
        key, open_, begun = None, [], False
        for frame in frames:
            out = []
            for k, seq, kind, text in zip(*(frame[c] for c in ("key", "seq", "kind", "text"))):
                if not begun or k != key:
                    out += [(key, *q, "") for q in open_]
                    key, open_, begun = k, [], True
                if kind == "question":
                    open_.append((seq, text))
                elif open_:
                    out.append((key, *open_.pop(), text))
                else:
                    out.append((key, seq, "", text))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(key, *q, "") for q in open_], columns=columns)

    kind = dict(events.dtypes)["key"]
    rows = events.select("key", "seq", "kind", "text").repartition("key").sortWithinPartitions("key", "seq", "kind", "text")
    return rows.mapInPandas(walked, f"key {kind}, seq long, question string, answer string")


def first_choices(clicks: DataFrame, keys: list[str], order: list[str], choice: str) -> DataFrame:
    """The first choice of each key; later ones don't count."""
    return clicks.groupBy(*keys).agg(F.min_by(choice, F.struct(*order)).alias("selected"), F.count(F.lit(1)).alias("n_clicks"))


def within_window(rows: DataFrame, ts: str, seconds: int = DEFAULT.feedback_window_s) -> DataFrame:
    """Rows no older than the window before the latest row; a window is five minutes at least."""
    last = rows.agg(F.max(ts).alias("now"))
    least = max(seconds, DEFAULT.feedback_window_least_s)
    return rows.join(F.broadcast(last)).where(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) <= least * 1_000_000).drop("now")


def first_seen(events: DataFrame, ttl_s: int = DEFAULT.dedupe_ttl_s) -> DataFrame:
    """Events (key, ts_us, event_id) that are no duplicates: the first of a key, and each that comes ttl or more after the last one kept."""

    def kept(frames):
        key, until = None, None  # carried over frames: a key's events may be more than one of them
        for frame in frames:
            stay = []
            for i, (k, t) in enumerate(zip(frame["key"], frame["ts_us"])):
                if k != key or until <= t:
                    stay.append(i)
                    key, until = k, t + ttl_s * 1_000_000
            yield frame.iloc[stay]

    rows = events.select("key", "ts_us", "event_id").repartition("key").sortWithinPartitions("key", "ts_us", "event_id")
    return rows.mapInPandas(kept, "key string, ts_us long, event_id long")


def running_stage(events: DataFrame, keys: list[str], order: list[str], stage: Column) -> DataFrame:
    """events with stage and progress, the highest stage so far: progress never goes back."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("stage", stage).withColumn("progress", F.max("stage").over(w))
