"""Bounded splitting of chunk contents: plain text at numbering or sentence ends, asset tags as wholes, JSON tables by rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.config import DEFAULT, Config

# Where a text may be cut.
NUMBERING = re.compile(
    r"(?im)(?:^|[\n\r]+|[ \t\u3000]+)"
    r"(?P<marker>\d{1,3}\s*[.．、)]|[一二三四五六七八九十百千万]{1,6}\s*[、.．)]|第\s*[\d一二三四五六七八九十百千万]{1,6}\s*[章节篇部分]|part\s*\d+|chapter\s*\d+|section\s*\d+)"
)
SENTENCE_END = re.compile(r"[。！？!?；;]\s*|[.]\s+(?=[^\d])|\n+")
TAG = re.compile(r'(?s)<(img|a)\s+index="(\d+)">(.*?)</\1>')
LEAST = 10


def plain(text: str, most: int, overlap: int) -> list[str]:
    """Pieces of at most most characters: cut before the last numbering after the tenth character, else after the last sentence end, else hard with an overlap."""
    out, rest = [], text.strip()
    while len(rest) > most:
        head = rest[:most]
        cuts = [m.start("marker") for m in NUMBERING.finditer(head) if m.start("marker") > LEAST] or [m.end() for m in SENTENCE_END.finditer(head) if m.end() > LEAST]
        at = cuts[-1] if cuts else most
        out.append(rest[:at].rstrip())
        rest = rest[at if cuts else at - min(overlap, at - 1) :].lstrip()
    return [x for x in [*out, rest] if x]


def tagged(text: str, most: int, overlap: int) -> list[str]:
    """Like plain(), but each asset tag is a piece of its own; a long image body is cut and every part wrapped again."""
    out: list[str] = []
    at = 0
    for m in TAG.finditer(text):
        out += plain(text[at : m.start()], most, overlap)
        room = most - (len(m[0]) - len(m[3]))
        if m[1] == "img" and len(m[0]) > most and room > LEAST:
            out += [f'<img index="{m[2]}">{p}</img>' for p in plain(m[3], room, overlap)]
        else:
            out.append(m[0])
        at = m.end()
    return out + plain(text[at:], most, overlap)


def batches(items: list, most: int, size) -> list[list]:
    """Greedy runs of items whose size(run) is at most most; an item that is too large is a run of its own."""
    out: list[list] = []
    for x in items:
        if out and size([*out[-1], x]) <= most:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def json_text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def as_json(text: str):
    """The value of a text that looks like JSON, else None."""
    if not text.strip()[:1] in ("[", "{"):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return None


def object_parts(value: dict, most: int) -> list[dict]:
    """Greedy batches of an object's entries; an entry that is too large is cut by its own list or object under its key."""
    out: list[dict] = []
    open_batch = False
    for key, item in value.items():
        if len(json_text({key: item})) > most:
            inner = batches(item, most, lambda b: len(json_text({key: b}))) if isinstance(item, list) else object_parts(item, most) if isinstance(item, dict) else [item]
            out += [{key: part} for part in inner]
            open_batch = False
        elif open_batch and len(json_text(out[-1] | {key: item})) <= most:
            out[-1][key] = item
        else:
            out.append({key: item})
            open_batch = True
    return out


def json_pieces(value, most: int) -> list[str]:
    if len(json_text(value)) <= most:
        return [json_text(value)]
    parts = batches(value, most, lambda b: len(json_text(b))) if isinstance(value, list) else object_parts(value, most) if isinstance(value, dict) else [value]
    return [json_text(p) for p in parts]


def looks_like_json(text: str) -> bool:
    return text.lstrip()[:1] in ("[", "{")


def split(text: str | None, config: Config = DEFAULT, kind: str = "text") -> list[str]:
    """The pieces of a chunk's content."""
    text = (text or "").strip()
    most, overlap = config.max_chunk_chars, config.overlap_chars
    if not text:
        return []
    if len(text) <= most:
        return [text]
    if kind == "text" and TAG.search(text):
        return tagged(text, most, overlap)
    value = as_json(text) if kind == "table" or looks_like_json(text) else None
    return (json_pieces(value, most) if value is not None else []) or plain(text, most, overlap)


@F.pandas_udf(ArrayType(StringType()))
def split_content(text: pd.Series) -> pd.Series:
    return text.map(split)
