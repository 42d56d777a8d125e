"""Cleaning of texts: one list of steps, as expressions in the JVM and as Python for the values within JSON tables."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode white space, format characters without width, and what the cleaning removes or replaces, in this order.
SPACE = "[\t-\r \u0085   -     　]"
NO_SPACE = "[^" + SPACE[1:]
INVISIBLE = "​‌‍⁠﻿"
HIDDEN = rf"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F{INVISIBLE}\p{{Cs}}\p{{Co}}\p{{Cn}}]"
VARIATIONS = "[︀-️\U000e0100-\U000e01ef]"
EMOJI = "[\U0001f000-\U0001faff✅✔✨➡⚠★☆]+"
LOST = "�+"
MOJIBAKE = (
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", '"'),
    ("â€\u009d", '"'),
    ("â€", '"'),
    ("â€¦", "..."),
    ("â€“", "-"),
    ("â€”", "-"),
    ("Â", ""),
)
MORE_MOJIBAKE = "Ã[\u0080-¿]|Â[\u0080-¿]?|â[\u0080-¿]{1,2}|å[\u0080-¿]{1,2}"
SYNC_WITHIN = rf"(?i){SPACE}*同步自文档{SPACE}*[:：]{SPACE}*https?://{NO_SPACE}+"
IMAGE_PATH_WITHIN = rf"(?i){SPACE}*图片{SPACE}*[:：]{SPACE}*data[\\/]+processing[\\/][^\n]+?\.(?:png|jpe?g|gif|bmp|webp|tiff?)"
LONE_MARKS = rf"(?<={SPACE})[\"'.-]+(?={SPACE}|$)"
BLANKS = "[ \t 　]+"
SYNC_LINE = rf"^{SPACE}*同步自文档{SPACE}*[:：]{SPACE}*(?:\{{\{{[^{{}}]*\}}\}}|https?://{NO_SPACE}*)?{SPACE}*$"
SYNC_NAME = "同步自文档"
IMAGE_PATH_LINE = rf"(?i)^{SPACE}*图片{SPACE}*[:：]{SPACE}*data[\\/]+processing[\\/].+$"
PLACEHOLDER = rf"(?i)^(?:[（(]{SPACE}*空{SPACE}*[）)]|空|null|none|nan)$"

#: Pattern and replacement of each step; literal texts are replaced between the two lists.
FIRST = ((HIDDEN, ""), (VARIATIONS, ""), (EMOJI, ""), (LOST, ""))
LAST = (
    (MORE_MOJIBAKE, ""),
    (SYNC_WITHIN, ""),
    (IMAGE_PATH_WITHIN, ""),
    (LONE_MARKS, ""),
    (BLANKS, " "),
    (rf"{SPACE}+([，。！？；：、,.!?;:])", "$1"),
    (rf"([（(【\[]){SPACE}+", "$1"),
    (rf"{SPACE}+([）)】\]])", "$1"),
)
LIGHT_FIRST, LIGHT_LAST = (FIRST[0], FIRST[1], FIRST[3]), ((BLANKS, " "),)
ENDS = rf"^{SPACE}+|{SPACE}+$"

#: What the JVM looks at before a step's pattern: characters at which it can't begin, most of a text, are passed by with one comparison. The patterns match as without it.
BEFORE = {
    HIDDEN: "(?=[^ -~])", VARIATIONS: "(?=[^ -~])", EMOJI: "(?=[^ -~])", MORE_MOJIBAKE: "(?=[ÃÂâå])", SYNC_WITHIN: "(?=[^!-~])(?! [!-~])", IMAGE_PATH_WITHIN: "(?=[^!-~])(?! [!-~])",
    LONE_MARKS: "(?=[\"'.-])", LAST[5][0]: "(?=[^!-~])(?! [0-9A-Za-z])", LAST[7][0]: "(?=[^!-~])(?! [0-9A-Za-z])",
}
_BLANK = chr(32)
#: And patterns that leave single blanks as they are.
INSTEAD = {BLANKS: f"{BLANKS[:-1]}{{2,}}|{BLANKS[:-1].replace(_BLANK, '', 1)}"}
#: The characters of SPACE.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(SPACE, c))


def stripped(x: Column) -> Column:
    """Without SPACE at both ends."""
    return F.trim(x, F.lit(SPACES))


def _replaced(x: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(x, BEFORE.get(pattern, "") + INSTEAD.get(pattern, pattern), new)


def visible(x: Column) -> Column:
    """Without invisible, control, private and unassigned characters; line breaks and tabs stay."""
    return F.regexp_replace(x, HIDDEN, "")


#: A character that one of the steps up to the image paths looks for: most texts have none, and skip these.
SUSPECT = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\xBFÃÂâå\u0100-\U0010ffff]"


def _steps(x: Column, first, last) -> Column:
    odd = x
    for pattern, new in first:
        odd = _replaced(odd, pattern, new)
    for wrong, right in MOJIBAKE:
        odd = F.replace(odd, F.lit(wrong), F.lit(right))
    rare = [step for step in last if step[0] in (MORE_MOJIBAKE, SYNC_WITHIN, IMAGE_PATH_WITHIN)]
    for pattern, new in rare:
        odd = _replaced(odd, pattern, new)
    x = F.when(x.rlike(SUSPECT), odd).otherwise(x)
    for pattern, new in last:
        if (pattern, new) not in rare:
            x = _replaced(x, pattern, new)
    return stripped(x)


def clean_text(x: Column) -> Column:
    """The full cleaning."""
    return _steps(x, FIRST, LAST)


def clean_metadata(x: Column) -> Column:
    """The light cleaning: for paths, addresses and image names."""
    return _steps(x, LIGHT_FIRST, LIGHT_LAST)


def compiled() -> tuple:
    """The steps for cleaned(): once a batch."""
    import regex

    make = lambda rows: [(regex.compile(p), n.replace("$1", r"\1")) for p, n in rows]
    return make(FIRST), make(LAST), regex.compile(ENDS)


def cleaned(value: str, steps: tuple | None = None) -> str:
    """clean_text() of a Python string."""
    first, last, ends = steps or compiled()
    for pattern, new in first:
        value = pattern.sub(new, value)
    for wrong, right in MOJIBAKE:
        value = value.replace(wrong, right)
    for pattern, new in last:
        value = pattern.sub(new, value)
    return ends.sub("", value)


def cleaned_value(value, steps: tuple):
    """A JSON value with its texts and keys cleaned; keys that are empty then go."""
    if isinstance(value, str):
        return cleaned(value, steps)
    if isinstance(value, list):
        return [cleaned_value(x, steps) for x in value]
    if isinstance(value, dict):
        pairs = ((cleaned(k, steps), v) for k, v in value.items())
        return {k: cleaned_value(v, steps) for k, v in pairs if k}
    return value


def cleaned_table(text: str | None, steps: tuple | None = None) -> str | None:
    """A JSON table cleaned value by value; what is no JSON is cleaned as a text."""
    if text is None:
        return None
    steps = steps or compiled()
    seen = steps[0][0][0].sub("", text)
    try:
        value = json.loads(seen)
    except ValueError:
        return cleaned(seen, steps)
    return json.dumps(cleaned_value(value, steps), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def clean_table(text: pd.Series) -> pd.Series:
    steps = compiled()
    return text.map(lambda t: cleaned_table(t, steps))


def is_sync_line(x: Column) -> Column:
    return F.coalesce(x.rlike(SYNC_LINE), F.lit(False))


def is_image_path_line(x: Column) -> Column:
    return F.coalesce(x.rlike(IMAGE_PATH_LINE), F.lit(False))


def is_empty(x: Column) -> Column:
    text = stripped(F.coalesce(x, F.lit("")))
    return (text == "") | text.rlike(PLACEHOLDER)


def sql(column: str, light: bool = False) -> str:
    """The cleaning of column for DuckDB, whose patterns have no look-behind and no class of unassigned characters: lone marks go in two rounds."""
    first, last = (LIGHT_FIRST, LIGHT_LAST) if light else (FIRST, LAST)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = column
    step = lambda p, n: f"regexp_replace({out}, {quote(p)}, {quote(n)}, 'g')"
    for pattern, new in first:
        out = step(pattern.replace(r"\p{Cs}", "").replace(r"\p{Cn}", ""), new)
    for wrong, right in MOJIBAKE:
        out = f"replace({out}, {quote(wrong)}, {quote(right)})"
    for pattern, new in last:
        if pattern == LONE_MARKS:
            for _ in range(2):
                out = step(rf"({SPACE})[\"'.-]+({SPACE}|$)", r"\1\2")
        else:
            out = step(pattern, new.replace("$1", r"\1"))
    return step(ENDS, "")
