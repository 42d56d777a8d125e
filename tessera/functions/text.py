"""Text expressions: cleaning, tokens, ids, lengths, truncation, tags and URLs. All run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.cleaning import INVISIBLE, clean_metadata, clean_text, is_empty, stripped  # noqa: F401
from tessera.functions.loose import embedded



def trim_u(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def without_space(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", "")


def non_space_length(x: Column) -> Column:
    return F.length(without_space(F.coalesce(x, F.lit(""))))


def is_empty_text(x: Column) -> Column:
    return is_empty(x)


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Escapes that other programs leave in plain text, and what they stand for.
ESCAPES = (('\\"', '"'), ("\\'", "'"), ("\\/", "/"), ("\\n", " "), ("\\r", " "), ("\\t", " "), ("\\b", " "), ("\\f", " "))
OMITTED = "\n\n[文档过长，中间部分已省略，以下为文档末尾内容]\n\n"


def sanitize_question(x: Column) -> Column:
    """A question as it is sent on: composed, without controls, escapes collapsed, on one line."""
    out = F.regexp_replace(_nfc(x), "[\ufeff\u200b\u200c\u200d]", "")
    out = F.regexp_replace(out, "[\\x{2028}\\x{2029}]", "\n")
    for escaped, plain in ESCAPES:
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return stripped(F.regexp_replace(out, r"[ \t\r\n]+", " "))


#: Runs of Han characters: a script without blanks.
HAN = "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}"


def pairs_of(run: Column) -> Column:
    """Neighbouring pairs of a run's characters; a lone one stays alone."""
    return F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))


def words(x: Column) -> Column:
    """Default analyzer of the lexical index, in lower case: runs of letters and digits, and the pairs of neighbours in runs of Han characters.

    Pairs stand in for a dictionary's words: every word of two or more characters is found by its pairs, whatever the vocabulary.
    """
    low = F.lower(F.coalesce(x, F.lit("")))
    found = F.regexp_extract_all(low, F.lit(rf"[{HAN}]+|[\p{{L}}\p{{N}}&&[^{HAN}]]+"), F.lit(0))
    mixed = F.flatten(F.transform(found, lambda w: F.when(F.rlike(w, F.lit(rf"^[{HAN}]")), pairs_of(w)).otherwise(F.array(w))))
    return F.when(low.rlike(f"[{HAN}]"), mixed).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def counted_words(x: Column, analyzer=words) -> Column:
    """Array of (term, tf, dl): the words of a text (an analyzer makes an array of them), how often it has them and how many it has in all, counted along the sorted words, without an exchange."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        count = lambda p, k, b: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - p).cast("long").alias("tf"), F.size(s).cast("long").alias("dl"))
        return F.transform(F.array(starts), lambda b: F.transform(b, lambda p, k: count(p, k, b))).getItem(0)

    return F.transform(F.array(F.sort_array(analyzer(x))), runs).getItem(0)


def vocabulary_words(x: Column, vocabulary: Column) -> Column:
    """words() and each entry of vocabulary (an array of lower-case texts) that occurs in the text: for names that are longer than a pair."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.concat(words(x), F.filter(vocabulary, lambda v: F.instr(low, v) > 0))


def overlap_tokens(x: Column, compat: bool = False) -> Column:
    """Distinct ASCII words of two letters or more and pairs of neighbouring Han characters.

    compat deletes white space before ASCII words are found, as the reference does, so that neighbouring words run together; an underscore is part of a word then.
    """
    text = F.lower(F.coalesce(x, F.lit("")))
    flat = without_space(text)
    ascii_words = F.regexp_extract_all(flat if compat else text, F.lit("[a-z0-9_]{2,}" if compat else "[a-z0-9]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(flat, F.lit("[\\x{4E00}-\\x{9FFF}]{2,}"), F.lit(0))
    return F.array_distinct(F.concat(ascii_words, F.flatten(F.transform(runs, pairs_of))))


def overlap_ratio(reference: Column, candidate: Column) -> Column:
    """Share of the reference tokens that the candidate has; 0 when either has none. Both are computed once, however they are made."""
    ratio = lambda x: F.when((F.size(x["r"]) > 0) & (F.size(x["c"]) > 0), F.size(F.array_intersect(x["r"], x["c"])) / F.size(x["r"])).otherwise(F.lit(0.0))
    return F.transform(F.array(F.struct(reference.alias("r"), candidate.alias("c"))), ratio).getItem(0)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]+$", "")


def file_id(path: Column, kind: Column) -> Column:
    return F.concat_ws("_", kind, F.substring(F.sha1(file_stem(path)), 1, 12))


def chunk_id(file: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%06d", file, index)


def qa_id(path: Column, index: Column, question: Column) -> Column:
    return F.concat(F.lit("qa_"), F.substring(F.sha1(F.concat_ws(":", path, index.cast("string"), question)), 1, 16))


def trim_document(x: Column, most: int) -> Column:
    """Two thirds of the allowed length from the head, the rest from the tail, with a note between; runs of blank lines count once."""
    text = stripped(F.regexp_replace(x, r"\n{3,}", "\n\n"))
    head = most * 2 // 3
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(OMITTED), F.right(text, F.lit(most - head))))


def shorten(x: Column, most: int, mark: str = "...") -> Column:
    """On one line, cut at most characters with a mark behind."""
    one = squeeze(x)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most), F.lit(mark)))


def headline(x: Column, most: int) -> Column:
    """The first two lines without quotes, on one line, of at most most characters with the mark; empty for null and none."""
    lines = F.filter(F.split(F.coalesce(x, F.lit("")), r"\r\n|\r|\n"), lambda t: stripped(t) != "")
    one = stripped(F.regexp_replace(F.array_join(F.transform(F.slice(lines, 1, 2), lambda t: F.regexp_replace(stripped(t), "^[\"']+|[\"']+$", "")), " "), r"\s+", " "))
    none = F.lower(F.regexp_replace(stripped(F.regexp_replace(stripped(x), "^`+|`+$", "")), "^[\"']+|[\"']+$", "")).isin("null", "none") | F.lower(one).isin("null", "none")
    cut = F.when(F.length(one) > most, F.concat(F.regexp_replace(F.substring(one, 1, most - 3), r"\s+$", ""), F.lit("..."))).otherwise(one)
    return F.when(F.coalesce(none, F.lit(False)), F.lit("")).otherwise(cut)


def path_segment(x: Column) -> Column:
    """A heading as part of a path: separators become full-width ones."""
    return F.replace(F.replace(squeeze(x), F.lit("/"), F.lit("／")), F.lit("\\"), F.lit("＼"))


def link_tag(index: Column, name: Column) -> Column:
    return F.concat(F.lit('<a index="'), index.cast("string"), F.lit('">链接：'), F.replace(name, F.lit("</a>"), F.lit("<／a>")), F.lit("</a>"))


def image_tag(index: Column, name: Column) -> Column:
    return F.concat(F.lit('<img index="'), index.cast("string"), F.lit('">图片：'), F.replace(name, F.lit("</img>"), F.lit("<／img>")), F.lit("</img>"))


def tag_indexes(content: Column) -> Column:
    """Indexes of the asset tags of a chunk."""
    return F.transform(F.regexp_extract_all(content, F.lit(r'<(?:a|img) index="(\d+)">'), F.lit(1)), lambda x: x.cast("int"))


@F.pandas_udf(StringType())
def embedding_content(content: pd.Series) -> pd.Series:
    """A chunk's content as it is embedded: tags replaced by their one-line bodies, a JSON table as its headers and rows of cells."""
    return content.map(lambda t: None if t is None else embedded(t))


def embedding_text(file_name: Column, path: Column, content: Column, most: int | None = None) -> Column:
    """What a chunk's vector is made of: file stem, heading path and content, blank ones left out; most cuts it for services with a limit."""
    parts = [F.nullif(stripped(F.coalesce(x, F.lit(""))), F.lit("")) for x in (file_stem(file_name), path, embedding_content(content))]
    out = F.concat_ws(" ", *parts)
    return out if most is None else F.substring(out, 1, most)


def heading_level(style: Column) -> Column:
    """Level of a heading style, 1 where it has no number or is a title; null for body text."""
    name = F.lower(F.coalesce(style, F.lit("")))
    number = F.regexp_extract(name, r"^(?:heading|标题)\s*([1-9])$", 1)
    return F.when(name.isin("title", "标题", "heading"), F.lit(1)).when(number != "", number.cast("int"))


def url_domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


def elapsed_text(seconds: Column) -> Column:
    whole = F.floor(F.greatest(seconds, F.lit(0)))
    return F.when(whole < 60, F.format_string("%ds", whole)).otherwise(F.format_string("%dm%02ds", F.floor(whole / 60), whole % 60))


def epoch_seconds(iso: Column) -> Column:
    """ISO time to seconds; null if it can't be read."""
    return F.unix_micros(F.try_to_timestamp(iso)) / 1e6


def hamming(hex_a: Column, hex_b: Column) -> Column:
    """Bits in which two 64-bit hashes in hexadecimal differ."""
    number = lambda x: F.conv(x, 16, -10).cast("long")
    return F.bit_count(number(hex_a).bitwiseXOR(number(hex_b)))


def sparse_positive(weights: Column) -> Column:
    return F.map_filter(weights, lambda k, v: v > 0)
