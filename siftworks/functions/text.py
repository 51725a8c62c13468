"""Similarity, entropy, hashes, token estimates and JSON repair."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import detect

#: Fixed value: a fenced block of an answer.
FENCE = r"(?is)```(?:json)?\s*(.*?)```"

#: Fixed value: a key without quotes.
UNQUOTED_KEY = r"([{,]\s*)([A-Za-z_$][A-Za-z0-9_$]*)(\s*:)"

#: What may follow a backslash in JSON, and the control characters that get one.
ESCAPED = '"\\/bfnrtu'
CONTROLS = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}

#: Strings, which may lack their end, and what lies between them.
PIECES = re.compile(r'(?s)"(?:[^"\\]|\\.)*(?:(?P<end>")|\\?\Z)|[^"]+')

#: Fixed value: characters that count as one token.
CHARS_PER_TOKEN = 4


def bigrams(value: Column) -> Column:
    n = F.length(value)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(value, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the multisets of letter pairs; 1 for equal texts, 0 for short ones."""
    x, y = bigrams(a), bigrams(b)
    count = lambda grams, g: F.size(F.filter(grams, lambda h: h == g))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


def prompt_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long")


def with_cost(df: DataFrame, prices: DataFrame, model: str = "model", prompt: str = "prompt_tokens", completion: str = "completion_tokens") -> DataFrame:
    """``df`` with ``cost_usd`` by ``prices`` (``model, prompt_price, completion_price`` for a thousand tokens); null for a model without price.

    The prices are a small fixed list, so they are broadcast.
    """
    listed = F.broadcast(prices.select(F.col("model").alias("_model"), "prompt_price", "completion_price"))
    cost = F.col(prompt) / 1000 * F.col("prompt_price") + F.col(completion) / 1000 * F.col("completion_price")
    return df.join(listed, F.col(model) == F.col("_model"), "left").withColumn("cost_usd", cost).drop("_model", "prompt_price", "completion_price")


def completion_tokens(records: Column, each: int = 60) -> Column:
    """The tokens an answer about so many records is thought to need."""
    return (F.greatest(records, F.lit(0)) * each).cast("long")


def answer_problem(text: Column) -> Column:
    """``EMPTY_RESPONSE`` or ``JSON_PARSE_FAILED`` of an answer, or null."""
    said = lambda t: F.when(F.coalesce(t, F.lit("")) == "", "EMPTY_RESPONSE").when(F.try_parse_json(_isolated(_unfenced(t))).isNull(), "JSON_PARSE_FAILED")
    return detect.let(detect.trim(text), said)


def round_half_up(value: Column) -> Column:
    """Halves go up, negative ones too."""
    return F.floor(value + 0.5)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def header_name(header: Column) -> Column:
    """Lower case, letters and digits only, joined by underscores; ``column`` if nothing is left.

    Expects composed text; see ``rules.nfc``.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace(header, r"[^\p{L}\p{N}]+", "_")), r"^_+|_+\z", "")
    return F.when(bare == "", F.lit("column")).otherwise(bare)


def _unfenced(trimmed: Column) -> Column:
    """The first fenced block of a trimmed answer, trimmed, else the answer."""
    return F.when(trimmed.rlike(FENCE), detect.let(F.regexp_extract(trimmed, FENCE, 1), detect.trim)).otherwise(trimmed)


def _isolated(inner: Column) -> Column:
    """From the first opening bracket to the last closing one of its kind; all of it where there are none."""

    def between(inner: Column, first: Column) -> Column:
        closer = F.when(F.substring(inner, first, F.lit(1)) == "{", F.lit("}")).otherwise(F.lit("]"))
        last = F.length(inner) - F.when(closer == "}", F.locate("}", F.reverse(inner))).otherwise(F.locate("]", F.reverse(inner))) + 1
        return detect.let(last, lambda last: F.when((first > 1) & inner.contains(closer) & (last >= first), F.substring(inner, first, last - first + 1)).otherwise(inner))

    def opened(brace: Column, bracket: Column) -> Column:
        return F.when(brace == 0, bracket).when(bracket == 0, brace).otherwise(F.least(brace, bracket))

    return detect.let(inner, lambda i: detect.let(opened(F.locate("{", i), F.locate("[", i)), lambda first: between(i, first)))


def json_candidate(text: Column) -> Column:
    """What may be JSON in an answer: the first fenced block, else all of it, without prose around the brackets."""
    return detect.let(detect.trim(text), lambda t: _isolated(_unfenced(t)))


def answer_diagnostics(text: Column) -> Column:
    """Codes of what was taken off an answer, and of what is wrong with the rest.

    Each step is evaluated once: an expression that names the one before
    several times would repeat all of it, at every step anew.
    """

    def codes(trimmed: Column, inner: Column, candidate: Column) -> Column:
        blank = F.coalesce(trimmed, F.lit("")) == ""
        return F.array(
            F.when(blank, "EMPTY_RESPONSE"), F.when(trimmed.rlike(FENCE), "MARKDOWN_CODE_BLOCK_STRIPPED"),
            F.when(candidate != inner, "SURROUNDING_TEXT_STRIPPED"), F.when(~blank & F.try_parse_json(candidate).isNull(), "JSON_PARSE_FAILED"),
        )

    listed = detect.let(detect.trim(text), lambda t: detect.let(_unfenced(t), lambda i: detect.let(_isolated(i), lambda c: codes(t, i, c))))
    return F.filter(listed, lambda c: c.isNotNull())


def _no_constant(name: str):
    raise ValueError(name)


def _repaired(text: str) -> tuple[bool, str | None, list[str]]:
    """Strict JSON from nearly valid text, and what was done to it; the text of a repair that failed, too."""
    done: dict[str, None] = {}

    def replaced(code: str, pattern: str, new, old: str) -> str:
        out = re.sub(pattern, new, old)
        if out != old:
            done.setdefault(code)
        return out

    def inside(m: re.Match) -> str:
        if m[0] in CONTROLS:
            done.setdefault("CONTROL_CHARACTER_ESCAPED")
            return CONTROLS[m[0]]
        if m[1] in ESCAPED:
            return m[0]
        done.setdefault("INVALID_ESCAPE_FIXED")
        return "\\" + m[0]

    out = replaced("SMART_QUOTES_NORMALIZED", "[\u201c\u201d]", '"', text)
    out = replaced("UNQUOTED_KEY_QUOTED", UNQUOTED_KEY, r'\1"\2"\3', out)
    parts, stack = [], []
    for piece in PIECES.finditer(out):
        part = piece[0]
        if part[0] == '"':
            part = '"' + re.sub(r"(?s)\\(.)|[\n\r\t]", inside, part[1:])
            if not piece["end"]:
                part += '"'
                done.setdefault("UNTERMINATED_STRING_CLOSED")
        else:
            part = replaced("TRAILING_COMMA_REMOVED", r",(?=\s*[}\]])", "", part)
            for c in part:
                if c in "{[":
                    stack.append("}" if c == "{" else "]")
                elif c in "}]" and stack:
                    stack.pop()
        parts.append(part)
    if stack:
        parts += reversed(stack)
        done.setdefault("UNBALANCED_BRACKETS_CLOSED")
    if not done:
        return False, None, []
    fixed = "".join(parts)
    try:
        json.loads(fixed, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False, fixed, list(done)
    return True, fixed, list(done)


@F.pandas_udf(T.StructType().add("success", "boolean").add("text", "string").add("repairs", T.ArrayType(T.StringType())))
def repair_json(texts: pd.Series) -> pd.DataFrame:
    """Repairs of nearly valid JSON; ``success`` only if something was repaired and the result parses."""
    rows = [(False, None, []) if t is None else _repaired(t) for t in texts]
    return pd.DataFrame(rows, columns=["success", "text", "repairs"])
