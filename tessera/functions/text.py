"""Text functions over messages and model outputs, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.converters import blank

#: The hazard categories that a guard model names.
CATEGORY = r"\b(S(?:1[0-3]|[1-9]))\b"
TOOLS = r"(?is)<tools>.*?</tools>"
#: White space that Python's strip() removes, of ASCII.
SPACE = " \t\r\n\f\x0b"


def flattened(messages: Column) -> Column:
    """"role: content" by line, blank messages left out."""
    kept = F.filter(messages, lambda m: ~blank(F.coalesce(m["content"], F.lit(""))))
    return F.array_join(F.transform(kept, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def rendered(messages: Column, tools: Column | None = None) -> Column:
    """"[ROLE]: content" by blank-line separated parts, with a list of tools behind, as a judge reads it."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]: "), F.coalesce(m["content"], F.lit(""))))
    if tools is not None:
        parts = F.when(F.coalesce(F.size(tools), F.lit(0)) > 0, F.concat(parts, F.array(F.concat(F.lit("[TOOLS]: "), F.array_join(tools, ", "))))).otherwise(parts)
    return F.array_join(parts, "\n\n")


def guard_chat(messages: Column, answer: Column | None = None) -> Column:
    """Messages for a guard model: blank ones dropped, system texts put before the first user message, an answer appended."""
    kept = F.filter(messages, lambda m: ~blank(F.coalesce(m["content"], F.lit(""))))
    system = F.array_join(F.transform(F.filter(kept, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")
    others = F.filter(kept, lambda m: m["role"] != "system")
    first = F.array_position(F.transform(others, lambda m: m["role"]), "user") - 1
    merged = F.transform(others, lambda m, i: F.when((i == first) & (system != ""), F.struct(m["role"].alias("role"), F.concat(system, F.lit("\n\n"), m["content"]).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    if answer is None:
        return merged
    more = F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return F.when(blank(F.coalesce(answer, F.lit(""))), merged).otherwise(F.concat(merged, more))


def guard_verdict(output: Column) -> Column:
    """UNSAFE or SAFE by the first line, null if it says neither."""
    line = F.lower(F.trim(F.split_part(F.trim(output, F.lit(SPACE)), F.lit("\n"), F.lit(1))))
    return F.when(F.contains(line, F.lit("unsafe")), "UNSAFE").when(F.contains(line, F.lit("safe")), "SAFE")


def guard_categories(output: Column) -> Column:
    """Distinct hazard categories in the order of text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(output, F.lit(CATEGORY), 1)))


def judge_verdict(output: Column) -> Column:
    text = F.upper(output)
    return F.when(F.contains(text, F.lit("UNSAFE")), "UNSAFE").when(F.contains(text, F.lit("SAFE")), "SAFE")


def without_tools(text: Column) -> Column:
    return F.regexp_replace(text, TOOLS, "")


def more_bytes(text: str) -> Column:
    """How many bytes a text column has beyond one a character; null has none."""
    return F.coalesce(F.octet_length(text) - F.length(text), F.lit(0))


def chunks(text: Column, size: int) -> Column:
    """Pieces of size characters without overlap; an empty text has none."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.expr("cast(array() as array<string>)"))


def chat_template(messages: Column, generation: bool = True) -> Column:
    """A fixed, documented template: a line with the role in angle brackets, the content, an end mark; then an open assistant line."""
    turns = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|end|>\n"))), "")
    return F.concat(turns, F.lit("<|assistant|>\n")) if generation else turns


def json_or_raw(text: Column) -> Column:
    """The text if it is JSON, else an object that holds it."""
    return F.when(text.isNull() | F.try_parse_json(text).isNotNull(), text).otherwise(F.to_json(F.struct(text.alias("raw"))))


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds as far as needed: 1h 2m, 2m 3s, 3s."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s >= 3600, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).when(s >= 60, F.concat(m.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def html_escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def opacity(weight: Column, p99: Column, most: float = 0.9) -> Column:
    """How strongly a weight is drawn: its log against that of the 99th percentile, at most `most`."""
    return F.when(p99 <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(most), F.log1p(weight) / F.log1p(p99) * most)))


def semantic(token: Column, special: tuple[str, ...] = ("<s>", "</s>", "<pad>", "<unk>")) -> Column:
    """Whether a token is neither blank nor special."""
    return ~blank(token) & ~token.isin(*special)


def feature_url(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def from_end(position: Column, n: Column) -> Column:
    return F.when(position < 0, n + position).otherwise(position)


def has_content(messages: Column, text: Column, *ids: Column) -> Column:
    """Whether a prompt is valid: its ids aren't empty, and it has messages or a text."""
    some = (F.coalesce(F.size(messages), F.lit(0)) > 0) | (F.coalesce(text, F.lit("")) != "")
    for i in ids:
        some = some & (F.coalesce(i, F.lit("")) != "")
    return some
