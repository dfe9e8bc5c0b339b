"""Secret scans: base patterns, and guess costs of values that stand in a credential context.

scan() returns every span of every whole text. Base kinds are leftmost, non-overlapping matches of one pattern each;
`credential` spans come from the method: a value that follows a credential word is segmented at minimum guess cost
into words, dates, repeats, keyboard walks and brute-force spans, and is a span where its cost reaches a threshold.
Words are ranked: some common passwords first, then those of ranked word lists, given as files of public tokenizers.

Nulls and empty texts have no spans. Rows are independent: repeated rows give equal results, an empty table an empty
result, and columns other than the named ones are ignored.
"""

from __future__ import annotations

import base64
import json
import math
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, text_of

#: Span kinds in the order in which spans at one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "credential")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 8
#: A run that is long enough: the maximal run of the base pattern, its minimum length put into the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CREDENTIAL = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private)[_-]?key)["']?[ \t]*(?:[:=]|\bis\b)[ \t]*["']?([^\s"'<>]+)""", re.IGNORECASE | re.ASCII)
#: A text without any of these, in lower case, has no assign or credential match.
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key")

#: Common passwords and words in them, most frequent first.
COMMON = """password qwerty admin welcome letmein dragon monkey master login princess sunshine football baseball shadow
superman batman trustno hello freedom whatever secret iloveyou charlie michael jordan jennifer hunter ranger buster
soccer hockey killer george andrew thomas robert daniel jessica ashley summer winter spring autumn flower cookie
pepper ginger cheese coffee orange banana computer internet service server root user test guest default changeme
example sample dummy placeholder demo temp null none token key api auth pass access private public system manager
office company oracle mysql linux windows google apple amazon data cloud home house love money magic lucky star
tiger eagle wolf bear lion horse snake panda angel devil silver golden black white green blue red purple pink
""".split()
#: The longest word, and the longest unit of a repeat.
LONGEST, UNIT = 24, 8
#: Look-alikes of letters.
LEET = str.maketrans("4@8(3610!5$7+2", "aabcegioisstt" + "z")
#: Rows of a keyboard, and the orders in which keys are walked.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in ROWS for a, b in zip(row, row[1:])}
NEXT |= {(upper[at], lower[at + by]) for upper, lower in zip(ROWS[:2], ROWS[1:3]) for at in range(len(upper)) for by in (-1, 0) if 0 <= at + by < len(lower)}
MONTH, DAY = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])"
#: Dates with a year before or after, and years, with the log10 of their guesses: 130 years.
DATES = [
    (re.compile(rf"(?:19|20)[0-9][0-9][-/._]?{MONTH}[-/._]?{DAY}"), math.log10(130 * 366)),
    (re.compile(rf"{DAY}[-/._]?{MONTH}[-/._]?(?:19|20)[0-9][0-9]"), math.log10(130 * 366)),
    (re.compile(r"(?:19|20)[0-9][0-9]"), math.log10(130)),
]

#: log10 of the guesses: for a step from one segment to the next, and for a brute-force character by class.
STEP = math.log10(2)
DIGIT, LETTER, OTHER = 1.0, math.log10(26), math.log10(33)
#: log10 of the guesses from which a value counts as a secret.
SECRET_COST = 9.0


def brute_cost(char: str) -> float:
    return DIGIT if char.isdigit() else LETTER if char.isalpha() else OTHER


@lru_cache(maxsize=4)
def ranks(lists: tuple[str, ...] = ()) -> dict[str, int]:
    """Words with their ranks from 1: COMMON, then those that end a word in these vocabularies, by their place there.

    A list is a file of the tokenizers library, whose words end in `</w>`, or of ranks for tiktoken, where they begin
    with a blank.
    """
    out = {word: at + 1 for at, word in reversed(list(enumerate(COMMON)))}
    for path in lists:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as file:
                vocabulary = json.load(file)["model"]["vocab"]
            words = [token.removesuffix("</w>") for token in sorted(vocabulary, key=vocabulary.get) if token.endswith("</w>")]
        else:
            with open(path, "rb") as file:
                coded = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file))
            words = [token[1:].decode(errors="replace").lower() for _, token in coded if token.startswith(b" ")]
        kept = (word for word in words if word.isalpha() and 3 <= len(word) <= LONGEST)
        for at, word in enumerate(kept, len(COMMON) + 1):
            out[word] = min(at, out.get(word, at))
    return out


class _Starts:
    """Where segments of one run may start, with the cost before; only starts that can be best for some later end.

    A segment's cost grows with the logarithm of its length in units, `least` at least, so an earlier start stays better
    than a later one if it is so at the later one's first end. That counts from the next start on: only then does
    whatever ends the run for the earlier one end it for the later one too.
    """

    def __init__(self, least: int, unit: int = 1):
        self.least, self.unit, self.starts = least, unit, []

    def add(self, start: int, before: float) -> None:
        if len(self.starts) > 1:
            last, cost = self.starts[-1]
            own = cost + math.log10(self.least)
            if any(other + math.log10((last - at) // self.unit + self.least) <= own for at, other in self.starts[:-1]):
                self.starts.pop()
        self.starts.append((start, before))

    def keep_from(self, first: int) -> None:
        if self.starts and self.starts[0][0] < first:
            self.starts = [each for each in self.starts if each[0] >= first]


def _lower(value: str) -> str:
    """value in lower case, character by character, so that places stay; those whose lower case is longer as they are."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


@lru_cache(maxsize=4096)
def _unit_cost(unit: str, lists: tuple[str, ...]) -> float:
    return guess_cost(unit, lists)[0]


def guess_cost(value: str, lists: tuple[str, ...] = ()) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses that value takes, and its segments (start, end, kind) at that cost.

    The segmentation of least total cost; every segment but the first costs one more factor of two. Segments are words;
    dates; repeats, three equal characters or more, or a unit of 2 to UNIT characters twice or more, at the unit's cost
    times the number; walks over three neighbouring keys or more; and brute-force spans, whose characters add up one by
    one. The work grows with the length: of the starts of repeats and walks only those are kept that can be best. Ties
    go to the segment found first.
    """
    n, low = len(value), _lower(value)
    plain, rank = low.translate(LEET), ranks(lists)
    #: By position: the least cost, where the last segment starts and its kind, with a segment ending there and with a brute-force span.
    best = [[(math.inf, 0, "", False), (math.inf, 0, "", True)] for _ in range(n + 1)]
    best[0][0] = (0.0, 0, "", False)
    walks = _Starts(3)
    repeats = {p: [_Starts(3 if p == 1 else 2, p) for _ in range(p)] for p in range(1, min(UNIT, n // 2) + 1)}

    def offer(start: int, end: int, cost: float, kind: str) -> None:
        if cost < best[end][False][0]:
            best[end][False] = (cost, start, kind, best[start][True][0] < best[start][False][0])

    for at in range(n + 1):
        for start, before in walks.starts:
            if at - start >= 3:
                offer(start, at, before + math.log10(47) + math.log10(at - start), "walk")
        for p, by_place in repeats.items():
            for start, before in by_place[at % p].starts:
                if at - start >= (3 if p == 1 else 2 * p):
                    offer(start, at, before + _unit_cost(low[start : start + p], lists) + math.log10((at - start) // p), "repeat")
        if at == n:
            break
        brute = best[at][True][0] < best[at][False][0]
        before = best[at][brute][0] + (STEP if at else 0.0)
        if at and (low[at - 1], low[at]) not in NEXT:  # no walk goes on
            walks.keep_from(at)
        walks.add(at, before)
        for p, by_place in repeats.items():
            if at >= p and low[at] != low[at - p]:
                for each in by_place:
                    each.keep_from(at - p + 1)
            by_place[at % p].add(at, before)
        for end in range(at + 3, min(n, at + LONGEST) + 1):
            for form, extra in ((low, 0.0), (plain, 1.0)):
                if found := rank.get(form[at:end]):
                    case = 0.0 if value[at:end].islower() else 0.5
                    offer(at, end, before + math.log10(found + 1) + case + extra * (low[at:end] != plain[at:end]), "word")
        for pattern, cost in DATES:
            if m := pattern.match(value, at):
                offer(at, m.end(), before + cost, "date")
        for spans in (False, True):
            cost = best[at][spans][0] + brute_cost(value[at]) + (0.0 if spans or not at else STEP)
            if cost < best[at + 1][True][0]:
                best[at + 1][True] = (cost, at, "brute", spans)
    brute = best[n][True][0] < best[n][False][0]
    total, path, at = best[n][brute][0], [], n
    while at:
        _, start, kind, brute = best[at][brute]
        if path and kind == "brute" == path[-1][2]:
            path[-1] = (start, path[-1][1], kind)
        else:
            path.append((start, at, kind))
        at = start
    return total, path[::-1]


def find_spans(text: str, secret_cost: float = SECRET_COST, lists: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    found = [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(hint in low for hint in HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        found += [("credential", *m.span(1)) for m in CREDENTIAL.finditer(text) if guess_cost(m[1], lists)[0] >= secret_cost]
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", secret_cost: float = SECRET_COST, lists: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kinds, starts, ends): a text's spans as three arrays, by start, then kind."""

    def kernel(batch: pa.RecordBatch) -> dict:
        spans = [find_spans(text, secret_cost, lists) for text in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0)} | {name: [[span[at] for span in each] for each in spans] for at, name in enumerate(("kinds", "starts", "ends"))}

    return map_rows(df.select(F.col(id_column).cast("long"), text_of(text_column)), "doc_id long, kinds array<string>, starts array<long>, ends array<long>", kernel)


def redact_text(text: str, secret_cost: float = SECRET_COST, mask: str = "[SECRET]", lists: tuple[str, ...] = ()) -> str:
    """text with every stretch of overlapping spans replaced by mask."""
    out, at = [], 0
    for start, end in merged([(start, end) for _, start, end in find_spans(text, secret_cost, lists)]):
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def redact(df: DataFrame, text_column: str = "text", secret_cost: float = SECRET_COST, lists: tuple[str, ...] = ()) -> DataFrame:
    """df with secrets masked in its text, all its columns kept; a null text stays null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: text if text is None else redact_text(text, secret_cost, lists=lists))

    return small_batches(df).withColumn(text_column, masked(F.col(text_column)))
