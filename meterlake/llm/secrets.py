"""Secret scans: three kinds of patterns, and password guess costs for values that stand after a credential word.

The guess cost of a value is the least number of guesses over all ways to cut it into words, dates, repeats, keyboard
walks, character runs and spans that only brute force finds. Values that cost at least `GUESSES` are secrets of kind
`guess`, also when no pattern knows them. Words are those that guessers try first, then all words of the scanned texts by
their counts, without the values themselves; a word's rank is one more than the words counted more often. No word list
leaves the executors: what may be a word in a value is joined to the table of all counts, and every different value is
costed once. A credential word begins after no letter or digit, or where lower case or a digit turns to upper case. A
quoted value goes up to its closing quote in the line, spaces included.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned one by one; empty tables give
no rows; extra columns are ignored; texts and values may be of any length. Spans count code points, ends excluded, and are
sorted by start, then kind.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import picked
from meterlake.session import durable


def either_case(word: str) -> str:
    """ASCII letters in either case; flags would also match look-alikes beyond ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)


KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    "(?:" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?:"
    + either_case("passphrase|password|passwd|pwd|pass|pin|secret|token|credentials?|auth|login|(?:api|access|private|secret)[_ -]?key")
    + r""")["']?\s{0,3}(?:[:=]|=>|\sis\s)\s{0,3}"""
    + r"""(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|`([^`\n]+)`|["'`]?([^\s"'`,;|<>(){}\[\]]+))"""
)
GUESSES = 1e9
PART = 0.5  # log10 of the kinds a part may have
HEX_AS_0 = bytes.maketrans(b"123456789abcdef", b"0" * 15)
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
CREDENTIAL = (*ASSIGNED, "pass", "pwd", "pin", "credential", "auth", "login", "key")

# Words that guessers try first, most common first.
COMMON = (
    "password 123456 qwerty admin welcome letmein login secret token master dragon monkey football baseball shadow sunshine "
    "princess superman batman trustno iloveyou hello freedom whatever michael jordan hunter summer winter spring autumn "
    "monday friday january december love money test guest user root default change changeme example demo sample server "
    "system public private access account company office internet computer abc xyz key pass my the and you your "
    # and those of plain sentences and settings
    "invalid required optional incorrect missing wrong empty correct needed stored encrypted hashed changed forgotten reset "
    "expired string null none true false not valid unknown disabled enabled hidden protected never always shown"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("@4301$57!", "aaeoissti")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
RANK = {w: r + 1 for r, w in enumerate(COMMON)}
WORD = re.compile(r"[^\W\d_]{3,24}")  # letters only
LETTERS = re.compile(r"[^\W\d_]{3,}")
LONGEST = 24
CHUNK = 50_000  # rows of a batch


def _neighbours() -> dict[str, set[str]]:
    place = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    near = lambda a, b: a != b and abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1
    return {c: {d for d in place if near(place[c], place[d])} for c in place}


NEAR = _neighbours()


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def _matches(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """First, last (excluded) and log10 guesses of every span with a pattern."""
    lower = value.lower()
    plain = lower.translate(LEET) if len(lower) == len(value) else value
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            if rank := ranks.get(lower[i:j] if len(lower) == n else value[i:j]) or ranks.get(plain[i:j]):
                cased = 1 + sum(c.isupper() for c in value[i:j])
                yield i, j, math.log10(rank * cased * (1 if lower[i:j] in ranks else 4))
        if m := DATE.match(value, i):
            yield i, m.end(), math.log10(365 * 120 * 4 if m.end() - i > 4 else 120)
    for period in (1, 2, 3, 4):
        i = 0
        while i + 2 * period <= n:
            j = i + period
            while j < n and value[j] == value[j - period]:
                j += 1
            times = (j - i) // period
            if times >= 2 and times * period >= 3:
                unit = sum(math.log10(_alphabet(c)) for c in value[i : i + period])
                yield i, i + times * period, unit + math.log10(times)
                i = j - period + 1
            else:
                i += 1
    steps = [(lower[k + 1] in NEAR.get(lower[k], ()), ord(value[k + 1]) - ord(value[k])) for k in range(n - 1)] if len(lower) == n else []
    for what in (0, 1):  # walks on the keyboard; runs of the alphabet
        i = 0
        while i < len(steps):
            j = i
            while j < len(steps) and (steps[j][0] if what == 0 else steps[j][1] in (1, -1) and steps[j][1] == steps[i][1]):
                j += 1
            if j - i >= 2:
                length = j - i + 1
                yield i, j + 1, math.log10(47 * length * (5 if what == 0 else 2)) + (0.5 * (length - 3) if what == 0 else 0)
            i = max(j, i + 1)


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses of the cheapest segmentation; every part costs a choice of its kind besides its guesses."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _matches(value, ranks):
        ends.setdefault(j, []).append((i, cost))
    best, brute = [0.0], [math.inf]  # of all ways to cut the first j characters; of those that end in brute force
    for j, c in enumerate(value, 1):
        brute.append(min(brute[-1], best[-1] + PART) + math.log10(_alphabet(c)))
        best.append(min(brute[-1], *(best[i] + PART + cost for i, cost in ends.get(j, ())), math.inf))
    return best[-1]


def values(text: str, lower: str) -> Iterator[tuple[int, int]]:
    """First and last (excluded) of what stands after credential words."""
    for m in CONTEXT.finditer(text) if any(map(lower.__contains__, CREDENTIAL)) else ():
        value = m[m.lastindex] if m.lastindex < 4 else m[4].rstrip(".!?:")
        yield m.start(m.lastindex), m.start(m.lastindex) + len(value)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order and apart from each other."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans as (start, kind, end) in order, and the values after credential words that meet none of them."""
    spans: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(map(lower.__contains__, ASSIGNED)):  # plain searches first: most texts have none of the words
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"0" * 32 in text.encode("utf-8", "surrogatepass").translate(HEX_AS_0):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken = merged(spans)
    starts = [a for a, _ in taken]
    free = []
    for first, last in values(text, lower):
        before = bisect_left(starts, last) - 1  # of the base spans only the last that starts before the value's end can meet it
        if first < last and (before < 0 or taken[before][1] <= first):
            free.append((first, last))
    return sorted(spans), free


def scan_text(text: str, ranks: dict[str, int] = RANK) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret of one text, sorted by start, then kind, with the words of `ranks` alone."""
    spans, free = spans_of(text)
    spans += [(a, 3, b) for a, b in free if guess_cost(text[a:b], ranks) >= math.log10(GUESSES)]
    return [(a, KINDS[k], b) for a, k, b in sorted(spans)]


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
FREE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("key", pa.string()), ("value", pa.string())]))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and free values of each row, numbered by task; a value's key is its hash."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        base, free = [], []
        for text in batch.column("text").to_pylist():
            spans, found = spans_of(text or "")
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            cut = [(a, b, text[a:b]) for a, b in found]
            free.append([{"start": a, "end": b, "key": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "value": v} for a, b, v in cut])
        numbers = pa.array(range(row, row + len(batch)), pa.int64())
        row += len(batch)
        yield pa.RecordBatch.from_arrays([numbers, batch.column("id"), pa.array(base, SPAN), pa.array(free, FREE)], names=["row", "id", "base", "free"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a batch with their counts; values after credential words do not vouch for themselves."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            lower = (text or "").lower()
            counts.update(WORD.findall(lower))
            for first, last in values(text or "", lower):
                counts.subtract(WORD.findall(text[first:last].lower()))
        found = [(w, n) for w, n in counts.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])


def corpus_words(texts: DataFrame) -> DataFrame:
    """Every word of all texts with its rank: one more than the words that are counted more often.

    The window without partitions sees one row per different count, of which there are fewer than the square root of twice
    the words."""
    counted = durable(texts.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    before = F.sum("words").over(Window.orderBy(F.desc("n"))) - F.col("words")
    ranks = durable(sizes.select("n", (before + len(RANK) + 1).alias("rank")))
    return counted.join(ranks, "n").select("word", "rank")


def may_be_words(value: str) -> Iterator[str]:
    """All that the costs look up in the ranks and that can be a word of a text."""
    lower = value.lower()
    forms = {lower, lower.translate(LEET)} if len(lower) == len(value) else {value}
    for form in forms:
        for run in LETTERS.finditer(form):
            for i in range(run.start(), run.end() - 2):
                for j in range(i + 3, min(run.end(), i + LONGEST) + 1):
                    yield form[i:j]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(key: str, words: set[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.string()), pa.array(list(words), pa.string())], names=["key", "word"])

    for batch in batches:
        for key, value in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist()):
            words: set[str] = set()
            for word in may_be_words(value):
                words.add(word)
                if len(words) == CHUNK:  # a word may come again in a later chunk of a long value
                    yield out(key, words)
                    words = set()
            if words:
                yield out(key, words)


def _strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = []
        for key, value, known in zip(*(batch.column(c).to_pylist() for c in ("key", "value", "known"))):
            ranks = {k["word"]: k["rank"] for k in known or ()} | RANK
            if guess_cost(value, ranks) >= math.log10(GUESSES):
                keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])


def strong_values(values: DataFrame, words: DataFrame) -> DataFrame:
    """Keys of the values (key, value; each once) that cost at least `GUESSES`.

    A value's own words meet in one row: at most as many as it has spans of letters."""
    candidates = values.mapInArrow(_candidates, "key string, word string")
    known = candidates.join(words, "word").groupBy("key").agg(F.collect_set(F.struct("word", "rank")).alias("known"))
    return durable(values.join(known, "key", "left").mapInArrow(_strong, "key string"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id` and found: the secrets of each text as kind, start and end."""
    rows = picked(docs, id=id, text=text)
    item = "array<struct<start:int,kind:int,end:int>>"
    free = "array<struct<start:int,end:int,key:string,value:string>>"
    spans = durable(rows.mapInArrow(_spans, f"row long, id {rows.schema['id'].dataType.simpleString()}, base {item}, free {free}"))
    each = spans.select("row", F.explode("free").alias("v")).select("row", "v.*")
    values = durable(each.groupBy("key").agg(F.first("value").alias("value")))
    strong = strong_values(values, corpus_words(rows.select("text")))
    hit = F.struct("start", F.lit(KINDS.index("guess")).alias("kind"), "end")
    hits = durable(each.join(strong, "key", "left_semi").groupBy("row").agg(F.collect_list(hit).alias("hits")))
    every = F.array_sort(F.concat("base", F.coalesce("hits", F.expr(f"cast(array() as {item})"))))
    names = F.array(*map(F.lit, KINDS))
    found = F.transform(every, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return spans.join(hits, "row", "left").select(F.col("id").alias(id), found.alias("found"))
