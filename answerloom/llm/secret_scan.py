"""Secrets in whole texts: three plain kinds, and passwords by the cost of guessing them.

The plain kinds are assignments to names such as token, access keys, and long runs of hex
digits. Beyond those, values in a credential context (a name such as password, key or
auth, a sign of assignment, a value) are priced: the cheapest cut of the value into
dictionary words, dates, repeats, keyboard walks and brute-force spans gives the
number of guesses an informed attacker needs, by dynamic programming. Dictionary words are those of COMMON, then the
words of the scanned table by the share of its distinct texts they stand in: copies of a text count once, so a table
and the same table doubled give the same verdicts. What stands as a value in a credential context does not count, so a
secret that leaked into many texts does not become a word by that. Values of
MIN_GUESSES guesses (as a power of ten) or more are spans of the kind `guess`.

Spans count code points, the end excluded. NULL and empty texts have none. Repeated rows
are scanned alike; an empty table gives an empty result.
"""

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.linking import small_side
from answerloom.session import settle

#: Fixed forms of the plain kinds, and the least length of what counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    # Names start after something else than a letter, or with a capital after a small one.
    r"""(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"""
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|secret)[_\x20-]?key)"""
    r"""["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;<>|]+))""", re.ASCII | re.IGNORECASE
)
CONTEXT_NAMES = ("pass", "pwd", "secret", "token", "credential", "auth", "key")
MIN_GUESSES = 10.0

#: Words in order of how often they stand in passwords.
COMMON = (
    "password", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "qwerty", "hello", "secret", "sunshine",
    "princess", "football", "baseball", "shadow", "superman", "michael", "jordan", "summer", "winter", "spring", "autumn",
    "test", "guest", "user", "root", "default", "changeme", "example", "token", "pass", "love", "iloveyou", "freedom", "access",
    "the", "and", "this", "that", "with", "your", "none", "null", "true", "false", "value", "string", "name", "server",
)
_UNITS = float(1 << 30)


class Ranks(dict):
    """Words of three letters or more to their ranks, and their first three letters."""

    def __init__(self, words):
        super().__init__(words)
        self.heads = {word[:3] for word in self}


RANK = Ranks({word: k + 1 for k, word in enumerate(COMMON)})
#: Words of the table: of LETTERS letters, in WORD_SHARE of the distinct texts and in WORD_TEXTS of them at least; at most
#: the DICTIONARY most frequent ones, about 100 bytes each in every task.
WORD_SHARE, WORD_TEXTS, DICTIONARY, LETTERS = 1e-4, 3, 100_000, (3, 24)
LONGEST = LETTERS[1]
LEET = str.maketrans("4@31!0$57", "aaeiiosst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
KEYS, TURNS = len(PLACE), 4.6
YEARS = range(1900, 2050)
DATE = re.compile(r"(\d{4})([-/.]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.]?)(\d{1,2})\6(\d{4})|(?:19|20)\d\d")
# Each further span doubles the guesses.
SPAN = math.log10(2)


def _neighbours(a: str, b: str) -> bool:
    if a == b or a not in PLACE or b not in PLACE:
        return False
    (x, y), (u, v) = PLACE[a], PLACE[b]
    return abs(y - v) <= 1 and abs(x - u) <= 1


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log10(26)
    return math.log10(33 if c.isascii() else 100)


def _date_cost(text: str) -> float | None:
    """Log10 of guesses for a calendar date or a year; None for other texts."""
    found = DATE.fullmatch(text)
    if not found:
        return None
    year, month, day = found[1] or found[8], found[3] or found[5], found[4] or found[7]
    if year is None:
        return math.log10(len(YEARS))
    if int(year) not in YEARS or not (1 <= int(month) <= 31 and 1 <= int(day) <= 31 and min(int(month), int(day)) <= 12):
        return None
    return math.log10(len(YEARS) * 366) + (0.6 if found[2] or found[6] else 0.0)


def guesses(value: str, ranks: dict[str, int] = RANK) -> float:
    """Log10 of the guesses that the cheapest segmentation of a value costs; 0 for an empty one.

    Brute-force spans cost their characters; a run of spans costs a factor of two per span.
    Spans other than brute force: words (also with capitals or look-alike signs), dates, runs of one character or of a
    repeated block of up to eight characters, and walks over neighbouring keys. Every span is tried from each start,
    shorter parts of runs and walks too. Of the starts inside a run or walk only those are kept that can still be
    the cheapest for some end (`_Runs`), which are few, so the work is in proportion to the length.
    """
    n = len(value)
    heads = ranks.heads if isinstance(ranks, Ranks) else Ranks(ranks).heads
    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(LEET)
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    brute = [0.0] * (n + 1)
    for k, c in enumerate(value):
        brute[k + 1] = brute[k] + _char_cost(c)
    blocks = [_Runs(size, max(2, 2 // size + 1)) for size in range(1, 9)]
    walks = _Runs(1, 3)
    walk_cost = math.log10(KEYS) + TURNS / 4
    cheapest_start = 0.0  # least best[j] - brute[j], so that a brute-force span needs no inner loop
    for at in range(n + 1):
        # `at` is final once all spans that end there are known; brute force ends everywhere.
        if at:
            found = min(best[at], cheapest_start + brute[at] + SPAN)
            for runs in blocks:
                size = runs.step
                if size < at and value[at - 1] == value[at - 1 - size]:
                    if (cost := runs.ending(at, best)) is not None:
                        found = min(found, cost + brute[at] - brute[at - size] + SPAN)
                elif runs.length:
                    runs.clear()
            if at > 1 and _neighbours(lower[at - 2], lower[at - 1]):
                if (cost := walks.ending(at, best)) is not None:
                    found = min(found, cost + walk_cost + SPAN)
            elif walks.length:
                walks.clear()
            best[at] = found
            cheapest_start = min(cheapest_start, found - brute[at])
        if at == n:
            break
        here = best[at]

        def offer(end, cost):
            best[end] = min(best[end], here + cost + SPAN)

        able = lower[at : at + 3] in heads or plain[at : at + 3] in heads
        for size in range(3, min(LONGEST, n - at) + 1) if able else ():
            word, shape = plain[at : at + size], value[at : at + size]
            rank = ranks.get(lower[at : at + size]) or ranks.get(word)
            if rank:
                changed = (shape != shape.lower()) + (shape.lower() != word)
                offer(at + size, math.log10(rank) + 0.6 * changed)
        for size in (4, 6, 7, 8, 9, 10) if value[at].isdigit() else ():
            if at + size <= n:
                cost = _date_cost(value[at : at + size])
                if cost is not None:
                    offer(at + size, cost)
    return best[n]


class _Runs:
    """Starts of spans inside one run of steps of equal size, as far as they can still be the cheapest.

    A span of t steps costs its start and log10(t). Of two starts the later one gains less and less from being
    shorter: if it is no cheaper at its first possible end it never is, and if it costs less by itself the earlier
    one never is again.
    """

    def __init__(self, step: int, least: int):
        self.step, self.least, self.length, self.starts = step, least, 0, {}

    def clear(self):
        self.length = 0
        self.starts.clear()

    def ending(self, at: int, best: list[float]) -> float | None:
        """The least cost of start and length of spans that end at `at`, the run going on there; None if it is too short."""
        self.length += 1
        if self.length < (self.least - 1) * self.step:
            return None
        kept = self.starts.setdefault(at % self.step, [])
        new = at - self.least * self.step
        cost = best[new] + math.log10(self.least)
        known = min((best[k] + math.log10((at - k) // self.step) for k in kept), default=math.inf)
        if cost < known:
            while kept and best[kept[-1]] >= best[new]:
                kept.pop()
            kept.append(new)
            return cost
        return known


def spans(text: str, ranks: dict[str, int] = RANK) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and priced ones, as (start, number of the kind, end), each sorted."""
    low = text.lower()
    plain, priced = [], []
    if any(name in low for name in ASSIGN_NAMES):
        plain += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        plain += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    plain += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(name in low for name in CONTEXT_NAMES):
        for m in CONTEXT.finditer(text):
            k = m.lastindex
            if guesses(m[k], ranks) >= MIN_GUESSES:
                priced.append((m.start(k), 3, m.end(k)))
    return sorted(plain), sorted(priced)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(found))


def dictionary(texts: DataFrame) -> dict[str, int]:
    """Rank of each word of COMMON, then of the words of `texts` by the number of distinct texts they stand in."""
    known = texts.filter(F.length("text") > 0).select("text", F.xxhash64("text").alias("print"))
    copies = settle(known.groupBy("print").agg(F.count("*").alias("copies")).filter("copies > 1"), "copied-texts")
    # Each of n copies counts as 1 / n, in units that sums keep exact.
    part = F.lit(_UNITS) / F.coalesce("copies", F.lit(1))
    prose = F.regexp_replace("text", f"(?i){CONTEXT.pattern}", " ")
    words = F.array_distinct(F.split(F.lower(prose), "[^a-z]+"))
    counts = (
        known.join(small_side(copies), "print", "left")
        .select(F.explode(words).alias("word"), part.alias("part"))
        .filter(F.length("word").between(*LETTERS))
        .groupBy("word").agg(F.round(F.sum("part") / _UNITS, 3).alias("texts"))
    )
    distinct = known.agg(F.count("*").alias("n")).first().n - (copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    least = max(WORD_TEXTS, WORD_SHARE * distinct)
    most = counts.filter(F.col("texts") >= least).orderBy(F.desc("texts"), "word").limit(DICTIONARY).collect()
    ranks = dict(RANK)
    for row in most:
        ranks.setdefault(row.word, len(ranks) + 1)
    return Ranks(ranks)


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            out = []
            for value in batch.column("text"):
                plain, priced = spans(value.as_py() or "", ranks)
                counts = [sum(kind == k for _, kind, _ in plain) for k in range(3)]
                digest = hashlib.sha256(listed(plain).encode()).hexdigest()
                out.append((*counts, digest, listed(plain + priced), len(priced)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, kind) for x, kind in zip(columns, kinds)]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
            )
    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess) of every row.

    spans lists `kind:start:end` by start, then kind; base_sha256 is the SHA-256 of the same list
    of the plain kinds alone.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranks = docs.sparkSession.sparkContext.broadcast(dictionary(texts))
    return texts.mapInArrow(
        _scanner(ranks), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    )
