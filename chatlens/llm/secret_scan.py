"""Secret scan: fixed formats, and guess costs of values in credential contexts.

The guess cost of a value is the least sum, over all ways to cut it into spans, of
each span's cost in log10 of guesses: a word of a ranked dictionary, a date, a repeat of
a shorter block, a walk over neighbouring keys or consecutive characters, or
brute force. A value that stands where credentials stand and costs at least a
threshold is a secret.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
                    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
#: Words before a value that make it a credential, and what may stand between. The first may end any identifier's part,
#: the others begin one; what follows in the identifier is read with them, so that no run of characters is read twice.
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|(?:api|access|private|account|secret|encryption|signing|storage|master|shared|service|client|auth)[ _.-]?key
|(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass|auth(?:orization)?|bearer|login))
(?:(?:[_.-]|[0-9]|(?-i:(?<=[a-z])[A-Z]))[A-Za-z0-9_.-]*+)?+
(?:["']?[\x20\t]*(?::=|=>|[:=]|\bis\b)[\x20\t]*["']?(?:(?:bearer|basic)[\x20\t]+)?+(?=([^\s"'<>,;]+)))?""".replace("\n", ""),
    re.ASCII | re.IGNORECASE)

#: Common passwords, the commonest first. The words of a dictionary come after them.
PASSWORDS = """password welcome login letmein monkey dragon master qwerty secret test guest root user hello sunshine
princess football baseball shadow superman michael trustno iloveyou changeme default access
""".split()
RANK = {w: i + 1 for i, w in enumerate(PASSWORDS)}
#: Letters of a word at least and at most.
SHORT, LONG = 3, 20
LEET = str.maketrans("013457@$!", "oieastasi")
#: Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEXT_KEYS = {c: {r[j] for r in (row, *([ROWS[y - 1]] if y else []), *ROWS[y + 1:y + 2]) for j in (x - 1, x, x + 1) if 0 <= j < len(r)} - {c}
             for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
DATE = re.compile(rf"{_YEAR}([-/.]?){_MONTH}\1{_DAY}|{_DAY}([-/.]?){_MONTH}\2{_YEAR}|{_YEAR}")
#: log10 of: days in two centuries, years in two centuries, keys to start from, ways on from a key, another span.
DAY, YEAR, START, STEP, SPAN = math.log10(73050), math.log10(200), math.log10(47), 0.2, math.log10(4)
#: Characters of a block that repeats; what each further character of the repeat costs; the cost at which counting ends.
BLOCK, AGAIN, ENOUGH = 12, 1e-4, 50.0
_RUN = re.compile(r"(.{1,%d}?)\1{40,}" % BLOCK, re.DOTALL)


@lru_cache(4)
def dictionary(path: str) -> dict[str, int]:
    """Ranks of the common passwords, then of the whole words of a BPE vocabulary (a ``tokenizers`` JSON file with a
    suffix at word ends), which has the more frequent words first."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model["end_of_word_suffix"]
    words = sorted((i, w[:-len(suffix)]) for w, i in model["vocab"].items() if w.endswith(suffix))
    ranks = dict(RANK)
    for _, w in words:
        if SHORT <= len(w) <= LONG and w.isalpha():
            ranks.setdefault(w, len(ranks) + 1)
    return ranks


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33)


def _shortened(value: str) -> tuple[str, int]:
    """``value`` without the middles of very long repeats, and how many characters these had.

    Nothing else covers a character as cheaply as a repeat that goes on, so the middle of a long one is always
    part of it, whatever stands at its ends."""
    gone = 0

    def cut(m: re.Match) -> str:
        nonlocal gone
        size = len(m[1])
        times = max(0, (len(m[0]) // size) - 40)
        gone += times * size
        return m[0][times * size:]

    return _RUN.sub(cut, value), gone


def word_cost(part: str, ranks: dict[str, int]) -> float:
    """Cost of a span as one word, as it is or with digits and signs for letters; infinite if it is none."""
    best, low = math.inf, part.lower()
    for form, more in ((low, 0.0), (low.translate(LEET), 0.5)):
        if rank := ranks.get(form):
            best = min(best, math.log10(rank + 1) + more + (0.0 if part == low else 0.3 if part[1:].islower() or part.isupper() else 1.0))
    return best


def _next(a: str, b: str) -> bool:
    a, b = a.lower(), b.lower()
    return b in NEXT_KEYS.get(a, ()) or len(a) == len(b) == 1 and abs(ord(b) - ord(a)) == 1 and a.isalnum() and b.isalnum()


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation needs, ``ENOUGH`` at most; 0 for an empty value.

    Each span costs ``SPAN`` and: a word its rank (upper case and substitutions more); a date or year their number; a repeat
    (three characters at least) its block by brute force and ``AGAIN`` for each further character; a walk of three
    or more neighbouring keys or consecutive characters ``START`` and ``STEP`` for each step; brute force each character's class.

    Spans that may be long are states that go on character by character, so the work is in
    proportion to the value, and no segmentation is left out. It ends once every state costs ``ENOUGH``.
    """
    ranks = RANK if ranks is None else ranks
    value, gone = _shortened(value)
    n, inf = len(value), math.inf
    best, bits = [0.0] + [inf] * n, [0.0] * (n + 1)  # of all cuts of the first characters; of brute force on them
    repeat = [[inf] * (n + 1) for _ in range(BLOCK + 1)]
    same = [0] * (BLOCK + 1)  # characters up to here that equal those a block before
    brute = walk = inf
    steps = 0
    for j in range(1, n + 1):
        c = value[j - 1]
        one = _brute(c)
        bits[j] = bits[j - 1] + one
        cost = brute = min(best[j - 1] + SPAN, brute) + one
        for size in range(1, min(BLOCK, j - 1) + 1):
            same[size] = same[size] + 1 if c == value[j - 1 - size] else 0
            if same[size] >= size:
                on = repeat[size][j - size] + size * AGAIN
                if size > 1:
                    on = min(on, best[j - 2 * size] + SPAN + bits[j - size] - bits[j - 2 * size] + size * AGAIN)
                elif same[1] >= 2:
                    on = min(on, best[j - 3] + SPAN + one + 2 * AGAIN)
                repeat[size][j] = on
                cost = min(cost, on)
        steps = steps + 1 if j > 1 and _next(value[j - 2], c) else 0
        walk = min(walk + STEP, best[j - 3] + SPAN + START + 2 * STEP) if steps >= 2 else inf
        cost = min(cost, walk)
        for size in range(SHORT, min(LONG, j) + 1):
            if best[j - size] + SPAN < cost:
                cost = min(cost, best[j - size] + SPAN + word_cost(value[j - size:j], ranks))
        if c.isdigit():
            for size, days in ((4, YEAR), (8, DAY), (10, DAY)):
                if j >= size and value[j - size].isdigit() and DATE.fullmatch(value, j - size, j):
                    cost = min(cost, best[j - size] + SPAN + days)
        best[j] = cost
        if j % 32 == 0 and min(brute, walk, *best[max(0, j - 2 * BLOCK):j + 1], *(r[k] for r in repeat for k in range(max(0, j - BLOCK), j + 1))) >= ENOUGH:
            return ENOUGH
    return min(best[n] + gone * AGAIN, ENOUGH)


@lru_cache(1 << 14)
def cost_of(value: str, words_path: str | None) -> float:
    return guess_cost(value, dictionary(words_path) if words_path else None)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats, in that order of kinds."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def credential_values(text: str, words_path: str | None = None) -> list[tuple[int, int, float]]:
    """(start, end, guess cost) of the values in credential contexts."""
    low = text.lower()
    if not (":" in text or "=" in text or " is" in low) or not any(w in low for w in CONTEXT_WORDS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        value = (m[1] or "").rstrip(".!?)]}")
        if value:
            cost = cost_of(value, words_path) if len(value) < 1000 else guess_cost(value, dictionary(words_path) if words_path else None)
            out.append((m.start(1), m.start(1) + len(value), cost))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])))


def _scan(threshold: float, words_path: str | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                values = credential_values(text, words_path)
                more = [(3, a, b) for a, b, cost in values
                        if cost >= threshold and not any(s <= a and b <= e for _, s, e in base)]
                counts = [sum(k == kind for k, _, _ in base) for kind in range(3)]
                for col, x in zip(cols, (*counts, _joined(base), _joined(base + more),
                                         ",".join(f"{a}:{b}:{cost:.2f}" for a, b, cost in values))):
                    col.append(x)
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "guess_costs"])
    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 10.0,
                 words_path: str | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, spans, guess_costs``, a row for each of ``docs``.

    ``base`` and ``spans`` list ``kind:start:end`` (code points, end exclusive) by
    start, then kind; ``spans`` adds ``guess``, the credential-context values that cost at
    least ``10 ** threshold`` guesses and lie in no base span. ``guess_costs`` lists
    ``start:end:log10`` of every value in a credential context, however short; costs end at ``ENOUGH``. ``words_path`` names a
    BPE vocabulary whose words are the dictionary (else: a few passwords). Null and empty texts have no spans;
    repeated rows and null ids stay rows of their own. Other columns are ignored. Each
    row is handled alone, so nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(threshold, words_path), "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, guess_costs string")


def masked(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """``text`` with the listed spans, merged where they overlap, replaced by ``mark``."""
    at, out = 0, []
    for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s)):
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join(out) + text[at:]
