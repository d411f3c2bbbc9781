"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

Fixed kinds, each leftmost and non-overlapping, with offsets in code points:

* ``assign``  a credential word, ``=`` or ``:``, and a value of 8 characters or more
* ``access``  ``AKIA`` and capitals or digits, 16 characters or more together
* ``hex``     32 or more lower-case hexadecimal digits

``random`` spans come from the battery. Stretches of the characters of the base64
alphabets are parted at every inner ``=``, so that a name and its value are judged
apart; a part that mixes the alphabets of base64 and base64url is judged as a whole
and by its longest runs of base64, of base64url and of letters and digits. A
candidate is a part or run of at least ``MIN_LENGTH`` characters that overlaps no
fixed span and has letters and digits (or ``LETTERS_ONLY`` characters). The smallest
encoding that holds it is inferred (hexadecimal, base32, base36, base64, letters), and
three tests ask whether it is uniform in that alphabet: chi-squared over the
symbols, runs above and below the middle, and lag-1 serial correlation. Fisher's
method joins the p-values, and candidates below ``ALPHA`` aren't random.

The error that is controlled is that of reporting a natural token. How natural a
token is, is the chance that a simple model of names, words and numbers gives it.
The likelihood ratio of that model against the uniform one has a mean of at most 1
for tokens of the model, so it is a p-value of being natural, at any length and
whatever the encoding. The candidates of a text that passed the battery are decided
together by the Benjamini-Hochberg rule at ``FDR`` with weights in proportion to
length; those found not to be natural are spans, overlapping ones joined, but a
whole part is dropped for a run in it.

Null texts count as empty and have no spans. Rows are kept, repeated ones too, and an
empty table gives none. A text of any length is scanned whole. Other input columns
take no part in ``find_secrets``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.bpe import slices
from agora.llm.common import trimmed

# The patterns and the least lengths of the fixed kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
WORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH, LETTERS_ONLY, FDR, ALPHA = 20, 32, 0.05, 0.001
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
#: What a stretch is parted into (``=`` at its end is padding), and the runs of a part that mixes alphabets.
PART = re.compile(r"[^=]+(?:=+\Z)?")
RUNS = tuple(re.compile(rf"[A-Za-z0-9{more}]{{{MIN_LENGTH},}}") for more in ("+/", "_-", ""))
#: Encodings from the smallest alphabet up.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hexadecimal", "0123456789abcdef"),
    ("HEXADECIMAL", "0123456789ABCDEF"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("LETTERS", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Of the model of natural tokens: letters' shares in per cent, and how often a lower-case letter, a capital, a digit
#: or a sign follows on each of them.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1), strict=True))
FOLLOWS = {"a": {"a": 0.90, "A": 0.03, "0": 0.03, "-": 0.04}, "A": {"a": 0.55, "A": 0.35, "0": 0.05, "-": 0.05}, "0": {"a": 0.06, "A": 0.04, "0": 0.75, "-": 0.15}, "-": {"a": 0.55, "A": 0.20, "0": 0.20, "-": 0.05}}
#: The share of a class's chance that is spread evenly, for letters that other languages use more often.
EVEN = 0.2
_INDEX = [(name, {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS]


def encoding(token: str) -> tuple[str, dict[str, int]] | None:
    """The smallest alphabet that holds every character, padding apart."""
    used = set(token.rstrip("="))
    return next(((name, index) for name, index in _INDEX if used <= index.keys()), None)


def normal_tails(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_tail(x: float, df: int) -> float:
    """Upper tail: the exact sum for even degrees of freedom, Wilson-Hilferty's cube root otherwise."""
    if x <= 0:
        return 1.0
    if df % 2 == 0 and df <= 200:
        term = total = math.exp(-x / 2)
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return min(1.0, total)
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> float:
    """Fisher's p-value that the token is uniform in its inferred alphabet; 0 if it has none."""
    found = encoding(token)
    if found is None:
        return 0.0
    index = found[1]
    values = [index[c] for c in token.rstrip("=")]
    n, size = len(values), len(index)
    if n < 2:
        return 0.0
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    expected = n / size
    chi = chi_squared_tail(sum(c * c for c in counts.values()) / expected - n, size - 1)
    high = [v >= size / 2 for v in values]
    a, b = sum(high), n - sum(high)
    if a and b:
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        runs = normal_tails((1 + sum(x != y for x, y in zip(high, high[1:], strict=False)) - mean) / spread)
    else:
        runs = 2.0 ** (1 - n)
    centre = sum(values) / n
    power = sum((v - centre) ** 2 for v in values)
    lagged = sum((x - centre) * (y - centre) for x, y in zip(values, values[1:], strict=False))
    serial = normal_tails((lagged / power + 1 / n) * math.sqrt(n)) if power else 0.0
    return chi_squared_tail(-2 * sum(math.log(max(p, 1e-300)) for p in (chi, runs, serial)), 6)


def _kind(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-"


def _within(c: str) -> float:
    """The chance of a character among those of its kind."""
    if c.isalpha():
        return (1 - EVEN) * LETTERS[c.lower()] / sum(LETTERS.values()) + EVEN / 26
    return 0.1 if c.isdigit() else 0.2


_CHARACTERS = "".join(a for name, a in ALPHABETS if name == "mixed")
_STEP = {(x, y): math.log(FOLLOWS[_kind(x)][_kind(y)] * _within(y)) for x in _CHARACTERS for y in _CHARACTERS}
_START = {c: math.log(0.25 * _within(c)) for c in _CHARACTERS}


def naturalness(token: str) -> float:
    """The likelihood ratio of the natural model against the uniform one, at most 1: a p-value of being natural."""
    token = token.rstrip("=")
    found = encoding(token)
    if not token or found is None:
        return 1.0
    ratio = _START[token[0]] + sum(map(_STEP.__getitem__, zip(token, token[1:], strict=False))) + len(token) * math.log(len(found[1]))
    return math.exp(min(0.0, ratio))


def rejected(p_values: list[float], lengths: list[int], fdr: float = FDR) -> set[int]:
    """Positions that the length-weighted Benjamini-Hochberg rule rejects."""
    n, mean = len(p_values), sum(lengths) / max(1, len(lengths))
    weighted = sorted((p * mean / length, k) for k, (p, length) in enumerate(zip(p_values, lengths, strict=True)))
    last = max((r for r, (p, _) in enumerate(weighted, 1) if p <= fdr * r / n), default=0)
    return {k for _, k in weighted[:last]}


def parts(stretch: str) -> list[tuple[int, int]]:
    """(start, end) of what is judged in a stretch: its parts between ``=``, and the runs of those that mix alphabets."""
    out = []
    for m in PART.finditer(stretch):
        if len(m[0]) < MIN_LENGTH:
            continue
        out.append(m.span())
        if (found := encoding(m[0])) and found[0] == "mixed":
            out += sorted({(m.start() + r.start(), m.start() + r.end()) for pattern in RUNS for r in pattern.finditer(m[0])})
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind in KINDS, end), by start and kind."""
    spans = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    candidates = [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]
    if any(b - a >= HEX_LENGTH for a, b in candidates):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base, tested = sorted(spans), []
    for a, b in [(start + x, start + y) for start, end in candidates for x, y in parts(text[start:end])]:
        token = text[a:b]
        mixed = any(c.isdigit() for c in token) and any(c.isalpha() for c in token)
        if (mixed or (b - a >= LETTERS_ONLY and not token.isdigit())) and not any(s < b and a < e for s, _, e in base):
            if battery(token) >= ALPHA:
                tested.append((a, b, naturalness(token)))
    if tested:
        kept = rejected([p for _, _, p in tested], [b - a for a, b, _ in tested])
        found = [(a, b) for k, (a, b, _) in enumerate(tested) if k in kept]
        spans += [(a, 3, b) for a, b in united([(a, b) for a, b in found if not any(a <= x and y <= b and (a, b) != (x, y) for x, y in found)])]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every span replaced; spans that overlap are replaced as one."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: (id, n_assign, n_access, n_hex, n_random, base_sha256, spans)."""
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["n_assign", "n_access", "n_hex", "n_random"]

    @trimmed
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                found = [scan(t) for t in texts]
                counts = [pa.array([sum(k == j for _, k, _ in s) for s in found], pa.int64()) for j in range(4)]
                digests = [hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *counts, pa.array(digests, pa.string()), pa.array(map(joined, found), pa.string())], names=["id", *names, "base_sha256", "spans"])

    return source.mapInArrow(run, f"id {kind}, {', '.join(f'{n} bigint' for n in names)}, base_sha256 string, spans string").withColumnRenamed("id", id_column)


def mask_secrets(docs: DataFrame, text_column: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mask``; null texts stay null, other columns as they are."""
    names = docs.columns
    at = names.index(text_column)

    @trimmed
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, texts in slices(batch.column(at)):
                columns = batch.slice(a, b - a).columns
                columns[at] = pa.array([t if not t or not (s := scan(t)) else masked(t, s, mask) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the fixed kinds, the digest of their spans, and all spans."""
    from agora.llm.common import table

    return find_secrets(table(spark, sf_dir, "documents"))
