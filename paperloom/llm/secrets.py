"""Secret scans: fixed patterns and a battery of randomness tests.

The patterns (assignments, access keys, long hexadecimal runs) are the base. The battery adds runs of key characters that
look drawn at random: their encoding is inferred from the characters (decimal, hexadecimal, base32, base36, base62,
base64). Three tests hold a run against ordinary writing in that encoding, as the corpus itself has it: chi-squared over the
alphabet (a random run has fewer equal characters than writing), the number of runs of letter case and kind (it has more),
and the correlation of neighbours (it has none). Their p-values, of writing looking as random as that, are combined so
that they may depend on each other. They fall with length, so short runs can't pass. All runs of the corpus
go through one step-up rule for each class of lengths, which holds the false-discovery rate at ``FDR`` under any dependence. The same
three tests against uniform draws then reject what is neither writing nor random, such as counters and filling.

Three scans: pairs of characters (a table of fixed size), p-values (counts by length class and bin), and the result.

Cases: null text is empty; repeated rows get equal results; texts are taken whole; an empty table gives no rows; further
columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

LONG = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
FDR = 0.01
#: Least p-value of the three tests against uniform draws, together, that still counts as random.
BATTERY = 0.01
#: p-values are kept as ``BINS`` for each halving, up to the last bin.
BINS, LAST = 8, 4095
#: Lengths from which the classes begin that are controlled apart.
LENGTHS = (16, 20, 24, 32, 48, 64, 128)
#: So many characters of the prior go into the shares of ordinary writing.
PRIOR = 1000.0
#: Ordinary names and paths change the kind of character at least this often.
CHANGE = 0.25

#: Letter shares of ordinary writing, in per mille, from e to the rarest.
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (120, 90, 80, 76, 71, 69, 63, 61, 59, 43, 40, 28, 28, 25, 23, 22, 20, 19, 19, 15, 10, 8, 2, 2, 1, 1), strict=True))
#: Inferred encodings, the narrowest first.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
RANKS = [(name, {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS]
#: Prior shares of writing: digits and signs, together, and capitals among letters.
DIGIT, SIGN, CAPITAL = 0.02, 0.01, 0.05


def _kind(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s"


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer(s: str) -> tuple[str, dict[str, int]] | None:
    """The narrowest encoding with all characters of ``s``."""
    chars = set(s)
    return next(((n, r) for n, r in RANKS if chars <= r.keys()), None)


def battery(s: str, rank: dict[str, int]) -> float:
    """The least of the three tests' p-values, times three (at most 1)."""
    v, k, n = [rank[c] for c in s], len(rank), len(s)
    bins = max(2, min(k, n // 5))
    of = [x * bins // k for x in range(k)]
    width = [of.count(b) / k for b in range(bins)]
    counts = [0] * bins
    for x in v:
        counts[of[x]] += 1
    chi, df = sum((c - n * w) ** 2 / (n * w) for c, w in zip(counts, width, strict=True)), bins - 1
    cube = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # chi-squared's cube root is nearly normal
    p_chi = 0.5 * math.erfc(cube / math.sqrt(2))
    high = [2 * x >= k for x in v]
    a = sum(high)
    b = n - a
    if a and b:
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = _two_sided((1 + sum(x != y for x, y in zip(high, high[1:], strict=False)) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 0.5 ** (n - 1)
    m = sum(v) / n
    ss = sum((x - m) ** 2 for x in v)
    r = sum((x - m) * (y - m) for x, y in zip(v, v[1:], strict=False)) / ss if ss else 1.0
    return min(1.0, 3 * min(p_chi, p_runs, _two_sided(r * math.sqrt(n) + 1 / math.sqrt(n))))


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


@dataclass(frozen=True)
class Writing:
    """Ordinary writing by encoding: (sum of squared shares, sum of cubed shares, rate of changes of kind, correlation of neighbours)."""

    of: dict[str, tuple[float, float, float, float]]

    @classmethod
    def learn(cls, pairs: np.ndarray) -> Writing:
        """``pairs``: how often each ASCII character follows each (128 x 128), inside words."""
        total, prior = sum(LETTERS.values()), np.zeros(128)
        for c, share in LETTERS.items():
            prior[ord(c)] = (1 - DIGIT - SIGN) * (1 - CAPITAL) * share / total
            prior[ord(c.upper())] = (1 - DIGIT - SIGN) * CAPITAL * share / total
        for c in "0123456789":
            prior[ord(c)] = DIGIT / 10
        for c in "+/-_":
            prior[ord(c)] = SIGN / 4
        out = {}
        for name, alphabet in ALPHABETS:
            at = np.array([ord(c) for c in alphabet])
            inside = pairs[np.ix_(at, at)].astype(np.float64)
            n = inside.sum()
            share = inside.sum(axis=0) + PRIOR * prior[at]
            share /= share.sum()
            kinds = np.array([_kind(c) for c in alphabet])
            changes = inside[kinds[:, None] != kinds[None, :]].sum() / n if n else 0.0
            rank, rho = np.arange(len(at)), 0.0
            if n:
                x, y = inside.sum(axis=1) / n, inside.sum(axis=0) / n
                mx, my = (x * rank).sum(), (y * rank).sum()
                spread = math.sqrt((x * (rank - mx) ** 2).sum() * (y * (rank - my) ** 2).sum())
                rho = float((inside / n * np.outer(rank - mx, rank - my)).sum() / spread) if spread else 0.0
            out[name] = float((share**2).sum()), float((share**3).sum()), max(CHANGE, float(changes)), rho
        return cls(out)

    def p_value(self, s: str, name: str, rank: dict[str, int]) -> float:
        """How likely writing looks as random as ``s``: the three tests' p-values, combined by Cauchy's rule."""
        two, three, change, rho = self.of[name]
        n, pairs = len(s), len(s) * (len(s) - 1) / 2
        counts = [s.count(c) for c in set(s)]
        # Pearson's statistic is a line in the number of pairs of equal characters, whose mean and variance are known for any shares.
        same = sum(c * (c - 1) / 2 for c in counts)
        var = pairs * two * (1 - two) + n * (n - 1) * (n - 2) * max(0.0, three - two * two)
        p_chi = _below((same + 0.5 - pairs * two) / math.sqrt(var)) if var > 0 else 1.0
        runs = sum(_kind(x) != _kind(y) for x, y in zip(s, s[1:], strict=False))
        p_runs = _below(-(runs - 0.5 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
        v = [rank[c] for c in s]
        m = sum(v) / n
        ss = sum((x - m) ** 2 for x in v)
        r = sum((x - m) * (y - m) for x, y in zip(v, v[1:], strict=False)) / ss if ss else 1.0
        z = (r + 1 / n - rho) * math.sqrt(n)
        p_serial = _below(z) if rho > 0.02 else _below(-z) if rho < -0.02 else 0.5
        each = [min(max(p, 1e-300), 1 - 1e-9) for p in (p_chi, p_runs, p_serial)]
        # tan((1/2 - p) pi) is 1 / (p pi) for small p, where the tangent would lose all digits.
        t = sum(1 / (p * math.pi) if p < 1e-8 else math.tan((0.5 - p) * math.pi) for p in each) / 3
        return 1 / (t * math.pi) if t > 1e8 else 0.5 - math.atan(t) / math.pi


def bin_of(p: float) -> int:
    """The bin of a p-value; all in it are at most ``2 ** (-bin / BINS)``."""
    return min(LAST, int(-math.log2(max(p, 1e-300)) * BINS))


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def cuts(counts: dict[tuple[int, int], int]) -> dict[int, int]:
    """By length class: the least bin kept by the step-up rule at ``FDR``. ``counts``: by length class and bin."""
    out = {}
    for k in range(len(LENGTHS)):
        bins = sorted((b, n) for (c, b), n in counts.items() if c == k)
        m = sum(n for _, n in bins)
        harmonic = math.log(m) + 0.5772156649 + 1 / (2 * m) if m else 1.0
        out[k], above = LAST + 1, 0
        for b, n in reversed(bins):
            above += n
            if 2 ** (-b / BINS) <= FDR * above / (m * harmonic):
                out[k] = b
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    at = text.find("AKIA")
    while at >= 0:
        m = ACCESS.match(text, at)
        end = m.end() if m else at + 4
        if m and end - at >= 18:
            found.append((at, end, 1))
        at = text.find("AKIA", end)
    for long in LONG.finditer(text):
        found += [(long.start() + m.start(), long.start() + m.end(), 2) for m in HEX.finditer(long[0]) if m.end() - m.start() >= 16]
    return sorted(found, key=lambda x: (x[0], x[2]))


def candidates(text: str, base: list[tuple[int, int, int]], writing: Writing) -> Iterator[tuple[int, int, int, int, str, dict[str, int]]]:
    """start, end, length class, bin of the p-value, characters and their ranks, of each run outside the base spans; both come in order."""
    i, reach = 0, 0  # base spans that begin before the run's end, and the furthest end of these
    for m in CANDIDATE.finditer(text):
        s = m[0].rstrip("=")
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][1])
            i += 1
        if reach > m.start():
            continue
        if e := infer(s):
            yield m.start(), m.end(), length_class(len(s)), bin_of(writing.p_value(s, *e)), s, e[1]


def scan(text: str | None, writing: Writing, cut: dict[int, int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with the battery's added."""
    text = text or ""
    base = base_spans(text)
    more = [(a, b, 3) for a, b, k, p, s, rank in candidates(text, base, writing) if p >= cut[k] and battery(s, rank) >= BATTERY]
    return base, sorted(base + more, key=lambda x: (x[0], x[2])) if more else base


def written_pairs(texts: DataFrame) -> np.ndarray:
    """How often each ASCII character follows each inside the words of all texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 14, dtype=np.int64)
        for part in parts:
            for at in range(0, part.num_rows, 256):
                text = " ".join(t for t in part.column(0).slice(at, 256).to_pylist() if t)
                x = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int32)
                word = (x > 32) & (x < 127)
                ok = word[1:] & word[:-1]
                total += np.bincount((x[:-1] << 7 | x[1:] & 127)[ok], minlength=1 << 14)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    out = np.zeros(1 << 14, dtype=np.int64)
    for r in texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 16384 cells at most
        out[r["cell"]] = r["n"]
    return out.reshape(128, 128)


def control(texts: DataFrame, writing: Writing) -> dict[int, int]:
    """The step-up rule's cuts over all runs of all texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in parts:
            for text in part.column(0).to_pylist():
                if text:
                    counts.update((k, p) for _, _, k, p, _, _ in candidates(text, base_spans(text), writing))
        rows = [(k, b, n) for (k, b), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["k", "b", "n"])

    got = texts.mapInArrow(run, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).collect()  # length classes times bins at most
    return cuts({(r["k"], r["b"]): r["n"] for r in got})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; a span inside an earlier one goes with it."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


RESULT = T.StructType([
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def find(df: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_random, base_sha256 and spans, and with ``redact`` replaces the text; only counts are shuffled."""
    writing = Writing.learn(written_pairs(df.select(text)))
    cut = control(df.select(text), writing)
    names = [f.name for f in RESULT] + ([] if redact else [text])
    rest = [f for f in df.schema if f.name not in names]
    schema = T.StructType([*rest, *RESULT])
    df = df.select(*[f.name for f in rest], *([] if redact else [text]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(part.schema.names.index(text)).to_pylist()
            found = [scan(t, writing, cut) for t in texts]
            columns = {f.name: part.column(i) for i, f in enumerate(rest)}
            if redact:
                columns[text] = pa.array([redacted(t, every) for t, (_, every) in zip(texts, found, strict=True)], pa.string())
            for k, kind in enumerate(KINDS):
                columns[f"n_{kind}"] = pa.array([sum(x[2] == k for x in every) for _, every in found], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            columns["spans"] = pa.array([joined(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=schema.names)

    return df.mapInArrow(batches, schema)
