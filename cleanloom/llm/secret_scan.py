"""Secret scan: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two models of the same form are trained from labelled samples, one on random strings and one on ordinary identifiers: the
probability of a character given the one before it. A candidate's log-likelihood ratio per character is compared with a
threshold, which is fitted as well: the least at which hardly any ordinary sample is taken for a secret.
"""

from __future__ import annotations

import hashlib
import importlib
import math
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm._common import bounded_batches, shipped

shipped(__name__)

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What the models judge: runs of so many characters that letters, digits and a few signs form.
SHORTEST = 20
#: Bits a character that a secret has at least: a string of 20 characters is then a thousand times likelier to be random.
LEAST_BITS = 0.5
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Modules whose public names are the samples of ordinary identifiers.
_MODULES = ("argparse", "asyncio", "collections", "concurrent.futures", "configparser", "datetime", "decimal", "email.message", "http.client", "http.server", "json", "logging.handlers", "multiprocessing", "os", "pathlib", "pickle", "smtplib", "socket", "sqlite3", "ssl", "subprocess", "tarfile", "tempfile", "threading", "unittest.mock", "urllib.request", "xml.dom.minidom", "zipfile")


def ordinary_names() -> list[str]:
    """The public names of some standard modules and of their classes, sorted."""
    found = set()
    for name in _MODULES:
        module = importlib.import_module(name)
        for k in dir(module):
            found.add(k)
            if isinstance(getattr(module, k, None), type):
                found.update(dir(getattr(module, k)))
    return sorted(k for k in found if not k.startswith("_"))


def labelled_samples(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1 for a random one, 0 for an ordinary identifier), n of each, the same at every call.

    Random strings are drawn from the alphabets that keys have: hexadecimal, base 64, letters with digits. Ordinary ones
    are names from programs, alone or joined as in snake case, camel case, paths and slugs, with and without numbers,
    years, dates and versions.
    """
    draw, names = random.Random(seed), ordinary_names()
    kinds = ("0123456789abcdef", _ALPHABET[:64], _ALPHABET[:62], _ALPHABET[:26] + _ALPHABET[52:62], _ALPHABET[26:62])
    numbers = (lambda: str(draw.randrange(10)), lambda: str(draw.randrange(1900, 2030)), lambda: str(draw.randrange(10**6)), lambda: f"{draw.randrange(1990, 2030)}-{draw.randrange(1, 13):02}-{draw.randrange(1, 29):02}", lambda: f"v{draw.randrange(9)}")
    out = []
    for _ in range(n):
        out.append(("".join(draw.choices(draw.choice(kinds), k=draw.randint(16, 64))), 1))
        parts = [draw.choice(names) for _ in range(draw.randint(2, 6))]
        if draw.random() < 0.5:
            parts.insert(draw.randrange(len(parts) + 1), draw.choice(numbers)())
        style = draw.randrange(5)
        out.append((("".join(parts), "_".join(parts).lower(), "-".join(parts).lower(), "".join(p[:1].upper() + p[1:] for p in parts), "/".join(parts))[style], 0))
    return out


class MarkovRatio:
    """log2 P(random) - log2 P(ordinary) of a string, by first-order character models with add-one smoothing."""

    def __init__(self, samples: list[tuple[str, int]], wrong: float = 0.001):
        tables = []
        for label in (1, 0):
            counts = {a: dict.fromkeys(_ALPHABET, 1.0) for a in "^" + _ALPHABET}
            for text in (t for t, x in samples if x == label):
                before = "^"
                for c in text:
                    if c in counts[before]:
                        counts[before][c] += 1
                    before = c if c in counts else "^"
            tables.append(counts)
        sums = [{a: sum(row.values()) for a, row in t.items()} for t in tables]
        self.weight = {a: {c: math.log2(tables[0][a][c] / sums[0][a]) - math.log2(tables[1][a][c] / sums[1][a]) for c in _ALPHABET} for a in "^" + _ALPHABET}
        ordinary = sorted((self(t) for t, x in samples if not x and candidate(t)), reverse=True)
        #: Bits a character from which a candidate is a secret: LEAST_BITS, or as many as at most a share `wrong` of the ordinary samples reaches.
        self.least_bits = max(LEAST_BITS, ordinary[min(len(ordinary) - 1, int(wrong * len(ordinary)))]) if ordinary else LEAST_BITS

    def __call__(self, text: str) -> float:
        """Bits in favour of a random string, per character."""
        before, total = "^", 0.0
        for c in text:
            total += self.weight[before][c]
            before = c
        return total / len(text)


def candidate(text: str) -> bool:
    """Whether a string is one that the models judge: long, of their alphabet, with letters and digits."""
    return _CANDIDATE.fullmatch(text) is not None and any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def train(samples: list[tuple[str, int]] | None = None) -> MarkovRatio:
    """The models and the threshold from labelled samples (string, 1 for a secret); without any, from labelled_samples()."""
    return MarkovRatio(samples or labelled_samples())


def quality(model: MarkovRatio, samples: list[tuple[str, int]]) -> tuple[float, float]:
    """(precision, recall) of the model's verdicts on labelled candidates."""
    found = [(model(t) >= model.least_bits, x) for t, x in samples if candidate(t)]
    right = sum(f and x for f, x in found)
    return right / max(1, sum(f for f, _ in found)), right / max(1, sum(x for _, x in found))


def held_out(text: str) -> bool:
    """A fifth of all strings, by a checksum; for measuring a model that was trained on the others."""
    return zlib.crc32(text.encode()) % 5 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, per kind leftmost and without overlap."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def model_spans(text: str, model: MarkovRatio) -> list[tuple[int, int]]:
    """Candidates whose ratio reaches the model's threshold."""
    return [(m.start(), m.end()) for m in _CANDIDATE.finditer(text) if candidate(m.group()) and model(m.group()) >= model.least_bits]


def _apart(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans, in order and without overlap among them, that overlap no base span."""
    ends = []  # the furthest end of the base spans up to each
    for _, _, e in base:
        ends.append(max(e, ends[-1]) if ends else e)
    starts = [s for s, _, _ in base]
    return [(s, e) for s, e in spans if (k := bisect_left(starts, e)) == 0 or ends[k - 1] <= s]


def _digest(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _scan(model: MarkovRatio):
    names = (*KINDS, "markov")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, spans = ([], [], []), [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                for k, column in enumerate(n):
                    column.append(sum(kind == k for _, kind, _ in base))
                sha.append(hashlib.sha256(_digest((s, names[k], e) for s, k, e in base).encode()).hexdigest())
                more = [(s, 3, e) for s, e in _apart(model_spans(text or "", model), base)]
                spans.append(_digest((s, names[k], e) for s, k, e in sorted(base + more)))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in n), pa.array(sha), pa.array(spans)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_spans(docs: DataFrame, model: MarkovRatio | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs (doc_id long, text string).

    spans lists kind:start:end in code points, the end exclusive, by start and then kind; the model's own finds have the
    kind markov and never overlap a fixed pattern's. base_sha256 is of the list without them. A null or empty text has no
    spans; a text of any length is scanned whole. Rows that repeat are scanned one by one; an empty table gives an empty
    result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return narrow.mapInArrow(_scan(model or train()), schema)
