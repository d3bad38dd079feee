"""Secret scanning: pattern candidates, and a random forest that removes false positives.

Candidates are values of assignments to names with a secret-sounding part, passwords in addresses, tokens of well-known
forms, private key blocks, and long mixed runs of characters; each is taken whole, however long. A random forest then
judges each by its length, its character transitions, how much of it a dictionary covers, the path it stands in and the
words next to it. The forest is trained from labelled findings: those given, or else a labelled set made by rule
(SAMPLE findings, from a fixed seed), as the tables have none. The dictionary is the whole words of a public
tokenizer's vocabulary.

Nulls and edge cases: a null or empty text has no finding; without a column for the path, or where it is null, no path
speaks for or against. Findings of one text don't overlap; of overlapping candidates the first stays, of those that
begin together the longest, of equal ones the first kind in the order above. Very long texts are scanned whole. Repeated
rows are scanned one by one. With no labelled finding of one of the two kinds every candidate counts as a secret.
Columns named like the result's don't matter to it; redact_documents() keeps all columns. An empty table gives no row.
"""

from __future__ import annotations

import json
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table, tidy

SAMPLE = 4000
THRESHOLD = 0.5

# Forms of published token kinds.
FORMS = {
    "aws_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google": r"AIza[0-9A-Za-z_\-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
}
NAMES = re.compile(r"(?i)pass(?:word|wd|phrase|code)|(?:^|[_\-])pass(?:$|[_\-])|pwd|secret|token|auth|credential|bearer|(?:api|access|account|client|encryption|master|private|secret|signing)[_\-]?key")
_FORMS = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMS.items()))
_RUN = re.compile(r"[A-Za-z0-9+/_=\-]{20,}")
_SIGN = re.compile(r":=|=>|[:=]")
_NAME = re.compile(r"([A-Za-z][A-Za-z0-9_\-]{1,60})[\"']?\s{0,4}$")
_VALUE = re.compile(r"\s{0,4}([\"'`]?)([^\s\"'`,;<>(){}]{6,})\1")
_ADDRESS = re.compile(r"://[^\s/:@]*:([^\s/@]{6,})@")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----.*?(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----|\Z)", re.S)

# Words that placeholders and paths are made of, and words that tell of their surroundings.
WORDS = "access account admin api app auth base build cache client config data default dev digest env file form group handler head home host index item level list local main manager method model name node order page path plugin point project public query request resource result role root server service session source state static store style system table target user value version view web".split()
HASHY = frozenset("sha sha1 sha256 md5 crc commit checksum digest etag hash integrity revision rev uuid guid build version color id".split())
SAMPLY = frozenset("example sample dummy fake placeholder test mock demo todo redacted changeme your".split())

_dictionaries: dict[str, frozenset[str]] = {}


def dictionary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def dictionary(path: str) -> frozenset[str]:
    """The whole words of three to MOST letters of a vocabulary that marks word ends."""
    if path not in _dictionaries:
        model = json.loads(Path(path).read_text())["model"]
        end = model["end_of_word_suffix"]
        words = (w.removesuffix(end) for w in model["vocab"] if w.endswith(end))
        _dictionaries[path] = frozenset(w for w in words if 3 <= len(w) <= MOST and w.isascii() and w.isalpha())
    return _dictionaries[path]


#: The longest words that the dictionary has.
MOST = 14


def covered(value: str, words: frozenset[str]) -> int:
    """How many characters words of the dictionary cover, the longest first at each place."""
    total = i = 0
    while i < len(value) - 2:
        n = next((n for n in range(min(MOST, len(value) - i), 2, -1) if value[i : i + n] in words), 0) if value[i].isalpha() else 0
        total += n
        i += n or 1
    return total


@dataclass(frozen=True)
class Finding:
    start: int
    length: int
    rule: str
    value: str
    before: str
    after: str


def candidates(text: str) -> list[Finding]:
    """Candidates of a whole text, in order and without overlap."""
    found: list[tuple[int, int, str]] = []
    if "-----BEGIN" in text:
        found += [(m.start(), m.end(), "private_key") for m in _PEM.finditer(text)]
    for m in _FORMS.finditer(text):
        found.append((m.start(), m.end(), m.lastgroup or ""))
    for m in _SIGN.finditer(text):
        name = _NAME.search(text, max(0, m.start() - 70), m.start())
        if name and NAMES.search(name[1]) and (v := _VALUE.match(text, m.end())):
            found.append((v.start(2), v.end(2), "assignment"))
    for m in _ADDRESS.finditer(text) if "://" in text else ():
        found.append((m.start(1), m.end(1), "address"))
    for m in _RUN.finditer(text):
        if any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])):
            found.append((m.start(), m.end(), "run"))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for a, b, rule in found:
        if a >= end:
            out.append(Finding(a, b - a, rule, text[a:b], text[max(0, a - 60) : a], text[b : b + 40]))
            end = b
    return out


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(f: Finding, path: str | None, words: frozenset[str] | None = None) -> list[float]:
    """One finding's numbers, over its whole value: its length, characters, transitions, dictionary coverage, path and
    neighbours."""
    words = dictionary(dictionary_path()) if words is None else words
    v = f.value
    n = len(v)
    low = v.lower()
    kinds = [_kind(c) for c in v]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    steps = sum(abs(ord(a) - ord(b)) <= 1 for a, b in zip(v, v[1:], strict=False))
    vowel = sum(a in "aeiou" and b.isalpha() and b not in "aeiou" for a, b in zip(low, low[1:], strict=False))
    counts = np.array([*Counter(v).values()]) / n
    near = re.findall(r"[a-z0-9]+", f.before.lower())[-4:]
    after = re.findall(r"[a-z0-9]+", f.after.lower())[:3]
    where = set(re.findall(r"[a-z]+", (path or "").lower()))
    return [
        n, *(kinds.count(k) / n for k in range(4)), turns / n, steps / n, vowel / n, float(-(counts * np.log2(counts)).sum()), len(set(v)) / n, covered(low, words) / n,
        float(bool(NAMES.search(f.before[-30:]))), float(bool(HASHY & set(near))), float(bool(SAMPLY & {*near, *after} or any(w in low for w in SAMPLY))),
        float(bool(where & {"test", "tests", "example", "examples", "docs", "doc", "spec", "fixtures", "mock", "sample"})), float(bool(where & {"lock", "sum", "sums", "checksums", "vendor"})),
        float({"assignment": 2, "address": 2, "run": 1}.get(f.rule, 3)),
    ]


class Forest:
    """A random forest of binary trees on numpy arrays: bootstrap rows, random features at each split, Gini impurity."""

    def __init__(self, trees: int = 30, depth: int = 8, least: int = 4, seed: int = 5):
        self.trees, self.depth, self.least, self.rng, self.nodes = trees, depth, least, np.random.default_rng(seed), []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.trees):
            rows = self.rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], nodes, 0)
            self.nodes.append(np.array(nodes))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, nodes: list, depth: int) -> int:
        """Appends a node (feature, threshold, left, right, share of secrets); a leaf has feature -1."""
        k = len(nodes)
        nodes.append([-1.0, 0.0, 0.0, 0.0, float(y.mean())])
        if depth >= self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return k
        best = (np.inf, -1, 0.0)
        for j in self.rng.permutation(x.shape[1])[: int(np.ceil(np.sqrt(x.shape[1])))]:
            order = np.argsort(x[:, j], kind="stable")
            v, t = x[order, j], np.cumsum(y[order])
            n = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (n >= self.least) & (len(y) - n >= self.least)
            if not ok.any():
                continue
            a, b = t[:-1] / n, (t[-1] - t[:-1]) / (len(y) - n)
            gini = np.where(ok, n * a * (1 - a) + (len(y) - n) * b * (1 - b), np.inf)
            i = int(gini.argmin())
            if gini[i] < best[0]:
                best = (float(gini[i]), int(j), float((v[i] + v[i + 1]) / 2))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            nodes[k][:2] = [best[1], best[2]]
            nodes[k][2] = self._grow(x[left], y[left], nodes, depth + 1)
            nodes[k][3] = self._grow(x[~left], y[~left], nodes, depth + 1)
        return k

    def score(self, x: np.ndarray) -> np.ndarray:
        """The mean share of secrets in the leaves that each row reaches."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = t[at, 0].astype(np.int64)
                left = x[rows, np.maximum(j, 0)] <= t[at, 1]
                at = np.where(j < 0, at, np.where(left, t[at, 2], t[at, 3]).astype(np.int64))
            total += t[at, 4]
        return total / max(1, len(self.nodes))


def labelled_findings(n: int = SAMPLE, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, path, 1 for a secret) made by rule: random values where secrets stand, against placeholders, variables,
    ordinary words, checksums, identifiers and links where those stand."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rand = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    word = lambda: pick(WORDS) if rng.random() < 0.4 else rand("aeiouaeiounrstlhdm", int(rng.integers(2, 9)))
    wide = string.ascii_letters + string.digits
    names = ["token", "password", "secret", "api_key", "apikey", "access_key", "client_secret", "auth_token", "db_password", "TOKEN", "API_KEY", "secret_key", "SIGNING_KEY", "token_value", "aws_secret_access_key", "PASSWD"]
    out = []
    for i in range(n):
        before, after = " ".join(word() for _ in range(4)), " ".join(word() for _ in range(3))
        sign, quote = pick([" = ", "=", ": ", " := "]), pick(['"', "'", ""])
        path = pick(["src/app.py", "config/settings.yml", "src3", "deploy/env", "notes.txt", "lib/client.js"])
        if i % 2:
            kind = int(rng.integers(6))
            size = int(rng.integers(16, 64))
            value = [rand("0123456789abcdef", pick([32, 40, 48, 64])), rand(wide, size), rand(wide + "+/", size) + pick(["", "=", "=="]), rand("0123456789ABCDEF", pick([32, 40])), rand(wide + "!@#%^*", int(rng.integers(10, 24))), "AKIA" + rand(string.ascii_uppercase + string.digits, 16)][kind]
            where = int(rng.integers(6))
            if where == 0:
                text = f"Authorization: Bearer {value}"
            elif where == 1 and not set(value) & set("/@#"):
                text = f"{word()}://{word()}:{value}@{word()}.{word()}/{word()}"
            elif where == 2:
                text = f'"{pick(names)}": "{value}",'
            else:
                text = f"{pick(names)}{sign}{quote}{value}{quote}"
            out.append((f"{before} {text} {after}", path, 1))
            continue
        kind = int(rng.integers(10))
        if kind == 0:
            text = f"{pick(names)}{sign}{quote}{pick(['changeme', 'your_token_here', 'xxxxxxxxxxxxxxxx', 'example-secret-value', 'REDACTED_VALUE', '****************', '1234567890', 'placeholder_key'])}{quote}"
        elif kind == 1:
            text = f"{pick(names)}{sign}{pick(['os.environ.get', 'config.secret_value', '$TOKEN_VALUE', 'self.password_field', 'request.token.value', 'getpass.getpass'])}"
        elif kind == 2:
            text = f"{pick(['commit', 'sha256', 'md5', 'checksum', 'etag', 'revision', 'digest'])}{pick([' ', ': ', ' = '])}{rand('0123456789abcdef', pick([32, 40, 64]))}"
        elif kind == 3:
            text = pick(["-", "_", "/"]).join([*(word() for _ in range(int(rng.integers(4, 8)))), str(int(rng.integers(100)))])
        elif kind == 4:
            text = f"{pick(['id', 'uuid', 'guid'])}{sign}" + "-".join(rand("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
        elif kind == 5:
            text = f"{pick(names)}{sign}{quote}{'_'.join(word() for _ in range(3))}{quote}"
        elif kind == 6:
            text, path = f"{pick(names)}{sign}{quote}{rand(wide, 24)}EXAMPLE{quote} example", pick(["docs/example.md", "tests/test_auth.py"])
        elif kind == 7:
            text = f"https/{word()}/{word()}{int(rng.integers(1000))}/{word()}/{word()}"
        elif kind == 8:
            text = f'{pick(["integrity", "digest", "etag", "hash"])}{pick(["=", ": "])}"sha{pick([256, 384, 512])}-{rand(wide + "+/", pick([43, 64, 86]))}{pick(["", "=", "=="])}"'
        else:
            text = f"{pick(names)}{sign}{quote}{pick(['${', '{{ ', '%(', '<'])}{pick(WORDS)}.{pick(WORDS)}_{pick(WORDS)}{pick(['}', ' }}', ')s', '>'])}{quote}"
        out.append((f"{before} {text} {after}", path, 0))
    return out


def train(findings: list[tuple[str, str, int]] | None = None) -> Forest | None:
    """A forest from labelled findings (text around a finding, path, 1 for a secret)."""
    words = dictionary(dictionary_path())
    x, y = [], []
    for text, path, label in labelled_findings() if findings is None else findings:
        for f in candidates(text):
            x.append(features(f, path, words))
            y.append(label)
    return Forest().fit(np.array(x), np.array(y)) if len(set(y)) == 2 else None


def scan(texts: list[str | None], paths: list[str | None], forest: Forest | None) -> list[list[tuple[Finding, float]]]:
    """For each text its candidates with their scores."""
    words = dictionary(dictionary_path())
    found = [candidates(t) if t else [] for t in texts]
    rows = [features(f, p, words) for fs, p in zip(found, paths, strict=True) for f in fs]
    scores = iter((forest.score(np.array(rows)) if forest else np.ones(len(rows))) if rows else [])
    return [[(f, float(next(scores))) for f in fs] for fs in found]


def redact(text: str | None, findings: list[tuple[Finding, float]], mark: str = "[SECRET]") -> str | None:
    """The text with each confirmed secret replaced."""
    if text is None:
        return None
    parts, at = [], 0
    for f, score in findings:
        if score >= THRESHOLD:
            parts += [text[at : f.start], mark]
            at = f.start + f.length
    return "".join([*parts, text[at:]])


OUT = "doc_id long, start long, length long, rule string, score double, is_secret boolean"


def find_secrets(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """A row for each candidate of each document (doc_id, text, and source as the path if there is one): its place in code
    points and verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # of a size set by trees and depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, paths = (batch.column(k).to_pylist() for k in range(3))
            rows = [(i, f.start, f.length, f.rule, s, s >= THRESHOLD) for i, fs in zip(ids, scan(texts, paths, shared.value), strict=True) for f, s in fs]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 3, pa.string(), pa.float64(), pa.bool_()), strict=True)], names=[c.split(" ")[0] for c in OUT.split(", ")])

    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("source")).mapInArrow(tidy(run), OUT)


def redact_documents(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """docs with each confirmed secret in `text` replaced and n_chars, where it is there, set to the new length."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            paths = batch.column(names.index("source")).cast(pa.string()).to_pylist() if "source" in names else [None] * len(texts)
            new = [redact(t, fs) for t, fs in zip(texts, scan(texts, paths, shared.value), strict=True)]
            cols = list(batch.columns)
            cols[names.index("text")] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in names:
                kept = cols[names.index("n_chars")].to_pylist()
                cols[names.index("n_chars")] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, texts, new, strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = StructType([*docs.schema.fields])
    return docs.mapInArrow(tidy(run), schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), train())


QUERIES = {"op6_secret_scans": op6}
ORACLE: dict[str, str] = {}
