"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are values assigned to credential-like names, and long unbroken tokens with a digit that overlap none of
these; ``=`` belongs to a token only as padding at its end. Long tokens are found over whole batches of bytes, names
by an automaton in texts that have a ``:`` or ``=``. A forest over the
value's length, character classes and transitions, the share that dictionary words cover, the path (``source``) and
the neighbouring words then tells keys from hashes, ids, numbers and placeholders. The dictionary is made of the whole
words of a public vocabulary file (``vocabulary``) and words of code and configuration. The forest is trained on labelled findings
(``value``, ``before``, ``after``, ``path``, ``label``): at most ``max_findings`` of them, taken by hash, enter the
training. Character transitions come from two bigram models of the labelled values, one for each label. Scoring runs
over all candidates of all texts, within the JVM.

Values are never returned: findings carry their place, length and SHA-256.

Defined results: null and empty texts have no candidates. Null ids and paths are allowed (a null path is an empty
one). Places are in characters from 0. A value found twice at one place counts once, repeated rows each. Without
labelled findings of both labels the scan refuses to run. Other columns are ignored, whatever their names. Texts of any
length are searched whole.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.bpe import VOCABULARY
from plumbline.llm.common import map_text

MAX_FINDINGS, TREES, DEPTH, THRESHOLD = 20_000, 40, 10, 0.5

_LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "accesskey", "private_key", "privatekey", "credential", "auth")
#: What follows a credential's name up to the end of its value.
_VALUE = re.compile(r"""[\w-]*["']?\s*(?::=|[:=])\s*["']?([^\s"'<>,;]{6,})""")
_WORD = re.compile(r"[a-z]+")
#: The next parameter of a query string, which ends an assigned value.
_NEXT = re.compile(r"&[\w.-]+=")
#: The bytes of long tokens.
_TOKEN_BYTE = np.zeros(256, dtype=bool)
_TOKEN_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True

#: Words of code, configuration and placeholder values, beside those of the vocabulary.
CODE_WORDS = frozenset(
    "the and for that with this from have your you here are not was all can has more will one new out about use any see only time user name test example sample dummy fake placeholder change changeme default value data "
    "file path key token secret password pass word admin root access private public hash commit version build release config client server host port table index list item order number string text line page image icon style "
    "button label class module package main common util utils service model view controller manager handler factory request response error message event action state store update delete create insert select where group count "
    "first last next prev start end begin finish open close read write load save send get set add remove hello world lorem ipsum dolor component container localhost auth api url uri http https html json yaml xml sql env prod dev staging".split()
)


@lru_cache(maxsize=4)
def dictionary(vocabulary: str = VOCABULARY) -> frozenset[str]:
    """Words of at least four letters that a vocabulary file has as whole words (with the space before them), and those of ``CODE_WORDS``."""
    with open(vocabulary, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return CODE_WORDS | {p[1:].decode() for p in pieces if p[:1] == b" " and len(p) > 4 and p[1:].isascii() and p[1:].isalpha() and p[1:].islower()}


CREDENTIAL = frozenset("token secret password passwd pwd key apikey api auth credential credentials bearer access private login".split())
HARMLESS = frozenset("commit sha hash md5 checksum digest uuid guid id example sample dummy test order card phone isbn version revision integrity etag blob image icon number invoice account".split())
TEST_PATH = re.compile(r"test|example|fixture|mock|sample|docs?\b|vendor|lock", re.I)
FEATURES = 22


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def coverage(value: str, vocabulary: str = VOCABULARY) -> float:
    """The share of the value's characters that dictionary words of at least 3 letters cover."""
    words, covered = dictionary(vocabulary), 0
    for run in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
        best = [0] * (len(run) + 1)
        for e in range(1, len(run) + 1):
            best[e] = best[e - 1]
            for n in range(3, min(16, e) + 1):
                if run[e - n : e] in words:
                    best[e] = max(best[e], best[e - n] + n)
        covered += best[-1]
    return covered / max(1, len(value))


class Transitions:
    """Log-odds of character bigrams between secrets and other values, with add-one smoothing over 64 symbols."""

    def __init__(self, values: list[str], labels: list[int]) -> None:
        counts = np.ones((2, 64, 64))
        for value, label in zip(values, labels):
            s = self._symbols(value)
            np.add.at(counts[int(label)], (s[:-1], s[1:]), 1)
        log = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.odds = log[1] - log[0]

    @staticmethod
    def _symbols(value: str) -> np.ndarray:
        points = np.frombuffer(value.encode("utf-32-le", "replace"), dtype=np.uint32)
        return np.where(points < 128, points % 64, 63).astype(np.int64) if len(points) else np.zeros(1, np.int64)

    def score(self, value: str) -> float:
        s = self._symbols(value)
        return float(self.odds[s[:-1], s[1:]].mean()) if len(s) > 1 else 0.0


def features(value: str, before: str, after: str, path: str, transitions: Transitions, vocabulary: str = VOCABULARY) -> list[float]:
    """One candidate's features."""
    n = max(1, len(value))
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    repeats = sum(a == b for a, b in zip(value, value[1:])) / max(1, n - 1)
    runs = sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:])) / max(1, n - 1)
    words = _WORD.findall(before.lower().replace("_", " "))[-6:]
    later = _WORD.findall(after.lower())[:3]
    return [
        float(len(value)), *share, changes, repeats, runs, _entropy(value), coverage(value, vocabulary), transitions.score(value),
        float(all(c in "0123456789abcdef" for c in value)), float(all(c in "0123456789ABCDEF" for c in value)), float(value.isdigit()), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float(bool(re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ|AIza|glpat-)", value))), float(value.endswith("=")), float(value.count("/") + value.count("-")),
        float(bool(CREDENTIAL.intersection(words))), float(bool(HARMLESS.intersection(words + later))), float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(bool(TEST_PATH.search(path or ""))),
    ]


def _assigned(value: str) -> str:
    """An assigned value without a query string's further parameters, and without a sentence's or bracket's end."""
    value = _NEXT.split(value, maxsplit=1)[0]
    while value and (value[-1] in ".:" or value[-1] in ")]}" and "([{"[")]}".index(value[-1])] not in value):
        value = value[:-1]
    return value


@lru_cache(maxsize=1)
def _names():
    import ahocorasick

    out = ahocorasick.Automaton()
    for name in _NAMES:
        out.add_word(name, len(name))
    out.make_automaton()
    return out


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def assigned_values(text: str) -> dict[int, str]:
    """Starts and values of what is assigned to credential-like names."""
    found, reached = {}, 0
    if ":" not in text and "=" not in text:
        return found
    low = _lower(text)
    for end, n in _names().iter(low):
        # a name within a value that was taken is none
        if end - n + 1 < reached:
            continue
        m = _VALUE.match(text, end + 1)
        if m:
            reached = m.end()
            value = _assigned(m.group(1))
            if len(value) >= 6:
                found[m.start(1)] = value
    return found


def candidates(text: str, long: list[tuple[int, int]] | None = None) -> list[tuple[int, str]]:
    """Starts and values of a text's candidates, in order. An assigned value wins over long tokens that overlap it.

    ``long`` has the starts and ends of the runs of token characters, if they are known.
    """
    found = assigned_values(text)
    spans = [(s, s + len(v)) for s, v in sorted(found.items())]
    at = 0
    for m in _LONG.finditer(text) if long is None else (_LONG.match(text, s) for s, _ in long):
        value = m.group().strip("=-/_") if not m.group().endswith("=") else m.group().lstrip("=-/_")
        start = m.start() + m.group().find(value)
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if len(value) >= 16 and any(c.isdigit() for c in value) and not (at < len(spans) and spans[at][0] < start + len(value)):
            found[start] = value
    return sorted(found.items())


def long_runs(data: np.ndarray, offsets: np.ndarray, least: int = 16) -> dict[int, list[tuple[int, int]]]:
    """By text, the starts and ends (in characters) of the runs of at least ``least`` token characters."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _TOKEN_BYTE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    # a run does not go on into the next text
    bounds = np.unique(offsets[1:-1])
    cut = bounds[inside[bounds] & inside[bounds + 1]]
    starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    out: dict[int, list[tuple[int, int]]] = {}
    if len(starts):
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        text = np.searchsorted(offsets, starts, side="right") - 1
        for t, a, b in zip(text.tolist(), (chars[starts] - chars[offsets[text]]).tolist(), (chars[ends] - chars[offsets[text]]).tolist()):
            out.setdefault(t, []).append((a, b))
    return out


def _candidate_batches(transitions: Transitions, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            data, offsets = tokens.texts_of(batch.column(1))
            for i, j in tokens.groups(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                runs = long_runs(part, own)
                # texts with neither a long run nor a place where something is assigned have no candidate
                marks = np.flatnonzero((part == 0x3A) | (part == 0x3D))
                some = sorted({*runs, *(np.searchsorted(own, marks, side="right") - 1).tolist()})
                texts, paths = (batch.column(c).slice(i, j - i).take(pa.array(some, pa.int64())).to_pylist() for c in (1, 2))
                rows: list[tuple] = []
                for k, text, path in zip(some, texts, paths):
                    for start, value in candidates(text, runs.get(k, [])):
                        before, after = text[max(0, start - 48) : start], text[start + len(value) : start + len(value) + 32]
                        rows.append((k, start, len(value), hashlib.sha256(value.encode("utf-8", "replace")).hexdigest(), features(value, before, after, path or "", transitions, vocabulary)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.string()),
                        pa.array([r[4] for r in rows], pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "start", "length", "sha256", "features"],
                )

    return run


class Model:
    """A fitted forest with its transition models and the dictionary's file."""

    def __init__(self, forest, transitions: Transitions, vocabulary: str = VOCABULARY) -> None:
        self.forest, self.transitions, self.vocabulary = forest, transitions, vocabulary

    def probability(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``features``) with the probability of being a secret in place of them."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        scored = self.forest.transform(rows.withColumn("_vector", array_to_vector("features")))
        return scored.withColumn("probability", vector_to_array("_probability")[1]).drop("features", "_vector", "_raw", "_probability", "_label")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, max_findings: int = MAX_FINDINGS, seed: int = 7, vocabulary: str = VOCABULARY) -> Model:
    """Fits the forest to labelled findings (``value``, ``before``, ``after``, ``path``, ``label`` 0 or 1)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    usable = findings.where("value IS NOT NULL AND label IN (0, 1)").select("value", *(F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after", "path")), F.col("label").cast("int").alias("label"))
    rows = usable.orderBy(F.xxhash64("value", "before", "after", "path", "label"), "value", "label").limit(max_findings).collect()
    if {r.label for r in rows} != {0, 1}:
        raise ValueError("training needs labelled findings of both labels")
    # bigrams from one half, the forest from the other: the forest sees scores as they are on new values
    half = rows[0::2] if {r.label for r in rows[0::2]} == {0, 1} else rows
    transitions = Transitions([r.value for r in half], [r.label for r in half])
    fit = rows[1::2] if {r.label for r in rows[1::2]} == {0, 1} else rows
    made = findings.sparkSession.createDataFrame([(float(r.label), features(r.value, r.before, r.after, r.path, transitions, vocabulary)) for r in fit], "label double, features array<double>")
    table = made.coalesce(1).select("label", array_to_vector("features").alias("_vector"))
    forest = RandomForestClassifier(labelCol="label", featuresCol="_vector", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_label").fit(table)
    return Model(forest, transitions, vocabulary)


def secret_scan(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Findings that the model confirms: ``doc_id``, ``start``, ``length``, ``sha256``, ``probability``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    found = map_text(rows, _candidate_batches(model.transitions, model.vocabulary), "doc_id long, start long, length long, sha256 string, features array<double>")
    return model.probability(found).where(F.col("probability") >= threshold)


def labelled_findings(spark: SparkSession, n: int = 8_000, seed: int = 11) -> DataFrame:
    """Labelled findings made from fixed rules: random keys in credential contexts, and what scanners mistake for them.

    No table of the test data labels findings; a deployment passes its own triage history instead.
    """
    return spark.createDataFrame(synthetic_findings(n, seed), "value string, before string, after string, path string, label int")


def synthetic_findings(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """The rows of ``labelled_findings``."""
    import random
    import uuid

    rng = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = sorted(CODE_WORDS)
    text = lambda k: "".join(rng.choice(alnum) for _ in range(k))
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
    out = []
    for _ in range(n):
        before, after, path = prose(), " " + prose(), rng.choice(["src/app.py", "config/prod.env", "deploy.yaml", "web", "src3", "src12", "notes.md", ""])
        if rng.random() < 0.5:
            value = rng.choice([
                lambda: "".join(rng.choice(hexes) for _ in range(rng.choice([32, 40, 48, 64]))), lambda: text(rng.choice([20, 24, 32, 40])), lambda: "AKIA" + text(16).upper(),
                lambda: "ghp_" + text(36), lambda: "sk-" + text(40), lambda: base64.b64encode(rng.randbytes(rng.choice([24, 32, 48]))).decode(), lambda: text(rng.randint(10, 14)) + rng.choice("!#%&*"),
            ])()
            name = rng.choice(["token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "private_key", "client_secret", "credential"])
            sep = rng.choice([" = ", "=", ": ", '": ', " := "])
            out.append((value, f"{before} {name}{sep}{rng.choice(['', chr(34), chr(39)])}", rng.choice(["", '"', "'"]) + after, path, 1))
            continue
        kind = rng.randrange(8)
        if kind == 0:
            value, lead = "".join(rng.choice(hexes) for _ in range(rng.choice([32, 40, 64]))), rng.choice(["commit ", "sha256 ", "md5: ", "checksum = ", "revision ", "digest: "])
        elif kind == 1:
            value, lead = str(uuid.UUID(int=rng.getrandbits(128))), rng.choice(["uuid ", "id: ", "request id = ", "order ", ""])
        elif kind in (2, 3):
            value, lead = "".join(rng.choice("0123456789") for _ in range(rng.choice([16, 16, 18, 20]))), rng.choice(["card ", "number ", "", "", "order id ", "the ", "account "])
        elif kind == 4:
            value, lead = rng.choice(["your_token_here_1", "xxxxxxxxxxxxxxxx1", "changeme1234567890", "example-secret-key-123", "1234567890abcdef", "password_placeholder_1", "aaaaaaaaaaaaaaaa1111", "REPLACE_ME_0000000"]), rng.choice(["token = ", 'password: "', "secret=", 'api_key = "'])
        elif kind == 5:
            value, lead = rng.choice(["/", "-", "_"]).join(rng.choice(words) for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 99)), rng.choice(["path ", "class ", "see ", "token/", ""])
        elif kind == 6:
            value, lead = "".join(w.capitalize() for w in rng.choices(words, k=rng.randint(3, 5))) + str(rng.randint(1, 9)), rng.choice(["component ", "class ", "new ", "auth: ", ""])
        else:
            value, lead = rng.choice(words) + rng.choice(["", "1", "_value"]) + rng.choice(words), rng.choice(["password = ", "token: ", "auth = ", "secret: "])
        out.append((value, f"{before} {lead}", after, path if rng.random() < 0.7 else rng.choice(["tests/fixtures/a.py", "docs/example.md", "package-lock.json"]), 0))
    return [row for made in out for row in _as_scanned(*made)]


def _as_scanned(value: str, before: str, after: str, path: str, label: int) -> list[tuple[str, str, str, str, int]]:
    """A labelled value as the scan finds it in its line; as it is where the scan has no candidate there."""
    line, first, last = before + value + after, len(before), len(before) + len(value)
    met = [(s, v) for s, v in candidates(line) if s < last and first < s + len(v)]
    return [(v, line[max(0, s - 48) : s], line[s + len(v) : s + len(v) + 32], path, label) for s, v in met] or [(value, before, after, path, label)]
