"""Credentials embedded in source code and configuration: found by a trained score, masked in place.

Candidates are values that stand where credentials stand: shapes of known issuers, passwords in URLs, headers and connection
strings, private key blocks, values assigned to names that speak of secrets (in several languages), and arguments of login
calls. Pattern matches label some of them weakly. Character Markov models of labelled secrets and of labelled other values are
counted over all data (a table of fixed size); a logistic regression on their likelihood ratio, the words of the name, the shape
of the value and the path is fitted on a bounded sample (about ``SAMPLE`` rows, by hash) and calibrated on another;
candidates with a calibrated probability of at least ``CUT`` that an exact check doesn't exclude are credentials, and are masked
by stars of equal length.

Defined results: null and empty texts have none and come back as they are; repeated rows of a record count once; a credential
over several lines is one, at its first line, and keeps its line breaks when masked; quotes, prefixes and user names stay;
where labels of only one kind exist, they decide themselves; whole texts are read; only the last text of a record counts.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Labelled candidates for fitting, and as many for calibration; a bound of the model, not of the data searched.
SAMPLE = 20_000
#: Least calibrated probability of a credential; under one half, since a missed credential costs more than a masked word.
CUT = 0.3

# Shapes of issuers' tokens and of places for passwords (fixed values), each with the strings of which a text must hold one.
_SHAPES: list[tuple[str, tuple[str, ...], re.Pattern[str]]] = [
    ("issued", ("eyJ",), re.compile(r"(?<![\w-])eyJ[\w-]{6,}\.[\w-]{4,}(?:\.[\w-]*)?")),
    ("issued", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), re.compile(r"(?<![\w-])(?:gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,})")),
    ("issued", ("glpat-", "xox", "npm_", "pypi-", "dckr_pat_", "dop_v1_", "lin_api_"), re.compile(r"(?<![\w-])(?:glpat-[\w-]{12,}|xox[abeoprs]-[\w-]{10,}|npm_[A-Za-z0-9]{20,}|pypi-[\w-]{16,}|dckr_pat_[\w-]{20,}|dop_v1_\w{20,}|lin_api_\w{20,})")),
    ("issued", ("k_live_", "k_test_"), re.compile(r"(?<![\w-])[srpw]k_(?:live|test)_\w{10,}")),
    ("issued", ("AKIA", "ASIA", "AROA", "AIDA", "AIza"), re.compile(r"(?<![\w-])(?:(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{12,}|AIza[\w-]{30,})(?![\w-])")),
    ("issued", ("sk-", "SG.", "shpat_", "shpss_", "hf_", "ya29."), re.compile(r"(?<![\w-])(?:sk-[\w-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|shp(?:at|ss)_\w{20,}|hf_[A-Za-z]{20,}|ya29\.[\w-]{20,})")),
    ("pem", ("PRIVATE KEY",), re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")),
    ("url", ("://",), re.compile(r"://[^\s:/@'\"<>`]*:([^\s@/'\"<>`]+)@(?=[\w.\-\[$])")),
    ("basic", ("Basic ", "basic "), re.compile(r"\b[Bb]asic +([A-Za-z0-9+/=]{8,})")),
    ("header", ("Bearer ", "bearer "), re.compile(r"\b[Bb]earer +([A-Za-z0-9+/=._~\-]{8,})")),
    ("conn", ("AccountKey=", "SharedAccessKey=", "SharedAccessSignature="), re.compile(r"\b(?:AccountKey|SharedAccessKey|SharedAccessSignature)=([^;\"'\s]{6,})")),
]
_CALLS = ("ogin(", "og_in(", "ign_in(", "ignIn(", "onnect(", "uthenticate(", "assword(", "uth(", "redentials(", "redential(")
_CALL = re.compile(r"\b(?:\w*[._])?(?:login|log_in|signIn|sign_in|connect|authenticate|setPassword|set_password|withPassword|with_password|basicAuth|basic_auth|withCredentials|with_credentials|withBasicAuth|[Cc]redentials?|BasicAuth|HTTPBasicAuth)\(((?:[^()\n]|\([^()\n]*\))*)\)?")
# Words that speak of secrets: what the text must hold in lower case, and the pattern.
_SECRET_WORDS = ("pass", "pwd", "secret", "token", "credential", "kennwort", "contrase", "clave", "mdp", "geheim", "key", "bearer", "jwt", "auth", "salt")
_SECRET = re.compile(r"passw|passphrase|passwd|pwd|pass(?![a-z])|passe(?![a-z])|secret|token|credential|kennwort|contrase|clave(?![a-z])|mdp(?![a-z])|geheim|(?:api|access|private|signing|encryption|hmac|master|account|shared|auth|client|license|storage|deploy|ssh|service|admin)[_\-. ]?key|bearer|jwt|authorization|auth(?![a-z])|salt(?![a-z])")
_NAME_CHARS = re.compile(r"[\w.\-]*")
_SEPARATOR = re.compile(r"""["']?\]?(?:\s*:\s*[A-Za-z][\w<>\[\]?]*(?=\s*=))?\s*(?::=|=>|[:=](?!=))\s*""")
_QUOTED = re.compile(r"""[rRbBuUfF]{0,2}(?:"((?:[^"\\\n]|\\.)*)("?)|'((?:[^'\\\n]|\\.)*)('?)|`([^`\n]*)(`?))""")
_COLON = re.compile(r"\s*:")
_BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>]\S*")
_BARE_LOOSE = re.compile(r"\S+")
_CODE = (".java", ".kt", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".c", ".cpp", ".cs", ".rb", ".php", ".swift")
_STRING_ARG = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")

_STRONG = frozenset("password passwd passwort pwd pass passphrase secret kennwort contraseña contrasena clave mdp motdepasse passe geheim geheimnis credential credentials".split())
_KEYED = frozenset("api access private signing encryption hmac master account shared auth client storage deploy ssh service admin secret license".split())
_OTHER = frozenset("hint path endpoint url uri mask placeholder min max expiry expires ttl reset public checksum hash etag sha digest commit correlation file env var prompt title message regex pattern template format strength validator error help id".split())
_HASHES = frozenset("checksum hash etag sha sha1 sha256 md5 digest commit correlation public fingerprint integrity revision uuid guid trace request version".split())
_REFERENCE = re.compile(r"^\$?\{.*\}?$|^\$\(?[\w.]+\)?$|\$\{[^}]*\}|\{\{.*|^%\w+%$|^<[^>]*>?$|process\.env|getenv|environ|^(?:vault|secret|env|ssm|arn|ref|kms|file|keyring|op)\s*[:(/]|^![A-Za-z]+$|^@\w+[.@/]|^#\{|^(?:await |new )?[A-Za-z_$][\w$]*(?:\.[\w$]+)*\(|^[A-Za-z]\w*<", re.I)
_LOWER_WORDS = re.compile(r"^[a-zà-ÿ]+(?:[ ._/\-:][a-zà-ÿ]+)*(?:[-_.:]\d{1,6})?$|^[\d.,:\-/ ]+$|^[A-ZÀ-Þ_]+$")
_DUMMY = re.compile(r"your[-_ ]|^your|change.?me|change.?it|example|placeholder|dummy|redacted|replace.?(?:me|this|with)|insert.?(?:your|here)|^x{3,}|xxxx|^todo|^fixme|\bfoo|\bbar\b|_here\b|not.?set|undefined|^null$|^none$|^nil$|^true$|^false$|^test$|^sample$|^masked$|^hidden$|censored|\.\.\.|<.*>|^n/?a$|^tbd$", re.I)
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_HEX = re.compile(r"^(?:0x)?[0-9a-f]{24,}$", re.I)
_PREFIXED_HASH = re.compile(r"^(?:sha\d+|md5)[:\-]", re.I)
_PASSPHRASE = re.compile(r"^[a-zà-ÿ]{3,}(?:[-_.][a-zà-ÿ]{3,}){3,}$")
_WORDS = re.compile(r"^[A-Za-zÀ-ÿ]+(?:[ ._/\-:][A-Za-zÀ-ÿ]+)*$|^[A-Za-z]+(?:[A-Z][a-z]+)+\d{0,2}$|^[a-z]+(?:[-_.][a-z]+)*[-_.:]?\d{1,6}$|^[\d.,:\-/ ]+$")
_CAMEL = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-ZÀ-Þ]?[a-zà-ÿ]+|\d+")
_ALPHABET = {c: i for i, c in enumerate(map(chr, range(32, 127)))}
_N = len(_ALPHABET) + 2  # one for other characters, one for the ends


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _CAMEL.findall(name)]


class Candidate:
    __slots__ = ("start", "end", "value", "name", "kind", "quoted")

    def __init__(self, start: int, end: int, value: str, name: str, kind: str, quoted: bool) -> None:
        self.start, self.end, self.value, self.name, self.kind, self.quoted = start, end, value, name, kind, quoted


_NAME_BEFORE = re.compile(r"([\w.\-]+)[\"']?\]?\s*(?::\s*[A-Za-z][\w<>]*\s*)?(?::=|=>|[:=])\s*[rRbBuUfF]?[\"'`]?$")


def _name_before(text: str, at: int) -> str:
    """The name that the value at text[at] is given to on its line."""
    first, width = text.rfind("\n", 0, at) + 1, 128
    while True:
        low = max(first, at - width)
        m = _NAME_BEFORE.search(text, low, at)
        if low == first or m is None and not text[low:at].strip(" \t\"'`rRbBuUfF=:>") == "" or m is not None and m.start() > low:
            return m[1] if m else ""
        width *= 4


def candidates(text: str, path: str) -> list[Candidate]:
    """Values that stand where credentials stand, in order, without overlaps."""
    out: list[Candidate] = []
    code = (path or "").lower().endswith(_CODE)
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, name: str, kind: str, quoted: bool) -> None:
        if end > start:
            out.append(Candidate(start, end, text[start:end], name, kind, quoted))
            taken.append((start, end))

    for kind, needs, shape in _SHAPES:
        if not any(x in text for x in needs):
            continue
        for m in shape.finditer(text):
            if kind == "issued":
                add(m.start(), m.end(), _name_before(text, m.start()), kind, True)
            elif kind == "pem":
                end = _PEM_END.search(text, m.end())
                again = text.find("-----BEGIN", m.end())
                stop = end.start() if end and (again < 0 or end.start() < again) else again if again > 0 else len(text)
                add(m.start(), stop, "", kind, True)
            else:
                add(m.start(1), m.end(1), {"url": "url password", "conn": "account key"}.get(kind, "authorization"), kind, True)
    if any(x in text for x in _CALLS):
        for m in _CALL.finditer(text):
            args = m[1]
            strings = list(_STRING_ARG.finditer(args))
            if strings and (len(strings) > 1 or "assw" in m[0]) and not args[strings[-1].end() :].strip(" ,)"):
                k = 1 if strings[-1][1] is not None else 2
                add(m.start(1) + strings[-1].start(k), m.start(1) + strings[-1].end(k), "password", "call", True)
    taken.sort()
    lefts = [a for a, _ in taken]
    done = -1
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for m in _SECRET.finditer(low) if any(w in low for w in _SECRET_WORDS) else ():
        if m.start() < done:
            continue
        left = m.start()
        while left > 0 and (text[left - 1].isalnum() or text[left - 1] in "_.-"):
            left -= 1
        if left > 0 and text[left - 1] in "@/":  # a host or a path
            continue
        right = _NAME_CHARS.match(text, m.end()).end()
        done = right
        name = text[left:right].strip("-.")
        sep = _SEPARATOR.match(text, right)
        if not sep:
            continue
        at = sep.end()
        q = _QUOTED.match(text, at)
        if q and (q[1] is not None or q[3] is not None or q[5] is not None):
            k = 1 if q[1] is not None else 3 if q[3] is not None else 5
            start, end, quoted = q.start(k), q.end(k), True
            if "\n" in sep[0] and _COLON.match(text, q.end()):  # the first key of what follows
                continue
        elif "\n" in sep[0]:  # without quotes, the next line is a statement or key of its own
            continue
        else:
            line = text[text.rfind("\n", 0, left) + 1 : left]
            comment = re.search(r"(?://|#|^\s*\*|/\*)", line)
            if code and not comment:
                continue
            b = (_BARE if code else _BARE_LOOSE).match(text, at)
            if not b:
                continue
            start, end, quoted = b.start(), b.end(), False
            while end > start and text[end - 1] in ",;\"')":
                end -= 1
        i = bisect_right(lefts, end)
        if any(a < end and start < b for a, b in taken[max(0, i - 3) : i + 1]):
            continue
        if end > start:
            out.append(Candidate(start, end, text[start:end], name, "named", quoted))
    out.sort(key=lambda c: c.start)
    return out


def _classes(v: str) -> tuple[int, int, int, int]:
    return (any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() for c in v))


def _entropy(v: str) -> float:
    n = len(v)
    return -sum(k / n * math.log2(k / n) for k in (v.count(c) for c in set(v))) if n else 0.0


def _basic_ok(v: str) -> bool:
    try:
        return b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
    except ValueError:
        return False


def name_strength(name: str) -> tuple[float, float, float]:
    """How much a name speaks of a secret, of something about a secret, and of a hash or identifier."""
    w = name_words(name)
    strong = any(x in _STRONG for x in w) or any(a in _KEYED and b == "key" for a, b in zip(w, w[1:])) or "passw" in name.lower() or {"mot", "passe"} <= set(w)
    strong = strong or bool(w) and (w[-1] == "auth" or "auth" in w[1:])
    medium = any(x in ("token", "auth", "key", "bearer", "jwt", "authorization", "salt", "pin") for x in w)
    about = [x for x in w if x in _OTHER and not (x == "id" and "access" in w)]
    # only words behind the secret word say that the value is something about it
    first = next((i for i, x in enumerate(w) if x in _STRONG or x in ("token", "key", "auth")), 0)
    about = [x for x in w[first:] if x in about]
    hashed = any(x in _HASHES for x in w)
    return (1.0 if strong else 0.5 if medium and not hashed else 0.0, float(bool(about)), float(hashed))


def plain(c: Candidate) -> bool:
    """Whether the value is plainly no credential: a reference, mask, placeholder, sentence, path or words."""
    v = c.value
    return bool(_REFERENCE.search(v) or _DUMMY.search(v) or len(set(v)) <= 2 or _UUID.match(v) or _PREFIXED_HASH.match(v) or " " in v or (c.kind in ("named", "call") and v.startswith(("/", "./", "http://", "https://"))) or v.startswith("ssh-"))


def passphrase(c: Candidate) -> bool:
    """Whether the value is several plain words under a name that speaks of a password itself."""
    if not _PASSPHRASE.match(c.value):
        return False
    strong, about, _ = name_strength(c.name)
    return strong == 1.0 and not about


def excluded(c: Candidate) -> bool:
    """The exact check after the score: what is plainly none, plain lower-case words and numbers, and digests under a digest's name."""
    return c.kind != "pem" and (plain(c) or (c.kind in ("named", "call") and bool(_LOWER_WORDS.match(c.value)) and not passphrase(c)) or (c.kind == "named" and bool(_HEX.match(c.value)) and name_strength(c.name)[2] > 0 and name_strength(c.name)[0] < 1))


def weak_label(c: Candidate) -> int | None:
    """1, 0 or None (no pattern applies)."""
    v = c.value
    if c.kind == "pem":
        return 1
    if plain(c):
        return 0
    if c.kind in ("issued", "conn"):
        return 1
    if c.kind == "basic":
        return int(_basic_ok(v))
    if c.kind == "url":
        return 1 if not _WORDS.match(v) or len(v) > 5 else None
    strong, about, hashed = name_strength(c.name)
    if about or hashed:
        return 0
    if passphrase(c):
        return 1
    if strong == 1.0 or c.kind == "call":
        if _LOWER_WORDS.match(v):
            return 0
        if any(ch.isdigit() for ch in v) and len(v) >= 6 and sum(_classes(v)) >= 2:
            return 1
        return None
    if _WORDS.match(v):
        return 0
    if strong == 1.0 or c.kind in ("call", "header") or "token" in c.name.lower():
        if _HEX.match(v):
            return 1 if c.kind == "named" else None
        if len(v) >= 7 and sum(_classes(v)) >= 3:
            return 1
    return None


def features(c: Candidate, ratio: float, path: str) -> list[float]:
    v = c.value
    lo, up, di, sy = _classes(v)
    strong, about, hashed = name_strength(c.name)
    n = min(len(v), 64)
    mixed = float(lo + up + di + sy >= 3 and len(v) >= 7)
    low = (path or "").lower()
    return [
        1.0, float(passphrase(c)), ratio, min(n, 40) / 20, _entropy(v) / 4, float(lo), float(up), float(di), float(sy), mixed, float(bool(_HEX.match(v))), float(bool(_WORDS.match(v))), float(bool(_LOWER_WORDS.match(v))), strong * float(bool(_LOWER_WORDS.match(v))), strong * float(di and lo + up > 0 and len(v) >= 6), float(plain(c)), strong, about, hashed, strong * mixed, strong * float(bool(_HEX.match(v))),
        float(c.kind == "issued"), float(c.kind == "url"), float(c.kind in ("basic", "header")), float(c.kind == "conn"), float(c.kind == "pem"), float(c.kind == "call"), float(c.quoted), strong * float(not c.quoted), float(low.endswith(_CODE)), float(bool(re.search(r"(?:^|/)(?:test|tests|fixtures?|examples?|samples?|mocks?)/", low))), float(low.endswith((".yml", ".yaml", ".json", ".properties", ".env", ".ini", ".toml"))), float(low.endswith((".md", ".rst", ".txt"))), float(_basic_ok(v)) if c.kind == "basic" else 0.0,
    ]


def _codes(v: str) -> list[int]:
    return [_N - 1, *[_ALPHABET.get(ch, _N - 2) for ch in v], _N - 1]


class Model:
    """Markov likelihoods and the calibrated regression; small and of a fixed size."""

    def __init__(self, counts: dict[int, np.ndarray]) -> None:
        self.logs = {y: np.log((c + 0.3) / (c + 0.3).sum(axis=1, keepdims=True)) for y, c in counts.items()}
        self.weights: np.ndarray | None = None
        self.scale, self.shift = 1.0, 0.0

    def ratio(self, v: str) -> float:
        if v.startswith("-----BEGIN"):
            return 0.0
        k = _codes(v)
        d = self.logs[1] - self.logs[0]
        return float(np.clip(sum(d[a, b] for a, b in zip(k, k[1:])) / max(1, len(k) - 1), -1.5, 1.5))

    def score(self, c: Candidate, path: str) -> float:
        if excluded(c):
            return 0.0
        if self.weights is None:  # nothing to fit: the patterns decide
            return float(weak_label(c) == 1)
        z = float(np.dot(self.weights, features(c, self.ratio(c.value), path))) * self.scale + self.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights by Newton's method with a ridge; both classes count the same in sum."""
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) / len(y) + ridge * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def texts(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """(record_table, record_id, path, text, at): the texts that are searched."""
    a = sources.select(F.lit("source_files").alias("record_table"), F.col("source_id").alias("record_id"), "path", F.col("content").alias("text"), F.col("ingested_at").alias("at"))
    return a.unionByName(evidence.select(F.lit("evidence").alias("record_table"), F.col("evidence_id").alias("record_id"), "path", F.col("excerpt").alias("text"), F.col("ingested_at").alias("at")))


_FOUND = "record_table string, record_id string, path string, line_no int, start int, stop int, value string, name string, kind string, quoted boolean, label int, version long"


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for t, i, path, text, version in zip(f["record_table"], f["record_id"], f["path"], f["text"], f["version"], strict=True):
            for c in candidates(text, path or ""):
                y = weak_label(c)
                # a key block is known by its head; what follows doesn't take part in the scores
                rows.append((t, i, path, text.count("\n", 0, c.start) + 1, c.start, c.end, c.value if c.kind != "pem" else c.value[:27], c.name, c.kind, c.quoted, y, version))
        out = pd.DataFrame(rows, columns=["record_table", "record_id", "path", "line_no", "start", "stop", "value", "name", "kind", "quoted", "label", "version"])
        out["label"] = pd.array(list(out["label"]), dtype="Int32")
        yield out


def extracted(rows: DataFrame) -> DataFrame:
    return rows.where("length(text) > 0 and record_id is not null").select("record_table", "record_id", "path", "text", F.xxhash64("path", "text").alias("version")).mapInPandas(_extract, _FOUND)


def _bigrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = {0: np.zeros((_N, _N)), 1: np.zeros((_N, _N))}
    for f in frames:
        for y, v in zip(f["label"], f["value"], strict=True):
            k = _codes(v)
            np.add.at(counts[int(y)], (k[:-1], k[1:]), 1)
    for y, c in counts.items():
        a, b = np.nonzero(c)
        yield pd.DataFrame({"label": np.full(len(a), y, dtype=np.int32), "a": a.astype(np.int32), "b": b.astype(np.int32), "n": c[a, b].astype(np.int64)})


def _featured(model: Model):
    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [features(Candidate(0, 0, v, n, k, bool(q)), model.ratio(v), path or "") for v, n, k, q, path in zip(f["value"], f["name"], f["kind"], f["quoted"], f["path"], strict=True)]
            yield pd.DataFrame({"o": f["o"], "y": f["label"].astype("int32"), "x": rows})

    return featured


def train(found: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of all labelled candidates: counts over all of them, weights from a bounded sample."""
    labelled = found.where("label is not null")
    counts = {0: np.zeros((_N, _N)), 1: np.zeros((_N, _N))}
    # at most 2 * 97 * 97 rows, whatever the data
    for r in labelled.where("kind <> 'pem'").select("label", "value").mapInPandas(_bigrams, "label int, a int, b int, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():
        counts[r["label"]][r["a"], r["b"]] = r["n"]
    model = Model(counts)
    # a share of all labelled rows by their hashes, so that about 2 * sample are expected; only their features come to the driver
    n = labelled.count()
    order = F.xxhash64("record_table", "record_id", "start", "value")
    rows = labelled.select("path", "value", "name", "kind", "quoted", "label", order.alias("o"))
    if n > 2 * sample:
        rows = rows.where(F.col("o") < int(-(1 << 63) + (1 << 64) * (2 * sample / n)))
    got = rows.mapInPandas(_featured(model), "o long, y int, x array<float>").toPandas().sort_values(["o", "y"], kind="stable")
    if not len(got) or got["y"].nunique() < 2:
        return model
    x, y = np.array(got["x"].tolist(), dtype=float), got["y"].to_numpy(dtype=float)
    half = np.arange(len(y)) % 2 == 0 if len(y) >= 40 else np.ones(len(y), dtype=bool)
    model.weights = fit_logistic(x[half], y[half])
    # Platt's calibration on the rows that weren't fitted
    rest = ~half if len(y) >= 40 and len(set(y[~half])) == 2 else half
    z = x[rest] @ model.weights
    ab = fit_logistic(np.column_stack([z, np.ones(len(z))]), y[rest], ridge=1e-3)
    if ab[0] > 0:
        model.scale, model.shift = float(ab[0]), float(ab[1])
    return model


def _score(model: Model, least: float):
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = [model.score(Candidate(0, 0, v, n, k, bool(q)), path or "") for v, n, k, q, path in zip(f["value"], f["name"], f["kind"], f["quoted"], f["path"], strict=True)]
            f = f.assign(score=p)
            yield f.loc[f["score"] >= least, ["record_table", "record_id", "version", "path", "line_no", "start", "stop", "kind", "name", "score"]]

    return score


def credentials(sources: DataFrame, evidence: DataFrame, least: float = CUT) -> DataFrame:
    """(record_table, record_id, path, line_no, start, stop, kind, name, score): each credential of each record's rows."""
    found = cut(extracted(texts(sources, evidence)))
    model = train(found)
    kept = found.select("record_table", "record_id", "version", "path", "line_no", "start", "stop", "kind", "name", "value", "quoted").mapInPandas(
        _score(model, least), "record_table string, record_id string, version long, path string, line_no int, start int, stop int, kind string, name string, score double")
    # texts aren't moved to find the last one of a record, only their digests
    last = texts(sources, evidence).where("record_id is not null").groupBy("record_table", "record_id").agg(F.max(F.struct(F.col("text").isNotNull(), "at", F.xxhash64("path", "text").alias("version"))).alias("v"))
    return kept.distinct().join(last.select("record_table", "record_id", F.col("v.version").alias("version")), ["record_table", "record_id", "version"], "left_semi").drop("version")


_KEY_BODY = re.compile(r"(?<![\\A-Za-z0-9+/=])[A-Za-z0-9+/=]{4,}|(?<=\\[nr])[A-Za-z0-9+/=]{4,}")


def hidden_spans(text: str, c: Candidate) -> list[tuple[int, int]]:
    """What of a credential is masked: all of it, but of a key block only the encoded runs, since quotes and signs of code may lie between."""
    if c.kind != "pem":
        return [(c.start, c.end)]
    body = c.start + text[c.start : c.end].index("KEY")
    return [m.span() for m in _KEY_BODY.finditer(text, text.index("-----", body) + 5, c.end)]


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans starred, line breaks kept."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        out.append(text[at:a])
        out.append(re.sub(r"[^\r\n]", "*", text[a:b]))
        at = b
    return "".join(out) + text[at:]


def _mask_frames(model: Model, least: float):
    def frames_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, n = [], []
            for path, text in zip(f["path"], f["text"], strict=True):
                hits = [c for c in candidates(text, path or "") if model.score(c, path or "") >= least] if text else []
                out.append(mask(text, [x for c in hits for x in hidden_spans(text, c)]) if hits else text)
                n.append(len(hits))
            yield f[["record_table", "record_id"]].assign(text=out, masked=n)

    return frames_of


def redacted(sources: DataFrame, evidence: DataFrame, least: float = CUT) -> DataFrame:
    """(record_table, record_id, text, masked): each record's last text with its credentials masked, null texts included."""
    rows = texts(sources, evidence)
    model = train(cut(extracted(rows)))
    last = rows.where("record_id is not null").groupBy("record_table", "record_id").agg(F.max_by(F.struct("path", "text"), F.struct(F.col("text").isNotNull(), "at", F.xxhash64("path", "text"))).alias("v")).select("record_table", "record_id", "v.*")
    return last.mapInPandas(_mask_frames(model, least), "record_table string, record_id string, text string, masked int")
