r"""Personal data: fixed patterns, and further spans by weak supervision.

The base spans (e-mail, IP, card and phone) follow four patterns and their checks, and always stay. Wider patterns propose
further candidates: numbers that only look like cards, phone numbers without a plus, spelled-out addresses and secrets
behind a cue. Five labelers vote on each candidate (yes, no, or nothing): the strict pattern, a gazetteer of prefixes and
endings, the words before it, its surroundings, and its make-up. Votes are counted over all documents; expectation
maximisation estimates every labeler's reliability and each vote pattern's probability of being personal data, without
labels. A logistic classifier over the votes and shape of a span is trained on these probabilities and adds the candidates
it accepts that overlap no base span; of those that overlap each other the likeliest stays.

The vote table has at most kinds x 3^5 x shapes rows, whatever the corpus; documents are scored row by row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the base rules.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that starts within a run of digits would also start at the run's start, so these find what [0-9]+... finds
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Wider candidates.
MORE = ("number", "local_phone", "spelled_email", "secret")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,5}", re.IGNORECASE)
_AT = re.compile(r"[\[(]at[\])]", re.IGNORECASE)  # in every match of the one above
_SECRET = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key)[\"']?\x20?[:=]\x20?[\"']?([A-Za-z0-9+/_-]{16,})", re.IGNORECASE)
# Gazetteer: endings of mail domains, leading digits of card issuers, words that announce personal data.
_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk")
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "36", "38")
_CUES = frozenset("call phone tel telephone mobile fax contact mail email card visa mastercard account iban id ssn token secret password key".split())
_BEFORE = re.compile(r"[A-Za-z]+")

ACCEPT = 0.9
N_LABELERS, LENGTHS = 5, 4


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost e-mail matches: the run of address characters before each @ and the domain behind it; linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(start, kind, end) of the base spans in order, and of numbers of 12 to 19 digits that fail the check digit."""
    found = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    failed = []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    found.append((m.start(), "ip", m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19:
                    (found if luhn(digits) else failed).append((m.start(), "card" if luhn(digits) else "number", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), "phone", m.end()))
    found.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return found, failed


def _key(text: str, a: int, kind: str, b: int, strict: bool) -> tuple[int, ...]:
    """A candidate's kind, the five votes (0 no, 1 nothing, 2 yes) and its length class."""
    said = text[a:b]
    digits = "".join(c for c in said if "0" <= c <= "9")
    if kind in ("email", "spelled_email"):
        gazetteer = 2 if re.split(r"[.\x20)\]]", said.lower())[-1] in _ENDINGS else 0
        makeup = 2 if re.search(r"[A-Za-z]", said) else 0
    elif kind == "secret":
        gazetteer = 1
        makeup = 2 if len(set(said)) >= 10 and digits and len(digits) < len(said) else 0
    elif kind == "ip":
        gazetteer = 0 if said.split(".")[0].lstrip("0") in ("", "127", "255") else 2
        makeup = 2 if len(set(said)) > 3 else 0
    else:
        gazetteer = 2 if kind in ("card", "number") and digits.startswith(_ISSUERS) or kind in ("phone", "local_phone") and "(" in said else 1
        makeup = 2 if len(set(digits)) >= 5 else 0
    words = _BEFORE.findall(text[max(0, a - 40) : a].lower())[-3:]
    context = 2 if any(w in _CUES for w in words) else 1
    edge = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    kinds = KINDS + MORE
    pattern = 2 if strict else 0 if kind == "number" else 1  # the other wider kinds have no strict pattern to fail
    return kinds.index(kind), pattern, gazetteer, context, 2 if edge else 0, makeup, min(LENGTHS - 1, (b - a) // 12)


def candidates(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[tuple[int, ...], tuple[int, str, int]]], Counter]:
    """The base spans, the wider candidates with their keys, and the keys of all."""
    text = text or ""
    base, more = base_spans(text)
    if _DIGIT.search(text):
        more += [(m.start(), "local_phone", m.end()) for m in _LOCAL_PHONE.finditer(text)]
    if "=" in text or ":" in text:
        more += [(m.start(1), "secret", m.end(1)) for m in _SECRET.finditer(text)]
    if _AT.search(text):
        more += [(m.start(), "spelled_email", m.end()) for m in _SPELLED.finditer(text)]
    taken = sorted((a, b) for a, _, b in base)
    free = [(a, kind, b) for a, kind, b in sorted(more) if not any(x < b and a < y for x, y in taken)]
    keyed = [(_key(text, a, kind, b, False), (a, kind, b)) for a, kind, b in free]
    return base, keyed, Counter([k for k, _ in keyed] + [_key(text, a, kind, b, True) for a, kind, b in base])


def vote_table(docs: DataFrame) -> DataFrame:
    """(key, n): how many candidates of all documents have a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen += candidates(text.as_py())[2]
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, k)) for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def reliabilities(keys: np.ndarray, n: np.ndarray, turns: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation over vote patterns: each key's probability of being personal data, and
    table[labeler, truth, vote], the estimated behaviour of the labelers."""
    votes, kinds = keys[:, 1 : 1 + N_LABELERS], keys[:, 0]
    p = np.clip(0.5 + 0.15 * (votes - 1).sum(axis=1), 0.05, 0.95)
    table = np.zeros((N_LABELERS, 2, 3))
    for _ in range(turns):
        for j in range(N_LABELERS):
            for v in range(3):
                at = votes[:, j] == v
                table[j, 1, v], table[j, 0, v] = (n * p)[at].sum() + 1, (n * (1 - p))[at].sum() + 1
        table /= table.sum(axis=2, keepdims=True)
        prior = np.array([(1 + (n * p)[kinds == k].sum()) / (2 + n[kinds == k].sum()) for k in kinds])
        odds = np.log(prior) - np.log(1 - prior)
        for j in range(N_LABELERS):
            odds += np.log(table[j, 1, votes[:, j]]) - np.log(table[j, 0, votes[:, j]])
        before, p = p, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(p - before).max() < 1e-6:
            break
    return p, table


def _features(keys: np.ndarray) -> np.ndarray:
    kinds, lengths = np.eye(len(KINDS) + len(MORE))[keys[:, 0]], np.eye(LENGTHS)[keys[:, -1]]
    votes = np.eye(3)[keys[:, 1 : 1 + N_LABELERS]].reshape(len(keys), -1)
    return np.concatenate([kinds, lengths, votes, np.ones((len(keys), 1))], axis=1)


def classifier(keys: np.ndarray, n: np.ndarray, p: np.ndarray, turns: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on the features of the keys, towards the probabilities p; Newton's method."""
    x, w = _features(keys), np.zeros(_features(keys).shape[1])
    for _ in range(turns):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - q)) - ridge * w)
        w = w + np.clip(step, -2, 2)
    return w


def train(docs: DataFrame) -> np.ndarray | None:
    """The classifier's weights, learned from the votes on all candidates of ``docs``; None without candidates."""
    rows = vote_table(docs).orderBy("key").collect()  # its size doesn't depend on the corpus
    if not rows:
        return None
    keys, n = np.array([[int(x) for x in r.key.split(",")] for r in rows]), np.array([float(r.n) for r in rows])
    return classifier(keys, n, reliabilities(keys, n)[0])


def probability(weights: np.ndarray | None, key: tuple[int, ...]) -> float:
    return 0.0 if weights is None else float(1 / (1 + np.exp(-np.clip(_features(np.array([key])) @ weights, -30, 30)))[0])


def chosen(more: list[tuple[tuple[int, ...], tuple[int, str, int]]], p: Callable[[tuple[int, ...]], float]) -> list[tuple[int, str, int]]:
    """The accepted candidates without overlap, in order; the likelier one stays, of equal ones the first."""
    out: list[tuple[int, str, int]] = []
    for q, (a, kind, b) in sorted(((p(key), span) for key, span in more), key=lambda x: (-x[0], x[1])):
        at = bisect_left(out, (a,))
        if q >= ACCEPT and (at == 0 or out[at - 1][2] <= a) and (at == len(out) or out[at][0] >= b):
            out.insert(at, (a, kind, b))
    return out


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _text_of(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def found(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """FOUND's columns for every row: counts and digest of the base spans, and all spans (kind:start:end, code points).

    Spans are ordered by start, then kind (base kinds first). A null or empty text has none. Repeated rows give repeated
    results, an empty table an empty one; other columns are ignored.
    """
    kinds = KINDS + MORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], float] = {}

        def p(key: tuple[int, ...]) -> float:
            if key not in known:
                known[key] = probability(weights, key)
            return known[key]

        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1):
                base, more, _ = candidates(text.as_py())
                counts.append(Counter(kind for _, kind, _ in base))
                digests.append(hashlib.sha256(_text_of(base).encode()).hexdigest())
                spans.append(_text_of(sorted(base + chosen(more, p), key=lambda x: (x[0], kinds.index(x[1])))))
            columns = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def masked(docs: DataFrame, weights: np.ndarray | None, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; null texts stay null."""

    @F.pandas_udf("string")
    def run(texts):
        def mask(t):
            if t is None:
                return None
            base, more, _ = candidates(t)
            good = base + chosen(more, lambda key: probability(weights, key))
            out, at = [], 0
            for a, kind, b in sorted(good):
                if a >= at:
                    out += [t[at:a], f"<{kind}>"]
                    at = b
            return "".join(out) + t[at:]

        return texts.map(mask)

    return docs.withColumn(text, run(F.col(text)))
